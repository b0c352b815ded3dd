"""Numbered manifests in a shared folder: the newest one is what counts, and a number can be taken once only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from panelforge.functions.tables import hadoop_path


class Conflict(Exception):
    """Another writer has published this manifest number."""


def numbers(spark: SparkSession, folder: str) -> list[int]:
    at, fs = hadoop_path(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())


def newest(spark: SparkSession, folder: str) -> dict | None:
    found = numbers(spark, folder)
    if not found:
        return None
    at, fs = hadoop_path(spark, f"{folder}/{found[-1]:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Write the manifest under its number, or raise Conflict if the number is taken."""
    temp, fs = hadoop_path(spark, f"{folder}/_{uuid.uuid4().hex}")
    stream = fs.create(temp, True)
    stream.write(bytearray(json.dumps(manifest), "utf-8"))
    stream.close()
    to, _ = hadoop_path(spark, f"{folder}/{manifest['number']:012d}.json")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(temp), context.makeQualified(to), none)
    except Exception as e:
        fs.delete(temp, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(manifest["number"]) from e
        raise
