"""Folders that driver and executors share, and broadcasts behind a count."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; beyond it a shuffle join does the same work.
SMALL_ROWS = 500_000
#: Distinct values whose results may be broadcast: results such as shapes are large.
FEW_VALUES = 20_000

_local: str | None = None
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; in local mode without it, under a temporary folder. Deleted when the driver ends."""
    global _local
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="panelforge-engine-")
            atexit.register(shutil.rmtree, _local, ignore_errors=True)
        top = "file://" + _local
    at = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, at))
    return at


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop_path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


@atexit.register
def _delete_made() -> None:
    for spark, at in _made:
        try:
            delete(spark, at)
        except Exception:  # the JVM may have ended already
            if at.startswith("file:"):
                shutil.rmtree(at.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def kept(df: DataFrame, at: str) -> DataFrame:
    """Written and read again: cuts the lineage, survives the loss of executors."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """With a broadcast hint if a count shows it small, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def once_each(df: DataFrame, keys: list[str], of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with a struct ``_of`` of the columns that ``of`` adds to a table of its distinct keys: copies of a value are worked on once."""
    values = kept(df.select(*keys).distinct(), shared_folder(df.sparkSession, "values"))
    found = of(values)
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*[c for c in found.columns if c not in keys]).alias("_of"))
    if values.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        found = F.broadcast(found)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(found, same, "left").drop(*[f"_{k}" for k in keys])
