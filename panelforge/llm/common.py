"""What the operators share: scratch tables in the shared folder, size-checked broadcasts, salting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"

#: Rows of a side that may be broadcast; beyond it a shuffle does the same work.
BROADCAST_ROWS = 500_000

_own_dir: str | None = None
_roots: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without that setting, a temporary folder."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="panelforge-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_roots() -> None:
    for spark, root in _roots:
        try:
            delete(spark, root)
        except Exception:  # the JVM may have ended already
            local = root.removeprefix("file://")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    ``table`` writes and rereads; ``drop`` removes what no later plan reads. The rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/panelforge-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


#: Bytes of an Arrow batch between the JVM and a worker. Spark's own limit of 64 MB holds several times that in both at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, unless they run on this machine and PYTHONPATH shows it to them.

    Also lowers the session's limit of an Arrow batch to ``BATCH_BYTES``, where it is Spark's default.
    """
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    top = Path(__file__).resolve().parent.parent.parent
    sc = spark.sparkContext
    here = sc.master.startswith("local") and str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if here or getattr(sc, "_panelforge_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="panelforge-zip-"), "panelforge.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((top / "panelforge").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(at))
    sc._panelforge_shipped = True


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if a count shows it small, else as it is: then a shuffle join does the same."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def id_parts(row_id: Column, name: str = "doc_id") -> list[Column]:
    """A row id as two columns without nulls, the id and no_id: pandas would turn ids beside nulls into doubles."""
    return [F.coalesce(row_id.cast("long"), F.lit(0)).alias(name), row_id.isNull().alias("no_id")]


def id_back(name: str = "doc_id") -> Column:
    """The id that ``id_parts`` has split."""
    return F.when(~F.col("no_id"), F.col(name)).alias(name)


def salt_of(*cols: str | Column, salts: int = 64) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, null counting as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda x: x != "")


def without_space(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def lookup_array(values: list[float]) -> Column:
    """A constant array of numbers; parsed once, when the plan is optimised."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: The words of a text, and A-Z as a-z, in DuckDB's SQL.
WORDS_SQL = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
