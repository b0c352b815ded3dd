"""A keyed table that a stream writes to exactly once: totals and latest values by key, under an atomic manifest.

A micro-batch becomes one part, a row for each of its keys: sums of the additive columns, and the latest columns with the
order they are latest by. A part counts once a manifest names it. The manifest also holds a ledger: the last epoch of each
query. An epoch that comes again (a replay after a failure between the write and the stream's own commit) is already in the
ledger and changes nothing, although its columns add up. Manifests are numbered; a new one is renamed into its place and that
fails if the place is taken, so of two writers one starts again from the other's result. A part that was written and never
named is no part of the table; ``vacuum`` removes it.

Reading adds up the parts by key, a partial aggregate for each part. ``compact`` replaces them by one; the replaced ones stay
until the next compaction, for readers that still have the old manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import manifests
from panelforge.functions.manifests import Conflict
from panelforge.functions.tables import delete, hadoop_path, shared_folder
from panelforge.streaming import arrivals

MOST_PARTS, MANIFESTS, TRIES = 8, 2, 10


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], sums: list[str], latest: list[str], order: list[str], most_parts: int = MOST_PARTS):
        self.spark, self.path, self.keys, self.sums, self.latest, self.order, self.most_parts = spark, path.rstrip("/"), keys, sums, latest, order, most_parts
        field = lambda c: T.StructField(c, schema[c].dataType)
        self.part_schema = T.StructType([*map(field, [*keys, *sums]), T.StructField("_order", T.StructType(list(map(field, order)))), T.StructField("_latest", T.StructType(list(map(field, latest))))])

    # manifests

    @property
    def _manifests(self) -> str:
        return f"{self.path}/manifest"

    def numbers(self) -> list[int]:
        return manifests.numbers(self.spark, self._manifests)

    def manifest(self) -> dict:
        return manifests.newest(self.spark, self._manifests) or {"number": 0, "ledger": {}, "parts": [], "retired": []}

    def publish(self, manifest: dict) -> None:
        manifests.publish(self.spark, self._manifests, manifest)

    # rows

    def _added(self, rows: DataFrame) -> DataFrame:
        """A row a key of rows in the shape of a part."""
        best = F.max(F.struct("_order", "_latest"))
        added = rows.groupBy(*self.keys).agg(*[F.sum(c).cast(self.part_schema[c].dataType).alias(c) for c in self.sums], best.alias("_best"))
        return added.select(*self.keys, *self.sums, F.col("_best._order").alias("_order"), F.col("_best._latest").alias("_latest"))

    def _parts(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.part_schema)
        return self.spark.read.schema(self.part_schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _write(self, rows: DataFrame, name: str) -> str:
        name = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def upsert(self, batch: DataFrame, query: str, epoch: int) -> bool:
        """Add a micro-batch once. False if the ledger shows that it has been added before."""
        part = None
        for _ in range(TRIES):
            now = self.manifest()
            if now["ledger"].get(query, -1) >= epoch:
                if part:
                    delete(self.spark, f"{self.path}/data/{part}")
                return False
            if part is None:
                shaped = batch.select(*self.keys, *self.sums, F.struct(*self.order).alias("_order"), F.struct(*self.latest).alias("_latest"))
                part = self._write(self._added(shaped), f"{query}-{epoch}")
            try:
                self.publish(now | {"number": now["number"] + 1, "ledger": now["ledger"] | {query: epoch}, "parts": [*now["parts"], part]})
            except Conflict:
                continue
            if len(now["parts"]) >= self.most_parts:
                self.compact()
            return True
        raise Conflict(f"no free manifest number in {TRIES} tries")

    def read(self) -> DataFrame:
        """keys, sums, latest and order columns: a row a key, as the newest manifest has it."""
        rows = self._added(self._parts(self.manifest()["parts"]))
        return rows.select(*self.keys, *self.sums, *[F.col(f"_latest.{c}").alias(c) for c in self.latest], *[F.col(f"_order.{c}").alias(c) for c in self.order if c not in self.latest])

    def compact(self) -> bool:
        """Replace all parts by one. False if another writer came first; then nothing changes."""
        now = self.manifest()
        part = self._write(self._added(self._parts(now["parts"])), "whole")
        try:
            self.publish(now | {"number": now["number"] + 1, "parts": [part], "retired": now["parts"]})
        except Conflict:
            delete(self.spark, f"{self.path}/data/{part}")
            return False
        for name in now["retired"]:
            delete(self.spark, f"{self.path}/data/{name}")
        for n in self.numbers()[:-MANIFESTS]:
            delete(self.spark, f"{self.path}/manifest/{n:012d}.json")
        return True

    def vacuum(self) -> list[str]:
        """Remove parts that no manifest names. Call it when no writer is at work."""
        now = self.manifest()
        at, fs = hadoop_path(self.spark, f"{self.path}/data")
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        lost = sorted(set(found) - {*now["parts"], *now["retired"]})
        for name in lost:
            delete(self.spark, f"{self.path}/data/{name}")
        return lost


def user_table(spark: SparkSession, at: str, schema, most_parts: int = MOST_PARTS) -> KeyedTable:
    """Events by user: their number and value, and the kind of the latest."""
    shape = T.StructType([*schema.fields, T.StructField("n", T.LongType())])
    return KeyedTable(spark, at, shape, ["user_id"], ["n", "value"], ["event_type"], ["ts", "event_id"], most_parts)


def start(spark: SparkSession, source: str, schema, at: str, table: KeyedTable, times: int = 1):
    """The running job that adds arrivals to a table, each batch ``times`` times over."""

    def write(batch: DataFrame, epoch: int) -> None:
        for _ in range(times):
            table.upsert(batch.withColumn("n", F.lit(1).cast("long")), "users", epoch)

    events = arrivals.stream(spark, source, schema)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a stream that gave every batch twice, with compactions on the way."""
    source, schema = arrivals.events_in_slices(spark, sf_dir)
    at = shared_folder(spark, "sink")
    shape = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in schema.fields])
    table = user_table(spark, f"{at}/users", shape, most_parts=4)
    arrivals.run(start(spark, source, schema, at, table, times=2))
    return table.read().select("user_id", "n", F.round(F.col("value") + 1e-6, 2).alias("value"), "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


SQL = "select user_id, count(*) as n, round(sum(value) + 1e-6, 2) as value, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id"
