"""Events in the order of their arrival: a source of several slices, each read by one micro-batch, with late rows among them.

An event arrives up to ``SPREAD`` seconds after its own time, and every ``LATE_EVERY``-th more than ``LATE_HOURS`` hours after
it. Slice k holds what arrives in the k-th part of the time. Spark judges lateness by the watermark of the micro-batch before: the
greatest event time of slices up to k - 2, less the delay. So batch SQL can say which rows were too late (``SLICES_SQL``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.tables import shared_folder

SLICES, FILES = 10, 2
SPREAD, LATE_EVERY, LATE_HOURS = 1800, 40, 240
SPAN_HOURS = 30 * 24 + LATE_HOURS + 1


def arriving(events: DataFrame) -> DataFrame:
    """The events with the slice in which they arrive."""
    late = F.when(F.col("event_id") % LATE_EVERY == 0, F.lit(LATE_HOURS * 3600)).otherwise(F.lit(0))
    delay = (F.col("event_id") * 7919) % SPREAD + late
    begin = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    hours = F.timestamp_diff("SECOND", begin, F.col("ts").cast("timestamp_ntz")) + delay
    return events.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor(hours * SLICES / (SPAN_HOURS * 3600))).cast("int"))


def write_slices(events: DataFrame, at: str, slices: range = range(SLICES), files: int = FILES) -> str:
    """Each slice as ``files`` files, one slice after the other, so that file times keep the order of arrival."""
    found = arriving(events)
    for k in slices:
        found.where(F.col("slice") == k).drop("slice").repartition(files).write.mode("append").parquet(f"{at}/slice-{k}")
    return at


def stream(spark: SparkSession, at: str, schema, files: int = FILES) -> DataFrame:
    """A stream of the slices, one a micro-batch; ``ts`` is a timestamp."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(at)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def events_in_slices(spark: SparkSession, sf_dir: str) -> tuple[str, object]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return write_slices(events, shared_folder(spark, "arrivals")), events.schema


def run(query) -> list[dict]:
    """Run a started query to its source's end; its progress, batch by batch."""
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def dropped(progress: list[dict]) -> int:
    """Rows that came later than the watermark, as the engine counted them."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def states(progress: list[dict]) -> list[int]:
    """Rows of state after each batch."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]


#: Events with their slice, for batch SQL.
SLICES_SQL = f"""a0 as (
  select *, epoch_us(ts) // 1000000 - epoch_us(timestamp '2024-01-01') // 1000000 + (event_id * 7919) % {SPREAD} + case when event_id % {LATE_EVERY} = 0 then {LATE_HOURS * 3600} else 0 end as s from events
), a as (select *, least({SLICES - 1}, s * {SLICES} // {SPAN_HOURS * 3600}) as slice from a0)"""


def watermark_sql(hours: int, condition: str = "true") -> str:
    """slice, wm: the watermark (in milliseconds) by which each slice's rows are judged."""
    return f"select slice, greatest(0, coalesce(max(m) over (order by slice rows between unbounded preceding and 2 preceding), 0) - {hours * 3600000}) as wm from (select slice, max(epoch_us(ts) // 1000) as m from a where {condition} group by slice)"
