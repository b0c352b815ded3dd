"""Streaming over the events table: watermarked windows and sessions.

Each query drives a Structured Streaming job over events in the order of their arrival, slice by slice, to the end of the
source (availableNow) and answers from what it wrote alone. Watermarks are hours, so state goes and late rows are dropped;
batch SQL over the order of arrival says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.tables import shared_folder
from panelforge.streaming import arrivals

DELAY_HOURS, SESSION_DELAY_HOURS = 3, 1


def to_end(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream until its source is read, then the rows it wrote.

    With mode "update" a key's row of the last batch counts: state goes once the watermark has passed, and rows that the
    watermark has not closed when the source ends are there too. With "append" they are not.
    """
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    names = stream.columns

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out/epoch=*")
    if mode == "update":
        rest = [c for c in names if c not in keys]
        last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_last"))
        return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    return out.select(*names)


def _events(spark: SparkSession, sf_dir: str, delay_hours: int) -> DataFrame:
    return arrivals.stream(spark, *arrivals.events_in_slices(spark, sf_dir)).withWatermark("ts", f"{delay_hours} hours")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, counted by a stream; an event whose hour the watermark has passed is too late."""
    agg = _events(spark, sf_dir, DELAY_HOURS).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    out = to_end(agg, "update", ["w", "event_type"])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding two-hour windows every hour, updates merged to the latest; an event counts in those windows that are still open."""
    agg = _events(spark, sf_dir, DELAY_HOURS).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return to_end(agg, "update", ["w"]).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("most", 4).alias("most"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, closed by half an hour of silence; repeated events dropped within the watermark, late ones at all.
    Sessions that the watermark has not closed when the source ends are not given out."""
    once = _events(spark, sf_dir, SESSION_DELAY_HOURS).dropDuplicatesWithinWatermark(["event_id"])
    closed = to_end(once.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")))
    return closed.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


_W = f"with {arrivals.SLICES_SQL}, w as ({arrivals.watermark_sql(DELAY_HOURS)}), e as (select a.*, wm from a join w using (slice))"
HOURLY_SQL = f"{_W} select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as v from e where epoch_us(date_trunc('hour', ts)) // 1000 + 3600000 > wm group by 1, 2"
WINDOWS_SQL = f"{_W} select start, count(*) as n, round(max(value), 4) as most from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start, value, wm from e) where epoch_us(start) // 1000 + 7200000 > wm group by start"
SESSIONS_SQL = f"""with {arrivals.SLICES_SQL}, w as ({arrivals.watermark_sql(SESSION_DELAY_HOURS)}),
e as (select distinct on (event_id) user_id, ts from a join w using (slice) where epoch_us(ts) > wm * 1000),
g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as first from e),
n as (select user_id, ts, sum(first) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
select user_id, min(ts) as start, count(*) as n from n group by user_id, k
having epoch_us(max(ts)) + 1800000000 <= (select max(epoch_us(ts) // 1000) - {SESSION_DELAY_HOURS * 3600000} from a) * 1000"""
