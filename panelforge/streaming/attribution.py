"""Two streams joined on a key and a time interval: each outcome with the actions shortly before it, late rows counted.

Both sides carry a watermark, and the interval bounds how far apart matches lie, so Spark frees a row's state once no row
that may still arrive can match it. Rows later than the watermark take part in nothing; they are counted batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.tables import shared_folder
from panelforge.streaming import arrivals

DELAY_HOURS, WITHIN_HOURS = 2, 6


def attributed(actions: DataFrame, outcomes: DataFrame, key: str = "user_id", delay_hours: int = DELAY_HOURS, within_hours: int = WITHIN_HOURS) -> DataFrame:
    """outcome_id, action_id, key and times of each pair with the action at most ``within_hours`` before the outcome, or at its time."""
    a = actions.select(F.col(key).alias("_key"), F.col("event_id").alias("action_id"), F.col("ts").alias("action_ts")).withWatermark("action_ts", f"{delay_hours} hours")
    o = outcomes.select(key, F.col("event_id").alias("outcome_id"), F.col("ts").alias("outcome_ts"), "value").withWatermark("outcome_ts", f"{delay_hours} hours")
    near = (F.col("action_ts") <= F.col("outcome_ts")) & (F.col("action_ts") >= F.col("outcome_ts") - F.expr(f"interval {within_hours} hours"))
    return o.join(a, (F.col(key) == F.col("_key")) & near).drop("_key")


def start(spark: SparkSession, source: str, schema, at: str):
    """The running join of clicks with purchases; matches go to ``at/out``, an epoch a folder, so a repeated batch replaces itself."""
    events = lambda kind: arrivals.stream(spark, source, schema).where(F.col("event_type") == kind)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    pairs = attributed(events("click"), events("purchase"))
    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()


def clicks_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and their value a day, and the rows of either side that came too late."""
    source, schema = arrivals.events_in_slices(spark, sf_dir)
    at = shared_folder(spark, "attribution")
    progress = arrivals.run(start(spark, source, schema, at))
    pairs = spark.read.parquet(f"{at}/out/epoch=*")
    daily = pairs.groupBy(F.date_format("outcome_ts", "yyyy-MM-dd").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    late = spark.createDataFrame([("too late", arrivals.dropped(progress), None)], "what string, n long, value double")
    return daily.unionByName(late)


SQL = f"""with {arrivals.SLICES_SQL},
wa as ({arrivals.watermark_sql(DELAY_HOURS, "event_type = 'click'")}), wo as ({arrivals.watermark_sql(DELAY_HOURS, "event_type = 'purchase'")}),
w as (select slice, least(wa.wm, wo.wm) as wm from wa join wo using (slice)),
e as (select a.*, epoch_us(ts) <= wm * 1000 as late from a join w using (slice) where event_type in ('click', 'purchase')),
p as (select o.ts, o.value from e o join e c on o.user_id = c.user_id and c.ts <= o.ts and c.ts >= o.ts - interval {WITHIN_HOURS} hours where o.event_type = 'purchase' and c.event_type = 'click' and not o.late and not c.late)
select strftime(ts, '%Y-%m-%d') as what, count(*) as n, round(sum(value), 2) as value from p group by 1
union all select 'too late', count(*), null from e where late"""
