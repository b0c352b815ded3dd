"""A running information coefficient: rank correlation of signal and outcome, given out when its hour has closed.

A stateful processor keeps the pairs of an open hour as a list state, a row for each micro-batch that brought some, and their
number as a value state. A timer at the hour's end emits the coefficient once the watermark has passed it and clears the
state, so state is bounded by the hours that are open. Rows later than the watermark never reach the processor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelforge.functions.tables import shared_folder
from panelforge.streaming import arrivals

DELAY_HOURS, LEAST = 3, 3
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "hour_ms long, kind string, n long, ic double"


def rank_correlation(x: np.ndarray, y: np.ndarray, least: int = LEAST) -> float | None:
    """Spearman's coefficient, ties at their mean rank; none for fewer than ``least`` pairs or a side without spread."""
    if len(x) < least:
        return None
    a, b = (pd.Series(v).rank().to_numpy() for v in (x, y))
    if a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


class HourlyCoefficient(StatefulProcessor):
    """Keyed by (start of the hour in milliseconds, kind)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getListState("pairs", "x array<double>, y array<double>")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        x, y = [], []
        for pdf in rows:
            x += pdf["x"].tolist()
            y += pdf["y"].tolist()
        seen = self.count.get()[0] if self.count.exists() else 0
        if not seen:
            self.handle.registerTimer(int(key[0]) + 3_600_000)
        self.pairs.appendValue((x, y))
        self.count.update((seen + len(x),))
        yield pd.DataFrame({"hour_ms": pd.Series([], dtype="int64"), "kind": pd.Series([], dtype=str), "n": pd.Series([], dtype="int64"), "ic": pd.Series([], dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        x, y = [], []
        for a, b in self.pairs.get():
            x += list(a)
            y += list(b)
        n = self.count.get()[0]
        self.pairs.clear()
        self.count.clear()
        yield pd.DataFrame({"hour_ms": [int(key[0])], "kind": [key[1]], "n": [n], "ic": [rank_correlation(np.array(x), np.array(y))]}).astype({"ic": "float64"})

    def close(self) -> None:
        pass


def start(spark: SparkSession, source: str, schema, at: str, delay_hours: int = DELAY_HOURS):
    """The running job over a folder of arrivals; closed hours go to ``at/out``, an epoch a folder."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, PROVIDER)  # a started query keeps the settings of its start
    events = arrivals.stream(spark, source, schema).withWatermark("ts", f"{delay_hours} hours")
    rows = events.select("ts", F.unix_millis(F.date_trunc("hour", "ts")).alias("hour_ms"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("double").alias("x"), F.col("value").alias("y")).where("x is not null and y is not null")
    found = rows.groupBy("hour_ms", "kind").transformWithStateInPandas(statefulProcessor=HourlyCoefficient(), outputStructType=SCHEMA, outputMode="append", timeMode="EventTime")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("hour", F.timestamp_millis("hour_ms")).drop("hour_ms").write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    query = found.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return query


def running_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficient of each closed hour and kind of event, and the number of rows that came too late."""
    source, schema = arrivals.events_in_slices(spark, sf_dir)
    at = shared_folder(spark, "coefficients")
    progress = arrivals.run(start(spark, source, schema, at))
    closed = spark.read.parquet(f"{at}/out/epoch=*").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "kind", "n", (F.round(F.col("ic") + 1.3e-7, 6) + 0.0).alias("ic"))
    late = spark.createDataFrame([("too late", None, arrivals.dropped(progress), None)], "hour string, kind string, n long, ic double")
    return closed.unionByName(late)


SQL = f"""with {arrivals.SLICES_SQL}, w as ({arrivals.watermark_sql(DELAY_HOURS)}),
e as (select a.*, date_trunc('hour', ts) as hour, epoch_us(ts) <= wm * 1000 as late, cast(json_extract(props, '$.k') as double) as x from a join w using (slice)),
r as (select *, rank() over (partition by hour, event_type order by x) + (count(*) over (partition by hour, event_type, x) - 1) / 2.0 as rx, rank() over (partition by hour, event_type order by value) + (count(*) over (partition by hour, event_type, value) - 1) / 2.0 as ry from e where not late),
final as (select max(epoch_us(ts) // 1000) - {DELAY_HOURS * 3600000} as wm from a),
c as (select hour, event_type as kind, count(*) as n, corr(rx, ry) as ic, min(x) < max(x) and min(value) < max(value) as spread from r group by 1, 2 having epoch_us(hour) // 1000 + 3600000 <= (select wm from final))
select strftime(hour, '%Y-%m-%d %H') as hour, kind, n, case when n >= {LEAST} and spread then round(ic + 1.3e-7, 6) + 0.0 end as ic from c
union all select 'too late', null, count(*), null from e where late"""
