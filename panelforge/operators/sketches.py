"""Approximate aggregates as kept state: a sketch a day, merged to any span.

A day and group become one row: the number of rows, a HyperLogLog sketch of a column's distinct values and a KLL sketch of a
value's distribution, both of fixed size. They are written by month; a day that is computed again replaces itself and no other.
A span is answered from its days' sketches by merging, without the rows: what it reads grows with the days, not with them.

Stated errors: distinct counts have a relative standard error of 1.04 / sqrt(2^LG_K), 1.6 %; ``DISTINCT_ERROR`` is three of
them. A quantile's rank is off by no more than ``RANK_ERROR`` with 99 % confidence. Nulls are neither counted as distinct nor
ranked; a span without values has no quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.tables import exists, kept, shared_folder, small

LG_K, KLL_K = 12, 400
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.01


def daily(df: DataFrame, day: Column, groups: list[str], distinct: str, value: str) -> DataFrame:
    """day, groups, n, distinct_sketch, value_sketch."""
    rows = df.select(day.cast("date").alias("day"), *groups, F.col(distinct).alias("_d"), F.col(value).cast("double").alias("_v")).where("day is not null")
    return rows.groupBy("day", *groups).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_d", LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double("_v", KLL_K).alias("value_sketch"))


class Sketches:
    """Daily sketches in a folder, a part a month."""

    def __init__(self, spark: SparkSession, path: str, groups: list[str]):
        self.spark, self.path, self.groups = spark, path, groups

    def put(self, found: DataFrame) -> None:
        """Write days; those that are there already are replaced, others stay. Only the months that they lie in are rewritten."""
        new = kept(found.withColumn("month", F.date_format("day", "yyyy-MM")), shared_folder(self.spark, "sketched"))
        if exists(self.spark, self.path):
            touched = small(new.select("month").distinct())
            old = self.days().join(touched, "month", "left_semi").join(small(new.select("day").distinct()), "day", "left_anti")
            new = kept(new.unionByName(old), shared_folder(self.spark, "sketched"))
        out = new.repartition("month").write.partitionBy("month").option("partitionOverwriteMode", "dynamic")
        out.mode("overwrite").parquet(self.path)

    def days(self) -> DataFrame:
        if not exists(self.spark, self.path):
            raise FileNotFoundError(f"no sketches in {self.path}")
        return self.spark.read.parquet(self.path).withColumn("month", F.col("month").cast("string"))

    def merged(self, span: Column, by: list[str] | None = None, shares: tuple[float, ...] = (0.5,), where: Column | None = None) -> DataFrame:
        """span, by, n, distinct_values and one column ``at_<share>`` for each share: from the sketches of each span's days."""
        rows = self.days() if where is None else self.days().where(where)
        both = rows.groupBy(span.alias("span"), *(by or [])).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("value_sketch").alias("_v"))
        empty = F.kll_sketch_get_n_double("_v") == 0
        quantile = lambda q: F.when(~empty, F.kll_sketch_get_quantile_double("_v", F.lit(float(q)))).alias(f"at_{q:g}")
        return both.select("span", *(by or []), "n", F.hll_sketch_estimate("_d").alias("distinct_values"), *map(quantile, shares))
