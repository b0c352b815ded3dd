"""Segmented scans against windows and plain loops: hot keys, many blocks, nulls, ties, empty tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import segments


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(3000):
        k = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", "é", None])
        out.append((i, k, rng.randrange(4), rng.randrange(500), rng.random() if rng.random() < 0.08 else None, f"s{i}" if rng.random() < 0.3 else None, [i] if rng.random() < 0.02 else None))
    return out


SCHEMA = "id long, k string, j int, t int, x double, s string, l array<int>"


@pytest.mark.parametrize(("keys", "block"), [(["k"], 1_000_000), (["k"], 50), (["k"], 7), (["k", "j"], 50), ([], 50)])
def test_fill_equals_window(spark, rows, block, keys):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", "k", "j", "t", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("x", "s", "l")])
    got = segments.fill_forward(df, keys, ["t", "id"], ["x", "s", "l"], block)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_blocks_are_even_under_a_hot_key(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 6, 0).otherwise(F.col("id")).alias("k"), "id", F.when(F.col("id") == 0, 1.5).alias("x"))
    got = segments.fill_forward(df, ["k"], ["id"], ["x"], block_rows=2_000)
    assert got.where("k = 0 and x = 1.5").count() == df.where("k = 0").count()  # one value carried over a dozen blocks
    sizes = [r["count"] for r in df.repartitionByRange(20, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 40_000 / 20


def brute(left, right, strict, tolerance):
    out = []
    for i, k, t in left:
        best = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        r = max(best, key=lambda r: (r[1], r[2] is not None, r[2] or 0)) if best else None
        if r and tolerance is not None and t - r[1] > tolerance:
            r = None
        out.append((i, k, t, *(r[1:] if r else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("strict", "tolerance", "block"), [(False, None, 40), (True, None, 1_000_000), (False, 6, 9)])
def test_asof_equals_brute_force(spark, strict, tolerance, block):
    rng = random.Random(4)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(200)])) for i in range(500)] + [(1, "hot", 5)] * 2
    right = list(dict.fromkeys((key(), rng.choice([None, *range(0, 200, 3)]), rng.choice([None, *range(50)])) for _ in range(150)))
    a, b = spark.createDataFrame(left, "i long, k string, t int").repartition(3), spark.createDataFrame(right, "k string, u int, v int").repartition(2)
    got = segments.asof_join(a, b, ["k"], "t", "u", ties=[F.col("v")], strict=strict, tolerance=None if tolerance is None else F.lit(tolerance), block_rows=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right, strict, tolerance)


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, "x", 3)], "i long, k string, t int"), spark.createDataFrame([], "k string, u int, v int")
    assert [tuple(r) for r in segments.asof_join(a, b, ["k"], "t", "u").collect()] == [(1, "x", 3, None, None)]
    assert segments.asof_join(a.limit(0), b, ["k"], "t", "u").collect() == []
    with pytest.raises(ValueError, match="rename"):
        segments.asof_join(a, b.withColumnRenamed("v", "t"), ["k"], "t", "u")
