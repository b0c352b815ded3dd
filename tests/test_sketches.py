"""Kept sketches against exact aggregates, and merging against one sketch of all rows."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelforge.operators import sketches

SCHEMA = "d date, g string, u long, v double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(date(2024, 1, 1) + timedelta(rng.randrange(60)), rng.choice("abc"), rng.randrange(3000), rng.choice([None, rng.gauss(0, 1), float(rng.randrange(5))])) for _ in range(20_000)]
    return out + [(None, "a", 1, 1.0), (date(2024, 1, 5), None, None, None)]


def test_months_lie_within_the_stated_errors(spark, rows, tmp_path):
    s = sketches.Sketches(spark, str(tmp_path / "s"), ["g"])
    s.put(sketches.daily(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("d"), ["g"], "u", "v"))
    for by in (None, ["g"]):
        users, values, n = defaultdict(set), defaultdict(list), defaultdict(int)
        for d, g, u, v in rows:
            if d is None:
                continue
            at = (f"{d:%Y-%m}", g if by else 0)
            n[at] += 1
            users[at] |= {u} - {None}
            values[at] += [v] * (v is not None)
        found = s.merged(F.date_format("day", "yyyy-MM"), by, (0.1, 0.5, 0.9)).collect()
        assert len(found) == len(n)
        for r in found:
            at = (r.span, r.g if by else 0)
            assert r.n == n[at]
            assert abs(r.distinct_values - len(users[at])) <= sketches.DISTINCT_ERROR * len(users[at]) + 1
            for q in (0.1, 0.5, 0.9):
                x, vs = r[f"at_{q:g}"], values[at]
                if not vs:
                    assert x is None
                    continue
                assert sum(v < x for v in vs) / len(vs) <= q + 2 * sketches.RANK_ERROR and sum(v <= x for v in vs) / len(vs) >= q - 2 * sketches.RANK_ERROR


def test_a_day_replaces_itself_and_no_other(spark, rows, tmp_path):
    s = sketches.Sketches(spark, str(tmp_path / "s"), ["g"])
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(FileNotFoundError):
        s.days()
    s.put(sketches.daily(df.where("d < '2024-01-10'"), F.col("d"), ["g"], "u", "v"))
    s.put(sketches.daily(df.where("d >= '2024-01-09'"), F.col("d"), ["g"], "u", "v"))  # the 9th again
    s.put(sketches.daily(df.where("d = '2024-01-09'"), F.col("d"), ["g"], "u", "v"))
    whole = sketches.daily(df, F.lit("2024-01-01"), [], "u", "v").select("n", F.hll_sketch_estimate("distinct_sketch")).first()
    merged = s.merged(F.lit("all")).first()
    assert merged.n == sum(r[0] is not None for r in rows)
    assert abs(merged.distinct_values - whole[1]) <= 0.01 * whole[1]
    some = s.merged(F.lit("some"), where=F.col("day").between("2024-01-03", "2024-01-04")).first()
    assert some.n == sum(r[0] in (date(2024, 1, 3), date(2024, 1, 4)) for r in rows)
