"""Rolling windows by blocks against the plain windows: every operator, gaps, ties, infinite values, short histories."""

import math
import random
from datetime import date, timedelta

import pytest

from panelforge.plans import blocks, compiler

ONE = sorted(blocks.NAMES - {"ts_corr", "ts_cov"}) + ["ts_rank"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(12)
    rows = []
    for t in range(6):
        for i in range(3 if t == 5 else 70):
            x = round(rng.gauss(1, 2), 1)
            if rng.random() < 0.04 and t != 4:
                x = rng.choice([None, float("inf"), -float("inf")])
            if t == 1 and i > 30:
                x = 2.5  # constant windows
            rows.append((date(2024, 1, 1) + timedelta(i), t, f"S{t % 2}", x, round(rng.random() * 9, 2) if t == 4 or rng.random() > 0.02 else None))
    return spark.createDataFrame(rows, "date date, ticker int, sector string, adjusted_price double, adjusted_volume double").repartition(3).cache()


def values(panel, formulas):
    return {(r.date, r.ticker): r for r in compiler.evaluate(panel, formulas).collect()}


@pytest.mark.parametrize("n", [2, 7, 20, 69])
def test_equal_to_plain_windows(panel, monkeypatch, n):
    formulas = {name: f"{name}(ADJUSTED_PRICE, {n})" for name in ONE} | {name: f"{name}(ADJUSTED_PRICE, ADJUSTED_VOLUME, {n})" for name in ("ts_corr", "ts_cov")}
    formulas |= {"nested": f"ts_max(rank(ts_mean(ADJUSTED_PRICE, {n})) - ts_min(ADJUSTED_VOLUME, {n}), {n})"}
    monkeypatch.setattr(blocks, "LEAST", 10_000)
    plain = values(panel, formulas)
    monkeypatch.setattr(blocks, "LEAST", 1)
    fast = values(panel, formulas)
    assert plain.keys() == fast.keys()
    some = 0
    for at, row in plain.items():
        for name in formulas:
            a, b = row[name], fast[at][name]
            a, b = (None if v is None or math.isnan(v) else v for v in (a, b))
            assert (a is None) == (b is None), (name, at, a, b)
            if a is not None:
                some += 1
                assert b == pytest.approx(a, rel=1e-9, abs=1e-9), (name, at)
    assert some > (30 if n == 69 else 1000)


def test_no_exchange_is_added(panel, monkeypatch):
    def exchanges():
        df = compiler.evaluate(panel, {"v": "ts_max(ADJUSTED_PRICE, 60) - ts_std(ADJUSTED_VOLUME, 60)"})
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    by_blocks = exchanges()
    monkeypatch.setattr(blocks, "LEAST", 10_000)
    assert by_blocks == exchanges() == 1
