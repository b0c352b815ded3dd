"""Many formulas in one plan against one backtest each."""

import random
import re
from datetime import date, timedelta

import pytest

from panelforge.operators import backtest as bt
from panelforge.operators import screening
from panelforge.plans import compiler

FORMULAS = {
    "a": "rank(delta(ADJUSTED_PRICE, 5)) * -1",
    "b": "ADJUSTED_VOLUME / ts_mean(ADJUSTED_PRICE, 10)",
    "c": "sign(delta(ADJUSTED_PRICE, 3))",  # few distinct values: degenerate bins
    "d": "-rank(delta(ADJUSTED_PRICE, 5)) + 0 * ADJUSTED_VOLUME",
    "e": "group_rank(ts_std(ADJUSTED_PRICE, 8), SECTOR)",
    "short": "ts_mean(ADJUSTED_PRICE, 5000)",
    "broken": "rank(",
    "unknown": "rank(NO_SUCH)",
}


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(8)
    days = [d for d in (date(2020, 1, 1) + timedelta(i) for i in range(420)) if d.weekday() < 5]
    rows = []
    for t in range(34):
        price = 20.0 + t
        for d in days:
            price *= 1 + rng.gauss(0, 0.02)
            rows.append((d, t, f"S{t % 3}", None if rng.random() < 0.03 else round(price, 3), round(rng.random() * 1000, 1)))
    return spark.createDataFrame(rows, "date date, ticker int, sector string, adjusted_price double, adjusted_volume double").repartition(4).cache()


@pytest.mark.parametrize("at_once", [64, 2])
def test_equals_single_backtests(panel, monkeypatch, at_once):
    monkeypatch.setattr(screening, "AT_ONCE", at_once)
    found = {r[screening.KEY]: r.asDict() for r in screening.screen(panel, FORMULAS).collect()}
    assert set(found) == set(FORMULAS)
    dates = bt.calendar(panel)
    for name in "abcde":
        want = bt.metrics(bt.aligned(compiler.signal(panel, FORMULAS[name]), panel, dates)).first().asDict()
        got = found[name]
        assert got["status"] == "ok"
        for c, v in want.items():
            assert got[c] == (pytest.approx(v, abs=2e-4) if isinstance(v, float) else v), (name, c)
    assert found["short"]["status"] == "few periods" and found["short"]["sharpe"] is None
    assert found["broken"]["status"] == found["unknown"]["status"] == "invalid" and "NO_SUCH" in found["unknown"]["reason"]


def test_nothing_to_screen(panel):
    assert screening.screen(panel, {}).collect() == []
    assert [r.status for r in screening.screen(panel, {"x": "rank("}).collect()] == ["invalid"]


def test_exchanges_do_not_grow_with_formulas(panel):
    def exchanges(formulas):
        df = screening.pairs(screening.signals(screening.values_at(panel, formulas, bt.calendar(panel), panel)))
        return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))

    one = {"a": FORMULAS["a"]}
    many = {f"f{n}": f"rank(delta(ADJUSTED_PRICE, {n})) * -1" for n in range(2, 22)}
    assert exchanges(many) == exchanges(one)
