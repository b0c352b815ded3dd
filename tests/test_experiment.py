"""A batch of experiments and the loop over them."""

import random
from datetime import date, timedelta

import pytest

from panelforge.functions import formulas as fm
from panelforge.operators import backtest as bt
from panelforge.operators import experiment, robustness, screening
from panelforge.operators import memory as me
from panelforge.plans import compiler

REVERSAL = "rank(delta(ADJUSTED_PRICE, 5)) * -1"
CONFIGS = [
    ("ok", REVERSAL, "2020-01-01", "2021-06-01", "t1"),
    ("sign", "rank(delta(ADJUSTED_PRICE, 5))", "2020-01-01", "2021-06-01", "t2"),
    ("same", REVERSAL, "2020-01-01", "2021-06-01", "t3"),
    ("other", "ADJUSTED_VOLUME / ts_mean(ADJUSTED_PRICE, 10)", "2020-01-01", "2020-12-31", "t4"),
    ("short", "ts_mean(ADJUSTED_PRICE, 4000)", "2020-01-01", "2021-06-01", "t5"),
    ("open", "rank(ADJUSTED_PRICE", "2020-01-01", "2021-06-01", "t6"),
    ("nodates", REVERSAL, None, "2021-06-01", "t7"),
    ("empty", None, "2020-01-01", "2021-06-01", "t8"),
    ("known", "ts_std(ADJUSTED_PRICE, 8) * -1", "2020-01-01", "2021-06-01", "t9"),
]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(8)
    days = [d for d in (date(2020, 1, 1) + timedelta(i) for i in range(520)) if d.weekday() < 5]
    rows = []
    for t in range(36):
        price = 20.0 + t
        for d in days:
            price *= 1 + rng.gauss(0, 0.02)
            rows.append((d, t, f"S{t % 3}", None if rng.random() < 0.03 else round(price, 3), round(rng.random() * 1000, 1), round(100 + t + rng.random(), 2), 5.0))
    schema = "date date, ticker int, sector string, adjusted_price double, adjusted_volume double, revenue_ltm double, shares_diluted double"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.fixture(scope="module")
def reg(panel):
    from pyspark.sql import functions as F

    return bt.regimes(panel.groupBy("date").agg(F.avg("adjusted_price").alias("index_close"), F.stddev_samp("adjusted_price").alias("vol_close")))


def configs(spark, rows):
    df = spark.createDataFrame(rows, "alpha_id string, formula string, start_date string, end_date string, timestamp string")
    return df.selectExpr("*", "'sp500' as universe", "array('VOL_20D') as features")


@pytest.fixture(scope="module")
def outcomes(spark, panel, reg):
    store = spark.createDataFrame([("s1", "ts_std(ADJUSTED_PRICE, 8)", ["VOL_20D"], "t0")], experiment.RECORD_SCHEMA)
    return {r.alpha_id: r for r in experiment.run(configs(spark, CONFIGS), store, panel, reg=reg, shuffles=10).collect()}


def test_every_configuration_has_an_outcome(outcomes):
    assert {k: r.status for k, r in outcomes.items()} == {
        "ok": "completed", "sign": "duplicate", "same": "duplicate", "other": "completed", "short": "backtest_error", "open": "validation_failed",
        "nodates": "validation_failed", "empty": "validation_failed", "known": "duplicate",
    }
    assert outcomes["sign"].most_similar_id == outcomes["same"].most_similar_id == "ok" and outcomes["known"].most_similar_id == "s1"
    assert outcomes["nodates"].error == "missing:start_date" and "periods" in outcomes["short"].error
    assert all((r.verdict is not None) == (r.reflection is not None) == (r.status == "completed") for r in outcomes.values())


@pytest.mark.parametrize("name", ["ok", "other"])
def test_equals_one_experiment_step_by_step(panel, reg, outcomes, name):
    got = outcomes[name]
    _, formula, start, end, _ = next(c for c in CONFIGS if c[0] == name)
    part = panel.where(f"date between '{start}' and '{end}'")
    pairs = bt.aligned(compiler.signal(part, formula), part, bt.calendar(part)).cache()
    want = bt.metrics(pairs).first()
    assert [got.n_periods, got.noise_risk] == [want.n_periods, want.noise_risk]
    for a, b in experiment.METRICS.items():
        assert got[b] == pytest.approx(want[a], abs=2e-4), a
    if abs(got.IC_mean) < 0.005 and abs(got.Sharpe) < 0.1:
        assert got.placebo_score == got.robustness == 0.0 and not got.sector_ic
        return
    per = bt.periods(pairs)
    sectors = {r.sector: r.m for r in bt.sector_ic(pairs).groupBy("sector").agg({"ic": "avg"}).withColumnRenamed("avg(ic)", "m").collect()}
    assert got.sector_ic == pytest.approx(sectors, abs=1e-9)
    assert got.regime_sharpe == pytest.approx({r.regime: r.sharpe for r in bt.regime_sharpe(per, reg).collect()}, abs=1e-6)
    assert got.subperiod_stability == pytest.approx(bt.subperiod_stability(per).first()[0], abs=1e-9)
    assert got.placebo_score == pytest.approx(bt.placebo(pairs, shuffles=10).first()[0], abs=1e-9)


def test_dead_signals_are_not_checked(spark, panel):
    pairs, periods = screening.tables(panel, {"a": REVERSAL})[2:]
    assert robustness.checks(pairs.where("false"), periods.where("false")).collect() == []
    found = robustness.checks(pairs, periods, shuffles=3).first()
    assert found.regime_sharpe == {} and set(found.sector_ic) == {"S0", "S1", "S2"}


def test_nothing_to_run(spark, panel):
    assert experiment.run(configs(spark, []), None, panel).collect() == []
    assert experiment.run(configs(spark, CONFIGS[5:8]), None, panel).where("status != 'validation_failed'").count() == 0


def test_twins_against_all_pairs(spark):
    rng = random.Random(3)
    some = [f"rank({'delta' if i % 2 else 'ts_mean'}(ADJUSTED_PRICE, {3 + i % 4})) + {' + '.join(f'rank(ts_std(ADJUSTED_VOLUME, {j}))' for j in range(2, 2 + rng.choice([1, 12, 13])))}" for i in range(24)]
    some += [f"-({f})" for f in some[:4]] + [some[5]]
    rng.shuffle(some)
    rows = [(f"a{i:02d}", f, "2020-01-01", "2021-01-01", f"t{i // 2:02d}") for i, f in enumerate(some)]
    runs, want = [], {}
    for name, f, *_ in rows:
        other = next((x for x, g in runs if fm.canonical(f) == fm.canonical(g)), None) or next((x for x, g in runs if fm.structural(f, g) >= fm.DUPLICATE), None)
        if other:
            want[name] = other
        else:
            runs.append((name, f))
    got = experiment.twins(configs(spark, rows))
    assert set(got) == set(want) and len(want) > 4
    assert all(v in dict(runs) for v in got.values())


def test_loop_goes_on_where_it_was(spark, panel, tmp_path):
    base = {"start_date": "2020-01-01", "end_date": "2021-06-01"}
    a = experiment.Research(spark, str(tmp_path), panel, base=base, seed=1, shuffles=3, answer=lambda p: '[{"direction": "own", "formula": "rank(delta(ADJUSTED_PRICE, 7))", "features": ["MOM6_1"]}]')
    first = a.round(2).collect()
    assert {p.action for p in first} == {"explore"} and "completed" in {p.status for p in first}
    kept = me.Store(spark, f"{tmp_path}/records").load()
    assert {r.formula for r in kept.collect()} >= {"rank(delta(ADJUSTED_PRICE, 7))"}
    before = {r.arm_id: (r.alpha, r.beta) for r in a.arms.load().collect()}
    assert before[me.EXPLORE][0] + before[me.EXPLORE][1] == pytest.approx(5.0)  # the prior's three, and two pulls
    b = experiment.Research(spark, str(tmp_path), panel, base=base, seed=1, shuffles=3, answer=lambda p: "no json")
    assert b.posteriors()[me.EXPLORE] == pytest.approx(before[me.EXPLORE])
    told = b.loop(1, 1)
    assert told[0][0].batch_id == "round-000002"


def test_loop_stops_after_failures(spark, panel, tmp_path):
    a = experiment.Research(spark, str(tmp_path), panel.where("ticker < 3"), base={"start_date": "2020-01-01", "end_date": "2021-06-01"}, seed=1, shuffles=3)
    told = a.loop(9, 1, most_failures=2)
    assert len(told) == 2 and {p.status for r in told for p in r} == {"backtest_error"}
    assert {p.reward for r in told for p in r} == {0.0}
