"""Validation, complexity, similarity, compiler policy and scores against the survey's cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import formulas as fm
from panelforge.functions import registry
from panelforge.operators import memory as me
from panelforge.operators import scoring as sc
from panelforge.plans import compiler

A = "CFO_LTM / ADJUSTED_PRICE"


def test_sign_flips_are_one_formula():
    for b in (f"-({A})", f"-1 * ({A})", f"({A}) * -1", f"-(-(-({A})))", A):
        assert fm.canonical(b) == fm.canonical(A)
    assert fm.canonical("rank(-CFO_LTM) + rank(DA_LTM)") != fm.canonical("rank(CFO_LTM) + rank(DA_LTM)")


def test_structure():
    assert fm.structural("rank(CFO_LTM / ADJUSTED_PRICE)", "rank(ADJUSTED_PRICE / CFO_LTM)") < 0.95
    assert fm.structural("ts_mean(CFO_LTM, 20)", "ts_mean(ts_mean(CFO_LTM, 20), 20)") < 0.95
    assert fm.structural("rank(CFO_LTM) + rank(DA_LTM)", "rank(DA_LTM) + rank(CFO_LTM)") == 1.0
    assert fm.structural("rank(CFO_LTM / ADJUSTED_PRICE)", "rank(CFO_LTM / ADJUSTED_PRICE") == 1.0


def test_complexity():
    assert fm.complexity("rank(ADJUSTED_PRICE) * -1") == 4 or fm.complexity("rank(ADJUSTED_PRICE) * -1") == 5
    assert 10 <= fm.complexity("rank((OPERATING_INCOME_LTM + DA_LTM) / REVENUE_LTM) + rank(ADJUSTED_PRICE / (REVENUE_LTM / SHARES_DILUTED)) * -1") <= 13


@pytest.mark.parametrize("bad", ["rank(ASSETS_LTM)", "rank(CFO_LTM", "ts_stddev(CFO_LTM, 5)", "1 + 2", "", "rank(rank(rank(rank(rank(rank(CFO_LTM))))))"])
def test_errors(bad):
    assert fm.formula_errors(bad)


def test_valid_formula_has_no_errors():
    assert not fm.formula_errors("rank(ADJUSTED_PRICE.pct_change().rolling(20).std()) * -1")


@pytest.fixture(scope="module")
def wild(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2024-01-01", periods=30).date
    rows = [(d, t, None if rng.random() < 0.1 else float(np.round(rng.normal(), 1)), f"S{t % 3}" if t else None) for d in days for t in range(8)]
    pdf = pd.DataFrame(rows, columns=["date", "ticker", "adjusted_price", "sector"])
    return spark.createDataFrame(rows, "date date, ticker int, adjusted_price double, sector string"), pdf


def wide(df, name="v"):
    return df.select("date", "ticker", name).toPandas().pivot(index="date", columns="ticker", values=name).astype(float)


@pytest.mark.parametrize(
    "formula,fn",
    [
        ("rank(ADJUSTED_PRICE)", lambda x: x.rank(axis=1, pct=True)),
        ("ts_mean(ADJUSTED_PRICE, 5)", lambda x: x.rolling(5).mean()),
        ("ts_std(ADJUSTED_PRICE, 5)", lambda x: x.rolling(5).std()),
        ("ts_rank(ADJUSTED_PRICE, 5)", lambda x: x.rolling(5).rank(pct=True)),
        ("ema(ADJUSTED_PRICE, 5)", lambda x: x.ewm(span=5, adjust=False).mean()),
        ("ADJUSTED_PRICE.shift(2)", lambda x: x.shift(2)),
        ("decay_linear(ADJUSTED_PRICE, 4)", lambda x: x.rolling(4).apply(lambda w: (w * np.arange(1, 5)).sum() / 10)),
    ],
)
def test_operator_equals_pandas(wild, formula, fn):
    df, pdf = wild
    got = wide(compiler.evaluate(df, {"v": formula}))
    want = fn(pdf.pivot(index="date", columns="ticker", values="adjusted_price").astype(float))
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-9, equal_nan=True)


def test_division_is_ieee(wild):
    df, _ = wild
    v = [r.v for r in compiler.evaluate(df, {"v": "1 / (ADJUSTED_PRICE * 0)"}).collect()]
    assert all(x is None or math.isinf(x) for x in v)


def test_policy():
    with pytest.raises(ValueError):
        registry.shift(F.lit, -1)


@pytest.mark.parametrize("bad", ["__import__('os')", "ADJUSTED_PRICE.mean()", "ts_shift(ADJUSTED_PRICE, -1)", "lambda: 1", "rank(ADJUSTED_PRICE, 2)"])
def test_compiler_refuses(wild, bad):
    with pytest.raises(ValueError):
        compiler.evaluate(wild[0], {"v": bad})


METRICS = {"IC_mean": 0.03, "ICIR": 0.5, "Sharpe": 0.8, "deflated_sharpe": 0.7, "monotonicity": 0.5, "turnover": 0.4, "max_drawdown": -0.15}
CASES = [
    ({"IC_mean": 0.001, "Sharpe": 0.05, "ICIR": 0.01, "monotonicity": 0.0, "deflated_sharpe": 0.005}, "failed", "uncertain", True),
    ({"max_drawdown": -0.45}, "failed", "supported", True),
    ({"IC_mean": -0.04, "ICIR": -0.9, "Sharpe": -1.4, "deflated_sharpe": -1.2, "monotonicity": -0.7, "max_drawdown": -0.3}, "failed", "contradicted", False),
    ({"IC_mean": 0.06, "ICIR": 1.2, "Sharpe": 1.8, "deflated_sharpe": 1.5, "monotonicity": 0.9, "turnover": 0.2, "max_drawdown": -0.08}, "promising", "supported", False),
    ({"IC_mean": 0.03, "Sharpe": -0.6, "deflated_sharpe": -0.06}, None, "uncertain", False),
]


def test_scores(spark):
    rows = [dict(METRICS) | c | {"i": i, "complexity": 5, "similarity": 0.0} for i, (c, *_) in enumerate(CASES)]
    got = {r.i: r for r in sc.scored(spark.createDataFrame(pd.DataFrame(rows))).collect()}
    for i, (_, verdict, direction, fatal) in enumerate(CASES):
        assert verdict is None or got[i].verdict == verdict
        assert (got[i].direction_status, got[i].fatal) == (direction, fatal)
    assert got[2].predictive_magnitude > got[2].total and abs(got[3].predictive_magnitude - got[3].total) < 1e-9


def test_bandit(spark):
    priors = spark.createDataFrame([("e", 2.0, 1.0)], "arm_id string, alpha double, beta double")
    for r, a, b in ((0.7, 2.7, 1.3), (1.7, 3.0, 1.0), (0.6, 2.6, 1.4)):
        x = me.replay(spark.createDataFrame([("e", r)], "arm_id string, reward double"), priors).first()
        assert (round(x.alpha, 9), round(x.beta, 9)) == (a, b)
    assert me.choose({"p": (5.0, 1.0)}, 2) == me.EXPLORE
    rng = random.Random(0)
    assert sum(me.choose({"p": (90.0, 10.0)}, 9, rng) == "p" for _ in range(200)) > 150


def test_mutation_rules():
    assert me.mutate("rank(ADJUSTED_PRICE)", {"turnover": 0.8})[0] == "rank(ADJUSTED_PRICE)"
    assert me.mutate("rank(ADJUSTED_VOLUME)", {"turnover": 0.2, "Sharpe": 0.1})[0] != "rank(ADJUSTED_VOLUME)"


def test_plan_falls_back_and_filters():
    found = me.plan(set(), 3, lambda f: "shift" in f, lambda p: "not json")
    assert len(found) == 3 and all("shift" not in s["formula"] for s in found)
    assert me.plan(set(), 1, answer=lambda p: '```json\n[{"formula": "rank(CFO_LTM)"}]\n```')[0]["formula"] == "rank(CFO_LTM)"


def test_store_and_lineage(spark, tmp_path):
    store = me.Store(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([("a", 1.0)], "alpha_id string, score double"), 1)
    store.upsert(spark.createDataFrame([("a", 2.0, "x"), ("b", 3.0, "y")], "alpha_id string, score double, more string"), 2)
    assert sorted((r.alpha_id, r.score) for r in store.load().collect()) == [("a", 2.0), ("b", 3.0)]
    e = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "b", 3), ("d", "c", 0)], "alpha_id string, parent_id string, timestamp int")
    edge = me.edges(e)
    assert sorted((r.parent, r.child) for r in edge.collect()) == [("a", "b"), ("b", "c")]
    assert {r.alpha_id for r in me.ancestors(edge, e.where("alpha_id = 'c'").select("alpha_id")).collect()} == {"a", "b", "c"}
    ringed = me.layout(me.rings(e.withColumn("batch_id", F.lit(None).cast("string"))))
    me.export_html(ringed, edge, str(tmp_path / "g.html"))
    assert "<svg" in (tmp_path / "g.html").read_text()
