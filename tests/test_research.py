"""Validation, similarity, planning, placebo and sources beyond what the SQL of the queries shows."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import queries
from panelforge.functions import formulas
from panelforge.operators import backtest as bt
from panelforge.operators import memory as me
from panelforge.plans import compiler
from panelforge.queries_research import FORMULAS, STARTS
from panelforge.sources import loader
from panelforge.sources import panel as src

BASE = {"alpha_id": "a", "formula": "rank(CFO_LTM)", "features": [], "universe": "sp500", "start_date": "2021-01-01", "end_date": "2026-06-01"}


def test_validation_of_one_and_of_a_table_agree(spark):
    cases = [BASE | {"formula": f, "start_date": s, "universe": u} for f, s, u in itertools.product([*FORMULAS, None], STARTS, ("sp500", "x"))]
    cases += [BASE | {"features": ["DA_LTM", "QUALITY"]}, BASE | {"end_date": None}]
    table = spark.createDataFrame([(i, c["formula"], c["features"], c["universe"], c["start_date"], c["end_date"]) for i, c in enumerate(cases)], "alpha_id int, formula string, features array<string>, universe string, start_date string, end_date string")
    got = {r.alpha_id: r for r in formulas.checked(table).collect()}
    for i, c in enumerate(cases):
        errors, warnings = formulas.validate(c)
        assert (len(got[i].errors), len(got[i].warnings)) == (len(errors), len(warnings)), (c, errors, got[i].errors)
        assert got[i].valid == (not errors)


def test_validation_messages():
    assert formulas.validate({"alpha_id": "a"})[0] == [f"missing key: {k}" for k in ("formula", "universe", "start_date", "end_date")]
    assert formulas.validate(BASE | {"formula": "rank(ASSETS_LTM) + CFO_LTM"})[0] == ["ASSETS_LTM is not a data column"]
    assert "ts_std" in formulas.validate(BASE | {"formula": "ts_stddev(CFO_LTM, 5)"})[0][0]
    errors, warnings = formulas.validate(BASE | {"features": ["DA_LTM"]})
    assert not errors and "DA_LTM" in warnings[0]
    assert formulas.validate(BASE | {"start_date": "2026-06-01"})[0] == ["start_date must come before end_date"]


def brute_shape(formula):
    """Nodes and edges counted by recursion from their definition."""
    import ast
    from collections import Counter

    def label(n):
        if isinstance(n, ast.Name):
            return ("name", n.id)
        if isinstance(n, ast.Constant):
            return ("const", repr(n.value))
        if isinstance(n, ast.Call):
            return ("call", getattr(n.func, "id", "." + getattr(n.func, "attr", "?")))
        if isinstance(n, ast.Attribute):
            return ("attribute", n.attr)
        if isinstance(n, ast.BinOp | ast.UnaryOp):
            return (type(n).__name__, type(n.op).__name__)
        return (type(n).__name__,)

    out = Counter()

    def visit(n):
        out[label(n)] += 1
        for field, value in ast.iter_fields(n):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    free = isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add | ast.Mult) and field in ("left", "right")
                    out[label(n), "any" if free else field, label(child)] += 1
                    visit(child)

    visit(formulas.unsigned(ast.parse(formula, mode="eval").body))
    return out


def test_structural_similarity_equals_brute_force():
    rng = random.Random(3)

    def made(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(["CFO_LTM", "DA_LTM", "ADJUSTED_PRICE", "2", "20"])
        return rng.choice(["rank({})", "ts_mean({}, 20)", "({} + {})", "({} / {})", "({} * {})", "-{}", "({}).shift(2)", "np.log({})"]).format(*[made(depth - 1) for _ in range(2)])

    for _ in range(200):
        a, b = made(3), made(3)
        x, y = brute_shape(a), brute_shape(b)
        want = sum((x & y).values()) / sum((x | y).values())
        assert abs(formulas.structural(a, b) - want) < 1e-12, (a, b)


def test_placebo_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(pd.Timestamp("2024-01-31") + pd.offsets.MonthEnd(m), t, "S", float(rng.integers(0, 9)), float(rng.normal())) for m in range(4) for t in range(4 if m == 3 else 30)]
    df = pd.DataFrame(rows, columns=["date", "ticker", "sector", "signal", "fwd"])
    pairs = spark.createDataFrame(df).withColumn("date", __import__("pyspark.sql.functions", fromlist=["x"]).to_date("date"))
    noise, ics = [], []
    for date, g in df.groupby("date"):
        x, y = g["signal"].rank().to_numpy(), g["fwd"].rank().to_numpy()
        ics.append(np.corrcoef(x, y)[0, 1])
        if len(g) >= 5:
            draw = np.random.default_rng([42, date.toordinal()])
            noise.append(np.mean([abs(np.corrcoef(x[draw.permutation(len(x))], y)[0, 1]) for _ in range(100)]))
    want = min(1.0, max(0.0, 1 - np.mean(noise) / (abs(np.mean(ics)) + 1e-9)))
    assert abs(bt.placebo(pairs.repartition(3)).first()[0] - want) < 1e-9
    assert abs(bt.placebo(pairs, mean_ic=0.5).first()[0] - (1 - np.mean(noise) / 0.5)) < 1e-6


def test_turnover_equals_sets(spark):
    rng = np.random.default_rng(8)
    rows = [(pd.Timestamp(f"2024-{m:02d}-28").date(), t, "S", float(rng.integers(0, 6)), 0.0) for m in range(1, 7) for t in rng.choice(40, 25, replace=False).tolist()]
    pairs = spark.createDataFrame(rows, "date date, ticker int, sector string, signal double, fwd double")
    held = {}
    for r in bt.binned(pairs).collect():
        held.setdefault(r.date, ({*()}, {*()}))
        if r.bin == r.k:
            held[r.date][0].add(r.ticker)
        if r.bin == 1:
            held[r.date][1].add(r.ticker)
    dates = sorted(held)
    want = {(b, side): 1 - len(held[a][i] & held[b][i]) / len(held[a][i]) for a, b in itertools.pairwise(dates) for i, side in enumerate(("top", "bottom")) if held[a][i]}
    got = {(r.date, r.side): r.replaced for r in bt.turnover(pairs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ancestors_of_long_and_shared_lineages(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(40)] + [(f"x{i}", "39") for i in range(5)] + [("loop", "loop")]
    e = spark.createDataFrame(chain, "alpha_id string, parent_id string").coalesce(2)
    got = [r.alpha_id for r in me.ancestors(me.parents(e), e.where("alpha_id like 'x%' or alpha_id = 'loop'").select("alpha_id")).collect()]
    assert sorted(got) == sorted([str(i) for i in range(40)] + [f"x{i}" for i in range(5)] + ["loop"])


def test_page_holds_ids_as_text(spark, tmp_path):
    nodes = spark.createDataFrame([("</script><b>x", 0, 1.0, 2.0), ("a&b", 1, 0.0, 0.0)], "alpha_id string, ring int, x double, y double")
    edge = spark.createDataFrame([("</script><b>x", "a&b"), ("a&b", "gone")], "parent string, child string")
    me.export_html(nodes, edge, str(tmp_path / "p.html"))
    text = (tmp_path / "p.html").read_text()
    assert "<b>" not in text and "innerHTML" not in text
    data = me.read_html(text)
    assert {n["alpha_id"] for n in data["nodes"]} == {"</script><b>x", "a&b"} and data["edges"] == [["</script><b>x", "a&b"]]


def test_children_that_repeat_their_parent_are_errors():
    parent = {"alpha_id": "p", "formula": "rank(ADJUSTED_PRICE)"}
    with pytest.raises(ValueError, match="duplicate of p"):
        me.child_of(parent, {"turnover": 0.8}, lambda f: "p" if f == parent["formula"] else None)
    child = me.child_of({"alpha_id": "q", "formula": "rank(ADJUSTED_VOLUME)"}, {"turnover": 0.2, "Sharpe": 0.1}, lambda f: None)
    assert child["parent_id"] == "q" and not formulas.validate(child)[0]
    quarterly = me.child_by_rule(parent | {"rebalance": "monthly"}, {"turnover": 0.8})
    assert quarterly["rebalance"] == "quarterly" and quarterly["formula"] == parent["formula"]


def test_metrics_refuse_few_periods(spark):
    pairs = spark.createDataFrame([], "date date, ticker int, sector string, signal double, fwd double")
    with pytest.raises(Exception, match="fewer than 3"):
        bt.metrics(pairs).collect()


def test_only_needed_columns_are_read(spark, tmp_path):
    rows = [(pd.Timestamp("2024-01-01").date(), t, 1.0 * t, 2.0, 3.0, "S") for t in range(5)]
    spark.createDataFrame(rows, "date date, ticker int, adjusted_price double, adjusted_volume double, revenue_ltm double, sector string").write.parquet(f"{tmp_path}/p")
    plan = compiler.evaluate(spark.read.parquet(f"{tmp_path}/p"), {"v": "rank(ADJUSTED_PRICE)"}).select("date", "v")._jdf.queryExecution().executedPlan().toString()
    assert "adjusted_price" in plan.split("ReadSchema")[1] and "revenue_ltm" not in plan.split("ReadSchema")[1] and "adjusted_volume" not in plan.split("ReadSchema")[1]


def test_statements_that_cannot_be_read_warn(spark):
    with pytest.warns(UserWarning, match="could not be read"):
        x = loader.statement_source(spark, lambda: 1 / 0, spark.createDataFrame([("A",)], "TICKER string"))
    assert x.columns == ["TICKER", "DATE"] and x.count() == 0
    with pytest.warns(UserWarning):
        assert loader.regime_source(lambda: 1 / 0) is None


def test_tickers_absent_from_the_universe_have_no_sector(spark):
    day = pd.Timestamp("2024-01-02").date()
    f = spark.createDataFrame([(day, 1, 5.0), (day, 2, 6.0)], "date date, ticker int, revenue_ltm double")
    p = spark.createDataFrame([(day, 1, 1.0, 1.0), (day, 1, 3.0, 1.0)], "date date, ticker int, adjusted_price double, adjusted_volume double")
    u = spark.createDataFrame([(1, "S")], "ticker int, sector string")
    got = {r.ticker: (r.sector, r.adjusted_price) for r in src.assemble(f, p, u).collect()}
    assert got == {1: ("S", 2.0), 2: (None, None)}


def test_names():
    assert src.sanitise("  Net Income/Starting Line (x)") == "NET_INCOME_STARTING_LINE_X"
    assert loader.cache_key("prices", "2021-01-01", "2022-01-01") == __import__("hashlib").sha256(b"prices|2021-01-01|2022-01-01").hexdigest()[:16]
    assert math.isclose(formulas.set_jaccard({1, 2}, {2, 3}), 1 / 3)


def test_a_lineage_of_two_thousand_generations_takes_a_dozen_rounds(spark, monkeypatch):
    rounds = []
    keep = me.kept
    monkeypatch.setattr(me, "kept", lambda df, at: (rounds.append(at), keep(df, at))[1])
    edge = spark.range(1, 2001).selectExpr("cast(id as string) as child", "cast(id - 1 as string) as parent")
    found = me.ancestors(edge, spark.createDataFrame([("2000",), ("7",), ("unknown",)], "alpha_id string"))
    assert found.count() == 2002
    assert sum("found" in at for at in rounds) <= 1 + 12


def test_exact_placebo_equals_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(6)
    rows = [(pd.Timestamp("2024-01-31") + pd.offsets.MonthEnd(m), t, "S", float(rng.integers(0, 9)), float(rng.normal())) for m in range(4) for t in range(4 if m == 3 else 25)]
    df = pd.DataFrame(rows, columns=["date", "ticker", "sector", "signal", "fwd"])
    pairs = spark.createDataFrame(df).withColumn("date", __import__("pyspark.sql.functions", fromlist=["x"]).to_date("date"))
    noise, ics = [], []
    for date, g in df.groupby("date"):
        g = g.sort_values("ticker")
        x, y = g["signal"].rank().to_numpy(), g["fwd"].rank().to_numpy()
        ics.append(np.corrcoef(x, y)[0, 1])
        if len(g) >= 5:
            orders = [sorted(range(len(g)), key=lambda i: hashlib.md5(f"42:{s}:{date:%Y-%m-%d}:{g['ticker'].iloc[i]}".encode()).hexdigest()) for s in range(1, 21)]
            noise.append(np.mean([abs(np.corrcoef(x[o], y)[0, 1]) for o in orders]))
    want = min(1.0, max(0.0, 1 - np.mean(noise) / (abs(np.mean(ics)) + 1e-9)))
    assert bt.placebo_exact(pairs.repartition(3), shuffles=20).first()[0] == pytest.approx(want, abs=1e-9)


def test_scores_at_a_gate_equal_the_sql(spark, tmp_path):
    """Keys whose total or weakest part hangs on a score's last digit."""
    keys = [678743, 91119, 350903, 227321, 205653, 390578, 130295]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    for name in ("sc11_direction", "sc14_weakest"):
        df = queries.queries()[name](spark, str(tmp_path))
        found = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall()), name


def test_equal_formulas_are_parsed_once(spark, tmp_path):
    """The parser's work follows the distinct formulas, not the rows; nulls and copies keep their rows."""
    store = spark.createDataFrame([(i, [None, "rank(CFO_LTM)", "rank(CFO_LTM", "-rank(DA_LTM)"][i % 4], ["A"], i) for i in range(400)], "alpha_id long, formula string, features array<string>, timestamp long")
    seen = spark.sparkContext.accumulator(0)
    whole = formulas.complexity

    def counted(f):
        seen.add(1)
        return whole(f)

    formulas.complexity = counted
    try:
        got = formulas.described(store).select("alpha_id", "canonical", "complexity").collect()
    finally:
        formulas.complexity = whole
    assert len(got) == 400 and seen.value <= 8
    assert all(r.canonical == formulas.canonical(store_f or "") and r.complexity == whole(store_f or "") for r in got for store_f in [[None, "rank(CFO_LTM)", "rank(CFO_LTM", "-rank(DA_LTM)"][r.alpha_id % 4]])


def test_most_similar_on_ties_of_time_is_the_smallest_id(spark):
    """Also where records with and without features reach the same mean, which sums in two orders."""
    store = spark.createDataFrame([(i, "rank(CFO_LTM)", [[], ["A", "B"]][i % 2], 7) for i in (9, 5, 4, 3, 8)], "alpha_id long, formula string, features array<string>, timestamp long").coalesce(1)
    r = formulas.most_similar(formulas.search(store, "rank(CFO_LTM)", ["A", "B"])).first()
    assert (r.most_similar_id, r.similarity_score, r.is_exact_duplicate) == (3, 1.0, True)
    r = formulas.most_similar(formulas.search(store, "rank(CFO_LTM)", ["A", "B"]).withColumns({"exact": F.lit(False), "structural": F.lit(0.5)})).first()
    assert (r.most_similar_id, r.is_unique) == (3, True)
