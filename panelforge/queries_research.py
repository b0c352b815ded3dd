"""Queries of validation, similarity, the experiment store, the bandit, planning and reflection, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import ast
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import formulas
from panelforge.functions.registry import OPERATORS
from panelforge.functions.tables import once_each, shared_folder
from panelforge.operators import backtest as bt
from panelforge.operators import memory as me
from panelforge.operators import similarity
from panelforge.queries import ALL, BINS, CALENDAR, CS, EXPERIMENTS, FORWARD, IC, PAIRS, PANEL, PER, WT, Run, experiments, r6, zscore
from panelforge.sources import panel as src


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(quoted(x) for x in xs) + "]"


# validation: configurations made from part keys

FORMULAS = [
    "rank(ADJUSTED_PRICE)",
    "rank(CFO_LTM / REVENUE_LTM) * -1",
    "rank(ASSETS_LTM) + rank(CFO_LTM)",
    "rank(CFO_LTM",
    "rank(CFO_LTM))(",
    "rank(rank(rank(rank(rank(rank(CFO_LTM))))))",
    "((((((rank(CFO_LTM)))))",
    "ts_stddev(CFO_LTM, 5)",
    "1 + 2",
    "  ",
    "zscore(DA_LTM) - tsrank(COGS_LTM, 3) + foo_Bar",
    "CFO_LTM.rolling(20).mean() + np.log(DA_LTM) + xy",
    "where(ADJUSTED_VOLUME > 0, Foo_x, BOOK_VALUE)",
]
STARTS = ["2021-01-01", "2026-06-01", "01/02/2021", "2021-13-01", "2021-1-5"]
FEATURES = [["CFO_LTM", "QUALITY"], ["ADJUSTED_PRICE"], [], ["DA_LTM", "REVENUE_LTM"]]


def configs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]).cast("array<string>") for x in xs]), (i % len(xs) + 1).cast("int"))
    return src.table(s, d, "part").select(
        k.alias("alpha_id"),
        F.when(k % 17 != 0, pick(FORMULAS, k)).alias("formula"),
        pick(FEATURES, F.floor(k / 3)).alias("features"),
        F.when(k % 19 != 0, F.when(k % 7 == 0, "nasdaq").otherwise("sp500")).alias("universe"),
        pick(STARTS, F.floor(k / 11)).alias("start_date"),
        F.when(k % 23 != 0, F.lit("2026-06-01")).alias("end_date"),
    )


#: The same configurations and their checks, written from the rules on their own.
CONFIGS = f"""with cf as (select p_partkey as alpha_id, case when p_partkey % 17 <> 0 then {listed(FORMULAS)}[p_partkey % {len(FORMULAS)} + 1] end as formula,
    [{", ".join(listed(x) + "::varchar[]" for x in FEATURES)}][(p_partkey // 3) % {len(FEATURES)} + 1] as features, case when p_partkey % 19 <> 0 then case when p_partkey % 7 = 0 then 'nasdaq' else 'sp500' end end as universe,
    {listed(STARTS)}[(p_partkey // 11) % {len(STARTS)} + 1] as start_date, case when p_partkey % 23 <> 0 then '2026-06-01' end as end_date from part),
depths as (select formula, list_transform(range(1, length(formula) + 1), lambda i: length(replace(substr(formula, 1, i), ')', '')) - length(replace(substr(formula, 1, i), '(', ''))) as h from (select distinct formula from cf where formula is not null)),
fx as (select formula, list_aggregate(h, 'min') < 0 as early, h[-1] > 0 as opened, list_aggregate(h, 'max') > {formulas.MAX_DEPTH} as deep, list_sort(list_distinct(regexp_extract_all(formula, '[A-Za-z_][A-Za-z0-9_]*'))) as words from depths),
fy as (select *, list_filter(words, lambda w: not list_contains({listed(sorted(set(formulas.RAW_COLUMNS) | set(OPERATORS) | formulas.INLINE))}, w)) as strange, len(list_intersect(words, {listed(formulas.RAW_COLUMNS)})) = 0 as bare from fx),
fz as (select *, list_filter(strange, lambda w: w = upper(w) and w <> lower(w) and contains(w, '_')) as cols,
    list_filter(strange, lambda w: not (w = upper(w) and w <> lower(w) and contains(w, '_')) and ((w = lower(w) and w <> upper(w)) or contains(w, '_')) and not regexp_matches(w, '^[A-Z]') and length(w) > 2) as ops from fy),
ck as (select cf.*, early, opened, deep, bare, cols, ops, words, trim(cf.formula) = '' as blank, cf.formula is null or universe is null or end_date is null as lacks,
    coalesce(try_strptime(start_date, '%Y-%m-%d') is null, true) as undated, try_strptime(start_date, '%Y-%m-%d') >= try_strptime(end_date, '%Y-%m-%d') as late from cf left join fz on fz.formula = cf.formula)"""


def _checked(*columns: str):
    return lambda s, d: _kinds(formulas.checked(configs(s, d)), columns)


def _kinds(x: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    has = lambda kind: F.exists("errors", lambda e: e.startswith(kind))
    named = lambda kind: F.array_join(F.transform(F.filter("errors", lambda e: e.startswith(kind)), lambda e: F.replace(e, F.lit(kind), F.lit(""))), ",")
    every = {
        "missing": named("missing:"),
        "valid": F.col("valid"),
        "closes_early": has("closes_early"),
        "stays_open": has("stays_open"),
        "too_deep": has("too_deep"),
        "empty": has("empty"),
        "no_column": has("no_column"),
        "columns": named("column:"),
        "operators": named("operator:"),
        "unused": F.array_join(F.transform("warnings", lambda e: F.replace(e, F.lit("unused:"), F.lit(""))), ","),
        "universe_error": has("universe"),
        "date_format": has("date_format"),
        "date_order": has("date_order"),
    }
    return x.select("alpha_id", *[every[c].alias(c) for c in columns])


_TEXT = "not lacks and not blank"
_NAMES = "not lacks and not blank and not early and not opened and not deep"
CHECKS = {
    "missing": "concat_ws(',', case when formula is null then 'formula' end, case when universe is null then 'universe' end, case when end_date is null then 'end_date' end)",
    "closes_early": f"coalesce({_TEXT} and early, false)",
    "stays_open": f"coalesce({_TEXT} and not early and opened, false)",
    "too_deep": f"coalesce({_TEXT} and not early and deep, false)",
    "empty": "coalesce(not lacks and blank, false)",
    "no_column": f"coalesce({_NAMES} and bare, false)",
    "columns": f"case when {_NAMES} then array_to_string(cols, ',') else '' end",
    "operators": f"case when {_NAMES} then array_to_string(ops, ',') else '' end",
    "unused": f"case when not lacks then array_to_string(list_sort(list_filter(features, lambda f: list_contains({listed(formulas.RAW_COLUMNS)}, f) and not list_contains(words, f))), ',') else '' end",
    "universe_error": "coalesce(not lacks and universe <> 'sp500', false)",
    "date_format": "coalesce(not lacks and undated, false)",
    "date_order": "coalesce(not lacks and not undated and late, false)",
}
CHECKS["valid"] = "not lacks and not (" + " or ".join(CHECKS[k] for k in ("closes_early", "stays_open", "too_deep", "empty", "no_column", "universe_error", "date_format", "date_order")) + f") and {CHECKS['columns']} = '' and {CHECKS['operators']} = ''"


def checks_sql(*columns: str) -> str:
    return f"{CONFIGS} select alpha_id, " + ", ".join(f"{CHECKS[c]} as {c}" for c in columns) + " from ck"


# similarity: stores whose shapes can be counted by hand

COLUMNS = ["CFO_LTM", "REVENUE_LTM", "DA_LTM", "COGS_LTM", "ADJUSTED_PRICE"]
SIGNS = ["{0}", "-({0})", "-1 * ({0})", "({0}) * -1", "-(-(-({0})))", "rank({0})", "({0}) * -2", "1 * ({0})"]
#: Pairs of formulas and their overlap, counted by hand from nodes and (parent, place, child) edges.
PAIRS_BY_HAND = [
    ("{0} + {1}", "{1} + {0}", "1.0"),
    ("{0} / {1}", "{1} / {0}", "9.0 / 13"),
    ("rank({0})", "rank({1})", "6.0 / 12"),
    ("ts_mean({0}, 20)", "ts_mean({0}, 60)", "9.0 / 13"),
    ("ts_mean({0}, 20)", "ts_mean(ts_mean({0}, 20), 20)", "11.0 / 19"),
    ("rank({0})", "-1 * rank({0})", "1.0"),
    ("rank({0}", "rank({1})", "1.0 / 3"),
    ("rank({0}", "rank({0})", "1.0"),
]


def _filled(templates: list[str], i: Column, a: Column, b: Column) -> Column:
    text = F.element_at(F.array(*[F.lit(t) for t in templates]), (i % len(templates) + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("{0}"), a), F.lit("{1}"), b)


def _two(k: Column) -> tuple[Column, Column]:
    """Two different columns for each key."""
    names, n = F.array(*[F.lit(c) for c in COLUMNS]), len(COLUMNS)
    first = k % n
    return F.element_at(names, (first + 1).cast("int")), F.element_at(names, ((first + 1 + F.floor(k / n) % (n - 1)) % n + 1).cast("int"))


TWO = f"{listed(COLUMNS)}[p_partkey % {len(COLUMNS)} + 1] as a, {listed(COLUMNS)}[(p_partkey % {len(COLUMNS)} + 1 + (p_partkey // {len(COLUMNS)}) % {len(COLUMNS) - 1}) % {len(COLUMNS)} + 1] as b"


def _sign_blind(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = _two(k)
    base = F.concat(F.lit("zscore("), a, F.lit(" / "), b, F.lit(")"))
    text = F.element_at(F.array(*[F.lit(t) for t in SIGNS]), (k % len(SIGNS) + 1).cast("int"))
    p = src.table(s, d, "part").select(k.alias("alpha_id"), base.alias("base"), F.replace(text, F.lit("{0}"), base).alias("formula"))
    x = formulas.described(p).select("alpha_id", "base", F.col("canonical").alias("signed"))
    return formulas.described(x, "base").select("alpha_id", (F.col("signed") == F.col("canonical")).alias("same"))


def _structural(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = _two(k)
    p = src.table(s, d, "part").select(k.alias("alpha_id"), _filled([x for x, _, _ in PAIRS_BY_HAND], k, a, b).alias("left"), _filled([y for _, y, _ in PAIRS_BY_HAND], k, a, b).alias("right"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({formulas.TOKEN})"), F.lit(1)))

    def compared(pairs: DataFrame) -> DataFrame:
        x = formulas.described(pairs, "left").select("left", "right", F.col("shape").alias("left_shape"))
        x = formulas.described(x, "right")
        similarity = F.coalesce(formulas.map_jaccard(F.col("left_shape"), F.col("shape")), formulas.array_jaccard(words(F.col("left")), words(F.col("right"))))
        return x.select("left", "right", F.round(similarity, 6).alias("similarity"))

    return once_each(p, ["left", "right"], compared).select("alpha_id", "_of.similarity")


STORE = ["rank({0})", "-1 * rank({0})", "rank({0} / {1})", "rank({0}"]


def _store(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = _two(F.floor(k / len(STORE)))
    tags = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"), F.lit("C"), F.lit("D")))
    return src.table(s, d, "part").select(k.alias("alpha_id"), _filled(STORE, k, a, b).alias("formula"), tags.alias("features"), ((k * 7919) % 1000003).alias("timestamp"))


def _search(s: SparkSession, d: str) -> DataFrame:
    x = formulas.search(_store(s, d), "rank(CFO_LTM)", ["A", "B"])
    return x.select("alpha_id", "exact", *r6("structural", "column_similarity", "feature_similarity", "combined"))


def found_sql(column: str) -> str:
    """The store's similarities to rank(column) with features A and B, counted by hand."""
    return f"""with st as (select p_partkey as alpha_id, p_partkey % 4 as i, p_partkey % 3 as t, (p_partkey * 7919) % 1000003 as timestamp, {TWO.replace('p_partkey', '(p_partkey // 4)')} from part),
s1 as (select *, a = '{column}' or (i = 2 and b = '{column}') as hit from st),
s2 as (select *, i < 2 and hit as exact, case when i < 2 then case when hit then 1.0 else 6.0 / 12 end when i = 2 then case when hit then 8.0 / 18 else 6.0 / 20 end else case when hit then 1.0 else 1.0 / 3 end end as structural,
    case when not hit then 0.0 when i = 2 then 0.5 else 1.0 end as column_similarity, case when t = 0 then 0.0 when t = 1 then 1.0 else 1.0 / 4 end as feature_similarity from s1),
s3 as (select *, case when t = 0 then (0.4 * structural + 0.2 * column_similarity) / 0.6 else 0.4 * feature_similarity + 0.4 * structural + 0.2 * column_similarity end as combined from s2)"""


def _most_similar(column: str):
    return lambda s, d: formulas.most_similar(formulas.search(_store(s, d), f"rank({column})", ["A", "B"]))


def most_sql(column: str) -> str:
    return f"""{found_sql(column)}, kept as (select * from s3), m as (select max(structural) as s, max(round(combined, 9)) as c, bool_or(exact) as e, (select alpha_id from kept order by structural desc, timestamp limit 1) as sid, (select alpha_id from kept order by round(combined, 9) desc, timestamp limit 1) as cid from kept)
select not (e or s >= 0.95) as is_unique, e as is_exact_duplicate, case when e or s >= 0.95 then sid else cid end as most_similar_id, round(c, 4) as similarity_score, round(s, 4) as structural_similarity,
case when e then 'the same as ' || sid || ' up to its sign' when s >= 0.95 then round(100 * s)::int || '% structural similarity to ' || sid || ', at or over 95%' else 'closest is ' || cid || ' at ' || round(100 * c)::int || '%, structural at most ' || round(100 * s)::int || '%' end as reason from m"""

#: Formulas with their calls and depth, counted by hand; their columns are counted by the SQL.
SIZES = [("rank({0}) * -1", 1, 2), ("{0}", 0, 0), ("rank(({0} + DA_LTM) / {1}) + rank(ADJUSTED_PRICE / ({1} / SHARES_DILUTED)) * -1", 2, 5), ("ts_mean(ts_mean({0}, 20), 5) > {1}", 2, 3), ("-{0}.rolling(20).mean()", 2, 3)]


def _complexity(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = _two(k)
    p = src.table(s, d, "part").select(k.alias("alpha_id"), _filled([*[x for x, _, _ in SIZES], "rank({0} + {1}"], k, a, b).alias("formula"))
    return formulas.described(p).select("alpha_id", F.col("complexity").cast("long").alias("complexity"))


COMPLEXITY = f"with p as (select p_partkey as alpha_id, p_partkey % {len(SIZES) + 1} as i, {TWO} from part), q as (select *, case i " + " ".join(f"when {i} then replace(replace({quoted(x)}, '{{0}}', a), '{{1}}', b)" for i, (x, _, _) in enumerate(SIZES)) + f" end as formula from p) select alpha_id, case when i = {len(SIZES)} then 3 // 2 else len(list_intersect(list_distinct(regexp_extract_all(formula, '[A-Za-z_][A-Za-z0-9_]*')), {listed(formulas.RAW_COLUMNS)})) + case i " + " ".join(f"when {i} then {c + h}" for i, (_, c, h) in enumerate(SIZES)) + " end end as complexity from q"

# the store's memory


def _legacy(s: SparkSession, d: str) -> DataFrame:
    """Records of which some were kept before scores, directions and fatal flags were."""
    k = F.col("alpha_id")
    x = experiments(s, d)
    return x.withColumns(
        {
            "predictive_magnitude": F.when(k % 3 != 1, F.col("predictive_magnitude")),
            "score": F.when(k % 6 != 1, F.col("score")),
            "direction_status": F.when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, "unknown").otherwise(F.col("direction_status")),
            "fatal": F.when(k % 5 != 0, F.col("fatal")),
        }
    )


def _effective(s: SparkSession, d: str) -> DataFrame:
    return _legacy(s, d).select("alpha_id", me.effective_score(me.rescored()).alias("effective")).select("alpha_id", *r6("effective"))


def _of_record(s: SparkSession, d: str) -> DataFrame:
    return _legacy(s, d).select("alpha_id", me.direction_of_record().alias("direction"), me.fatal_of_record().alias("fatal"))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    e = experiments(s, d)
    k = F.col("alpha_id")
    outcomes = e.select("alpha_id", F.when(k % 2 == 0, "mutate").otherwise("explore").alias("action"), "parent_id", F.when(k % 11 == 0, "duplicate").when(k % 13 == 0, "backtest_error").otherwise("completed").alias("status"), me.effective_score().alias("effective"))
    return me.rewards(outcomes, e).select("alpha_id", *r6("baseline", "reward"))


OUTCOMES = f"""{EXPERIMENTS}, tot as (select sum(predictive_magnitude) as s, count(*) as n from e),
o as (select c.alpha_id, c.predictive_magnitude as child, case when c.alpha_id % 11 = 0 or c.alpha_id % 13 = 0 then 'no' else 'completed' end as status, case when c.alpha_id % 2 = 0 and p.alpha_id is not null then p.predictive_magnitude else (s - c.predictive_magnitude) / (n - 1) end as baseline from e c cross join tot left join e p on p.alpha_id = c.parent_id)
select alpha_id, round(baseline, 6) + 0.0 as baseline, round(case when status = 'completed' then greatest(least(0.5 + (child - baseline) / 50, 1.0), 0.0) else 0.0 end, 6) + 0.0 as reward from o"""


def _thompson(s: SparkSession, d: str) -> DataFrame:
    """Which arm wins: exploration while there are few experiments, else the draw; posteriors here leave no doubt."""
    sure = {"good": (1e9, 1.0), "bad": (1.0, 1e9)}
    out = []
    for n in range(6):
        out.append((n, me.choose(sure, n, random.Random(n)), me.choose({"bad": (1.0, 1e9)}, n, random.Random(n)), me.choose({}, n)))
    return s.createDataFrame(out, "experiments long, with_good string, with_bad string, without string")


def _observations(s: SparkSession, d: str) -> DataFrame:
    e = experiments(s, d)
    return me.observations(e, [f"F{i}" for i in range(25)])


OBSERVATIONS = f"""{EXPERIMENTS}, f as (select category, count(*) as n from cat where category is not null group by category order by n desc, category limit 1),
u as (select list_sort(list('F' || i)) as l from range(25) t(i) where 'F' || i not in (select unnest(features) from e))
select 'failure' as kind, category || ': ' || n || ' of ' || t || ' (' || (100 * n // t) || '%)' as text from f, (select count(*) as t from e where verdict in ('failed', 'revise'))
union all select 'best', printf('%.1f', round(predictive_magnitude + 1e-9, 1)) || ': ' || alpha_id || ', Sharpe ' || printf('%.3f', round(Sharpe + 1e-9, 3)) from (select * from e where verdict = 'promising' order by predictive_magnitude desc, timestamp limit 1)
union all select 'unexplored', array_to_string(l[1:5], ', ') || ' and ' || (len(l) - 5) || ' more' from u"""


def _detail(s: SparkSession, d: str) -> DataFrame:
    k = F.col("alpha_id")
    sectors = F.map_from_arrays(F.array(*[F.lit(f"S{i}") for i in range(6)]), F.array(*[((k * (7 + 2 * i)) % 101 - 50) / F.lit(1000.0) + F.lit(i * 1e-6) for i in range(6)]))
    x = me.node_detail(experiments(s, d).withColumn("sector_ic", sectors))
    names = [*me.WARN, "turnover"]
    return x.select("alpha_id", *[F.element_at("warnings", n).alias(n) for n in names], F.array_join(F.transform("top_sectors", lambda t: t["sector"]), ",").alias("sectors"))


def _level(c: str) -> str:
    soft, hard = me.WARN[c]
    return f"case {f'when {c} <= {hard} then {quoted('bad')} ' if hard is not None else ''}when {c} <= {soft} then 'warn' else '' end as {c}"


DETAIL = f"""{EXPERIMENTS}, sx as (select alpha_id, i, ((alpha_id * (7 + 2 * i)) % 101 - 50) / 1000.0::double + i * 1e-6 as ic from e, range(6) t(i)), sr as (select *, row_number() over (partition by alpha_id order by abs(ic) desc, i) as nr from sx), st as (select alpha_id, string_agg('S' || i, ',' order by nr) as sectors from sr where nr <= 4 group by alpha_id)
select e.alpha_id, {", ".join(_level(c) for c in me.WARN)}, case when turnover >= 0.7 then 'warn' else '' end as turnover, sectors from e join st on st.alpha_id = e.alpha_id"""


def _graph(s: SparkSession, d: str) -> DataFrame:
    """The page of the 200 best experiments, written and read again."""
    e = experiments(s, d)
    nodes = me.layout(me.rings(me.top_n(e, 200)))
    at = f"{shared_folder(s, 'graph')}/graph.html"
    me.export_html(nodes, me.edges(e), at)
    data = me.read_html("\n".join(r.value for r in s.read.text(at).collect()))  # one page of at most 5,000 nodes
    n_edges = len(data["edges"])
    return s.createDataFrame([(x["alpha_id"], x["ring"], round(x["x"], 4) + 0.0, round(x["y"], 4) + 0.0, n_edges) for x in data["nodes"]], "alpha_id long, ring long, x double, y double, edges long")


GRAPH = f"""{EXPERIMENTS}, top as (select * from e order by predictive_magnitude desc, timestamp limit 200), rn as (select alpha_id, timestamp, case when batch_id is null then 0 else dense_rank() over (partition by batch_id is null order by batch_id) - 1 end as ring from top),
ly as (select alpha_id, ring, 2 * 3.141592653589793 * (row_number() over (partition by ring order by timestamp, alpha_id) - 1) / count(*) over (partition by ring) as angle from rn)
select alpha_id, ring, round((100 + 160 * ring) * cos(angle), 4) + 0.0 as x, round((100 + 160 * ring) * sin(angle), 4) + 0.0 as y, (select count(*) from ed where parent in (select alpha_id from top) and child in (select alpha_id from top)) as edges from ly"""

# planning, mutation, reflection


def _fallback(s: SparkSession, d: str) -> DataFrame:
    """Places filled: by ideas alone, by ideas once tried features go last, beside a model's answer, and without duplicates."""
    answer = '```json\n[{"direction": "cash", "formula": "rank(CFO_LTM)", "features": ["CFO"]}, {"direction": "bad", "formula": "rank(ASSETS_LTM)"}]\n```'
    cases = [
        me.plan(set(), 3),
        me.plan({"PRICE_TO_SALES", "VOL_20D"}, 3),
        me.plan(set(), 3, answer=lambda p: answer),
        me.plan(set(), 3, lambda f: "SHARES_DILUTED" in f, lambda p: "no json"),
        me.plan(set(), 1, lambda f: f == "rank(CFO_LTM)", lambda p: answer),
    ]
    return s.createDataFrame([(i, k, x["direction"]) for i, c in enumerate(cases) for k, x in enumerate(c)], "scenario long, place long, direction string")


FALLBACK = "select * from (values (0, 0, 'value screen'), (0, 1, 'quality + value'), (0, 2, 'earnings growth momentum'), (1, 0, 'earnings growth momentum'), (1, 1, 'liquidity + momentum'), (1, 2, 'value screen'), (2, 0, 'cash'), (2, 1, 'value screen'), (2, 2, 'quality + value'), (3, 0, 'earnings growth momentum'), (3, 1, 'low volatility'), (3, 2, 'liquidity + momentum'), (4, 0, 'value screen')) t(scenario, place, direction)"


def _as_configs(s: SparkSession, d: str) -> DataFrame:
    base = {"start_date": "2020-01-01", "universe": "sp500", "transaction_cost_bps": 7}
    rows = [me.as_config({"direction": i[0], "formula": i[1], "features": i[2], "parent_id": None}, f"a{k}", "b1", base if k % 2 else None) for k, i in enumerate(me.IDEAS)]
    rows += [me.as_config({"direction": "own", "hypothesis": "h", "formula": "rank(CFO_LTM)", "features": [], "parent_id": "a0"}, "a9", None)]
    return s.createDataFrame([(r["alpha_id"], r["parent_id"], r["batch_id"], r["hypothesis"], r["mutation"], r["start_date"], r["end_date"], r["rebalance"], r["neutralization"], r["transaction_cost_bps"], r["holding_period_days"], len(formulas.validate(r)[0])) for r in rows], "alpha_id string, parent_id string, batch_id string, hypothesis string, mutation string, start_date string, end_date string, rebalance string, neutralization string, cost long, days long, errors long")


AS_CONFIGS = "select alpha_id, parent_id, batch_id, hypothesis, 'planned: ' || direction as mutation, start_date, '2026-06-01' as end_date, 'monthly' as rebalance, 'sector' as neutralization, cost, 20 as days, 0 as errors from (values ('a0', null, 'b1', '', 'value screen', '2021-01-01', 5), ('a1', null, 'b1', '', 'quality + value', '2020-01-01', 7), ('a2', null, 'b1', '', 'earnings growth momentum', '2021-01-01', 5), ('a3', null, 'b1', '', 'low volatility', '2020-01-01', 7), ('a4', null, 'b1', '', 'liquidity + momentum', '2021-01-01', 5), ('a9', 'a0', null, 'h', 'own', '2021-01-01', 5)) t(alpha_id, parent_id, batch_id, hypothesis, direction, start_date, cost)"


def _parsed(s: SparkSession, d: str) -> DataFrame:
    """What is left of answers: fenced or not, with broken items, and answers that are no list."""
    answers = ['[{"formula": "rank(CFO_LTM)"}]', '```json\n[{"formula": "rank(CFO_LTM)"}, {"formula": "rank(CFO_LTM"}, {"direction": "x"}, 3]\n```', '```\n[]\n```', '{"formula": "rank(CFO_LTM)"}', "no json", '[{"formula": "ts_stddev(CFO_LTM, 3)"}, {"formula": "rank(DA_LTM)", "parent_id": "p"}]']
    out = []
    for i, a in enumerate(answers):
        try:
            out.append((i, ",".join(x["formula"] for x in me.parse_plan(a)), True))
        except ValueError:
            out.append((i, None, False))
    prompt = me.plan_prompt({"total": 3}, 2, ["rank(CFO_LTM)"])
    out.append((9, "prompt", all(x in prompt for x in ("total: 3", "- rank(CFO_LTM)", "ts_mean", "CFO_LTM", "2 objects"))))
    return s.createDataFrame(out, "i long, formulas string, ok boolean")


PARSED = "select * from (values (0, 'rank(CFO_LTM)', true), (1, 'rank(CFO_LTM)', true), (2, '', true), (3, null, false), (4, null, false), (5, 'rank(DA_LTM)', true), (9, 'prompt', true)) t(i, formulas, ok)"
PARENTS = ["rank(ADJUSTED_PRICE)", "rank(NET_INCOME_LTM)", "rank(ADJUSTED_PRICE.shift(20))", "rank(ADJUSTED_PRICE.shift(20) * OPERATING_INCOME_LTM)"]


def _mutated(s: SparkSession, d: str) -> DataFrame:
    k = F.col("alpha_id")
    x = experiments(s, d).withColumns({"formula": F.element_at(F.array(*[F.lit(f) for f in PARENTS]), (k % len(PARENTS) + 1).cast("int")), "rebalance": F.when(k % 9 != 0, "weekly")})
    return me.mutated(x).select("alpha_id", "child_formula", "child_rebalance", "change")


MUTATED = f"""{EXPERIMENTS}, p as (select *, {listed(PARENTS)}[alpha_id % {len(PARENTS)} + 1] as f, case when alpha_id % 9 <> 0 then 'weekly' else 'monthly' end as own from e), q as (select *, contains(f, 'OPERATING_INCOME_LTM') or contains(f, 'NET_INCOME_LTM') as quality from p),
r as (select *, case when turnover > 0.7 then 'quarterly rebalance' when Sharpe < 0.3 and not quality then 'quality overlay' when ICIR < 0.2 then 'volatility damper' when contains(f, 'shift') and contains(f, 'ADJUSTED_PRICE') and not quality then 'quality beside momentum' else 'liquidity weight' end as change from q)
select alpha_id, case change when 'quarterly rebalance' then f when 'volatility damper' then '(' || f || ') * (1 - rank(ADJUSTED_PRICE.pct_change().rolling(20).std()))' when 'liquidity weight' then '(' || f || ') * rank(ADJUSTED_VOLUME * ADJUSTED_PRICE)' else '(' || f || ') + 0.3 * rank((OPERATING_INCOME_LTM + DA_LTM) / REVENUE_LTM)' end as child_formula, case when change = 'quarterly rebalance' then 'quarterly' else own end as child_rebalance, change from r"""


def _asked(s: SparkSession, d: str) -> DataFrame:
    """A model that is asked up to three times: for each script of answers the child, or why there is none, and how often it was asked."""
    good, bad, same = '{"formula": "rank(DA_LTM)"}', '{"formula": "rank(DA_LTM"}', '{"formula": "rank(CFO_LTM)"}'
    parent = {"alpha_id": "p", "formula": "rank(CFO_LTM)", "features": ["CFO_LTM"]}
    out = []
    for i, script in enumerate([[good], [bad, good], [same, "no json", good], [bad, bad, bad, good], ["[]", same, bad]]):
        asked: list[int] = []

        def answer(said, script=script, asked=asked):
            asked.append(len(said))
            return script[len(asked) - 1]

        other = lambda f: "p" if f == "rank(CFO_LTM)" else None
        try:
            child = me.mutate_with(answer, parent, {}, other)["formula"]
        except ValueError:
            child = None
        asked_once = len(asked)
        asked.clear()
        whole = me.child_of(parent, {"turnover": 0.1, "Sharpe": 0.1}, other, answer)
        out.append((i, child, asked_once, whole["mutation"] if child is None else whole["alpha_id"]))
    return s.createDataFrame(out, "script long, child string, asked long, whole string")


ASKED = "select * from (values (0, 'rank(DA_LTM)', 1, 'p_mut'), (1, 'rank(DA_LTM)', 2, 'p_mut'), (2, 'rank(DA_LTM)', 3, 'p_mut'), (3, null, 3, 'quality overlay'), (4, null, 3, 'quality overlay')) t(script, child, asked, whole)"
TAGS = [["MOM6_1"], ["EBITDA_MARGIN", "MOM12_1"], ["EPS_GROWTH"], ["EPS_LTM"], ["VOL_20D"]]


def _noted(s: SparkSession, d: str) -> DataFrame:
    k = F.col("alpha_id")
    return experiments(s, d).withColumns(
        {
            "features": F.element_at(F.array(*[F.array(*[F.lit(x) for x in t]) for t in TAGS]), (k % len(TAGS) + 1).cast("int")),
            "sector_ic": F.when(k % 7 == 0, F.create_map(F.lit("S0"), F.lit(-0.01), F.lit("S1"), F.col("IC_mean"))).otherwise(F.create_map().cast("map<string,double>")),
        }
    )


def _reflected(s: SparkSession, d: str) -> DataFrame:
    x = me.reflected(_noted(s, d)).withColumn("lines", F.split("reflection", "\n"))
    return x.select("alpha_id", F.size("lines").cast("long").alias("n"), *[F.element_at("lines", i).alias(name) for i, name in ((2, "observation"), (4, "explanation"), (5, "step"))])


REFLECTED = f"""{EXPERIMENTS}, p as (select *, alpha_id % {len(TAGS)} as t, printf('%.2f', round(Sharpe + 1e-9, 2)) as sh, printf('%.2f', round(ICIR + 1e-9, 2)) as ir, printf('%.2f', round(deflated_sharpe + 1e-9, 2)) as ds from e)
select alpha_id, 5 as n, 'Observation: ' || case verdict when 'promising' then 'promising, Sharpe ' || sh || ', ICIR ' || ir when 'failed' then 'under the thresholds, Sharpe ' || sh || ', ICIR ' || ir else 'noisy, Sharpe ' || sh || ' but deflated ' || ds end as observation,
'Possible Explanation: ' || case when alpha_id % 7 = 0 and IC_mean < 0 then 'the IC is negative in every sector: the direction may be the other one' when subperiod_stability = 0 then 'not stable across time, likely bound to a regime' when t = 1 then 'quality and momentum move together in trends only' when t = 2 then 'growth figures are noisy near announcements' when noise_risk = 'high' then 'likely fitted to the sample: the raw Sharpe is overstated' else 'names differ by the signal, but it may not persist' end as explanation,
'Next Mutation: ' || case when verdict = 'failed' and Sharpe < 0.3 then 'add a value dimension' when verdict = 'failed' and ICIR < 0.2 then 'screen by low volatility' when verdict = 'revise' and noise_risk = 'high' then 'weight by liquidity' when t = 0 then 'add a quality overlay' when t = 3 then 'add a momentum overlay' else 'try another neutralisation' end as step from p"""


def _reflect_with(s: SparkSession, d: str) -> DataFrame:
    """A model's notes on the five best experiments; where it fails, the rule's."""
    import json

    top = me.top_n(_noted(s, d), 5).coalesce(1)

    def answer(prompt: str) -> str:
        row = json.loads(prompt)
        if row["alpha_id"] % 2:
            raise RuntimeError("no answer")
        return f"seen {row['alpha_id']}"

    ids = [r.alpha_id for r in me.reflected(top).select("alpha_id").collect()]  # five rows
    notes = me.reflect_with(top, answer)
    return s.createDataFrame([(i, "seen" if "seen" in n else "rule", len(n.split("\n"))) for i, n in zip(ids, notes, strict=True)], "alpha_id long, by string, n long")


# backtest


def _degenerate(s: SparkSession, d: str) -> DataFrame:
    """Bins of a signal that knows three values only."""
    r = Run(s, d, "sign(delta(ADJUSTED_PRICE, 20))")
    return bt.degenerate(r.periods)


SIGN_ALL = f"""{PANEL}, s1 as (select *, x - lag(x, 20) over ({WT}) as u from p), s2 as (select *, sign(u)::double as r from s1),
s3 as (select *, case when r is not null then least(greatest(r, quantile_cont(r, 0.01) over ({CS})), quantile_cont(r, 0.99) over ({CS})) end as w from s2),
sig as materialized (select date, ticker, sector, {zscore('w')} as signal from s3 where w is not null){CALENDAR}{FORWARD}{PAIRS}{IC}{BINS}{PER}"""
DEGENERATE = f"{SIGN_ALL}, c as (select count(*) as periods, count(*) filter (k < 5) as degraded from per) select periods, degraded, case when degraded > 0 then 'fewer than 5 bins in ' || degraded || ' of ' || periods || ' periods (' || round(100 * degraded / periods)::int || '%): many names share a signal' end as warning from c"


def _minimum(s: SparkSession, d: str) -> DataFrame:
    """Spans of dates with the periods that they allow, and whether the metrics refuse them."""
    r = Run(s, d)
    out = []
    for start, end in (("1997-01-01", "1997-12-31"), ("1997-01-01", "1997-03-31"), ("1997-01-01", "1997-02-15"), ("2031-01-01", "2031-12-31")):
        pairs = bt.aligned(r.signal, r.panel, bt.calendar(r.panel, start, end))
        try:
            n, refused = bt.metrics(pairs).first().n_periods, False
        except Exception as e:  # raised inside the job
            if "fewer than 3" not in str(e):
                raise
            n, refused = bt.periods(pairs).count(), True
        out.append((start, end, n, refused))
    return s.createDataFrame(out, "\"start\" string, \"end\" string, n_periods long, refused boolean".replace('"', "`"))


MINIMUM = f"""{ALL}, sp as (select * from (values ('1997-01-01', '1997-12-31'), ('1997-01-01', '1997-03-31'), ('1997-01-01', '1997-02-15'), ('2031-01-01', '2031-12-31')) t("start", "end")),
k as (select "start", "end", (select count(*) from per join cal on cal.date = per.date where per.date >= sp."start"::date and cast(last_day(cal.next_date) - cast(greatest(isodow(last_day(cal.next_date)) - 5, 0) as integer) as date) <= sp."end"::date) as n_periods from sp)
select *, n_periods < 3 as refused from k"""


# many formulas against a store: shapes counted in SQL from the parameters that make the formulas

JOIN_COLUMNS = ["CFO_LTM", "REVENUE_LTM", "ADJUSTED_PRICE", "ADJUSTED_VOLUME", "DA_LTM", "COGS_LTM"]
JOIN_DAYS = [5, 10, 20, 60]
#: Columns A and B and days N are filled in by a key.
JOIN_SHAPES = ["rank(A / B)", "rank(ts_mean(A, N)) + rank(B)", "ts_zscore(A / B, N) - sign(B)", "rank(delta(A, N)) * sign(A / B)"]


def _made(key: Column) -> tuple[Column, Column]:
    """The formula and the declared features of a key."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))
    a, b, n = pick(JOIN_COLUMNS, key), pick(JOIN_COLUMNS, F.floor(key / 6)), pick(JOIN_DAYS, F.floor(key / 36)).cast("string")
    text = pick(JOIN_SHAPES, F.floor(key / 7))
    for mark, value in (("A", a), ("B", b), ("N", n)):
        text = F.regexp_replace(text, F.lit(rf"\b{mark}\b"), value)
    return text, F.when(key % 3 == 0, F.array(a)).otherwise(F.array_distinct(F.array(a, b)))


def _joined(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' formulas against those of all parts: the closest part of each."""
    store_formula, store_features = _made(F.col("p_partkey"))
    formula, features = _made(F.col("s_suppkey") * 37 + 11)
    store = src.table(s, d, "part").select(F.col("p_partkey").alias("alpha_id"), store_formula.alias("formula"), store_features.alias("features"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("timestamp"))
    asked = src.table(s, d, "supplier").select(F.col("s_suppkey").alias("candidate_id"), formula.alias("formula"), features.alias("features"))
    return similarity.closest(asked, store)[0]


def _elements_sql(template: str) -> str:
    """A SQL list of the nodes and edges of a template, with columns a, b and n for its marks."""
    out = []

    def label(n: ast.AST) -> str:
        if isinstance(n, ast.Name):
            return {"A": "'n:' || a", "B": "'n:' || b", "N": "'c:' || n"}.get(n.id, f"'n:{n.id}'")
        if isinstance(n, ast.Call):
            return f"'f:{n.func.id}'"
        return f"'{type(n).__name__}{type(n.op).__name__}'" if isinstance(n, ast.BinOp) else f"'{type(n).__name__}'"

    def walk(n: ast.AST) -> None:
        out.append(label(n))
        mark = isinstance(n, ast.Name) and n.id == "N"  # a number: nothing below it
        sides = [] if mark else [("ctx", n.ctx)] if isinstance(n, ast.Name) else [("func", n.func), *[("args", x) for x in n.args]] if isinstance(n, ast.Call) else []
        if isinstance(n, ast.BinOp):
            same = isinstance(n.op, (ast.Add, ast.Mult))
            sides = [("side" if same else "left", n.left), ("op", n.op), ("side" if same else "right", n.right)]
        for place, child in sides:
            out.append(f"{label(n)} || '>{place}>' || {label(child)}")
            walk(child)

    walk(ast.parse(template, mode="eval").body)
    return f"[{', '.join(out)}]"


def _made_sql(table: str, key: str, name: str) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in JOIN_COLUMNS) + "]"
    by_shape = lambda values: "case k // 7 % 4 " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"
    text = lambda t: "'" + re.sub(r"\b([ABN])\b", lambda m: f"' || {m[1].lower()} || '", t) + "'"
    return f"(select id, k, {by_shape(map(text, JOIN_SHAPES))} as text, case when k % 3 = 0 then [a] else list_distinct([a, b]) end as feats, list_distinct([a, b]) as cols, {by_shape(map(_elements_sql, JOIN_SHAPES))} as elements from (select {name} as id, k, {names}[k % 6 + 1] as a, {names}[k // 6 % 6 + 1] as b, cast({JOIN_DAYS}[k // 36 % 4 + 1] as varchar) as n from (select {name}, {key} as k from {table})))"


_OVERLAP = "cast(len(list_intersect(c.{0}, r.{0})) as double) / len(list_distinct(list_concat(c.{0}, r.{0})))"
JOINED_SQL = f"""with r as materialized {_made_sql('part', 'p_partkey', 'p_partkey')}, c as materialized {_made_sql('supplier', 's_suppkey * 37 + 11', 's_suppkey')},
rc as (select id, e, count(*) as n from (select id, unnest(elements) as e from r) group by 1, 2), cc as (select id, e, count(*) as n from (select id, unnest(elements) as e from c) group by 1, 2),
o as (select cc.id as cid, rc.id as rid, sum(least(cc.n, rc.n)) as shared from cc join rc using (e) group by 1, 2),
s0 as (select cid, rid, c.text = r.text as exact, case when c.text = r.text then 1.0::double else cast(shared as double) / cast(len(c.elements) + len(r.elements) - shared as double) end as structural, {_OVERLAP.format('feats')} as f, {_OVERLAP.format('cols')} as col from o join c on c.id = cid join r on r.id = rid),
s as (select *, 0.4::double * f + 0.4::double * structural + 0.2::double * col as combined from s0),
t as (select cid, max(structural) as ms, round(max(combined), 9) as mc, bool_or(exact) as any_exact from s group by cid)
select t.cid as candidate_id, not (any_exact or ms >= 0.95) as is_unique, any_exact as is_exact_duplicate, case when any_exact or ms >= 0.95 then (select min(rid) from s where s.cid = t.cid and structural = ms) else (select min(rid) from s where s.cid = t.cid and round(combined, 9) = mc) end as most_similar_id, round(mc, 4) as similarity_score, round(ms, 4) as structural_similarity from t"""


def queries() -> dict:
    return {
        "va01_required_keys": _checked("missing", "valid"),
        "va02_parentheses": _checked("closes_early", "stays_open", "too_deep", "empty"),
        "va03_data_column": _checked("no_column"),
        "va04_unknown_names": _checked("columns", "operators"),
        "va05_declared_features": _checked("unused"),
        "va06_universe_and_dates": _checked("universe_error", "date_format", "date_order"),
        "sm02_sign_blind": _sign_blind,
        "sm03_structural": _structural,
        "sm06_search": _search,
        "sm07_most_similar": _most_similar("SHARES_BASIC"),
        "sm07_join": _joined,
        "sm08_duplicate": _most_similar("CFO_LTM"),
        "sc16_complexity": _complexity,
        "me01_rescored": _effective,
        "me02_of_record": _of_record,
        "me09_observations": _observations,
        "ba04_thompson": _thompson,
        "ba05_rewards": _outcomes,
        "gr08_node_detail": _detail,
        "io14_graph_page": _graph,
        "pl01_fallback": _fallback,
        "pl02_as_config": _as_configs,
        "pl03_parsed_answers": _parsed,
        "mu01_rules": _mutated,
        "mu02_three_attempts": _asked,
        "rf01_reflection": _reflected,
        "rf02_model_reflection": _reflect_with,
        "bt07_degenerate_bins": _degenerate,
        "bt11_minimum_periods": _minimum,
    }


def oracle_sql() -> dict[str, str]:
    ex = EXPERIMENTS
    return {
        "va01_required_keys": checks_sql("missing", "valid"),
        "va02_parentheses": checks_sql("closes_early", "stays_open", "too_deep", "empty"),
        "va03_data_column": checks_sql("no_column"),
        "va04_unknown_names": checks_sql("columns", "operators"),
        "va05_declared_features": checks_sql("unused"),
        "va06_universe_and_dates": checks_sql("universe_error", "date_format", "date_order"),
        "sm02_sign_blind": f"select p_partkey as alpha_id, p_partkey % {len(SIGNS)} < 5 as same from part",
        "sm03_structural": f"select p_partkey as alpha_id, round(case p_partkey % {len(PAIRS_BY_HAND)} " + " ".join(f"when {i} then {v}" for i, (_, _, v) in enumerate(PAIRS_BY_HAND)) + " end, 6) as similarity from part",
        "sm06_search": f"{found_sql('CFO_LTM')} select alpha_id, exact, round(structural, 6) + 0.0 as structural, round(column_similarity, 6) + 0.0 as column_similarity, round(feature_similarity, 6) + 0.0 as feature_similarity, round(combined, 6) + 0.0 as combined from s3",
        "sm07_most_similar": most_sql("SHARES_BASIC"),
        "sm07_join": JOINED_SQL,
        "sm08_duplicate": most_sql("CFO_LTM"),
        "sc16_complexity": COMPLEXITY,
        "me01_rescored": f"{ex} select alpha_id, round(case when alpha_id % 3 <> 1 then predictive_magnitude when alpha_id % 6 <> 1 then score else 100 * (0.65 * magnitude + 0.2 * implementation + 0.1 * simplicity + 0.05 * 0.5) end, 6) + 0.0 as effective from e",
        "me02_of_record": f"{ex} select alpha_id, direction_status as direction, fatal from e",
        "me09_observations": OBSERVATIONS,
        "ba04_thompson": "select i as experiments, case when i < 3 then '__explore__' else 'good' end as with_good, '__explore__' as with_bad, '__explore__' as without from range(6) t(i)",
        "ba05_rewards": OUTCOMES,
        "gr08_node_detail": DETAIL,
        "io14_graph_page": GRAPH,
        "pl01_fallback": FALLBACK,
        "pl02_as_config": AS_CONFIGS,
        "pl03_parsed_answers": PARSED,
        "mu01_rules": MUTATED,
        "mu02_three_attempts": ASKED,
        "rf01_reflection": REFLECTED,
        "rf02_model_reflection": f"{ex} select alpha_id, case when alpha_id % 2 = 0 then 'seen' else 'rule' end as by, case when alpha_id % 2 = 0 then 2 else 5 end as n from e order by predictive_magnitude desc, timestamp limit 5",
        "bt07_degenerate_bins": DEGENERATE,
        "bt11_minimum_periods": MINIMUM,
    }
