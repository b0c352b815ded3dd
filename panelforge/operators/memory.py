"""The experiment store and what is learnt from it: failure taxonomy, summary, bandit, lineage."""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import formulas
from panelforge.functions.registry import OPERATORS
from panelforge.functions.tables import delete, hadoop_path, kept, shared_folder, small
from panelforge.operators import scoring
from panelforge.plans.compiler import RAW_COLUMNS

EXPLORE = "__explore__"
PARENT_FLOOR, CONTRADICTED_FLOOR = 35.0, 50.0
ARMS, COLD_START, HALF_RANGE, BASELINE = 5, 3, 25.0, 50.0


class Store:
    """Records as Parquet batches in one folder; the newest batch of a key wins. New columns merge into old ones."""

    def __init__(self, spark: SparkSession, path: str, key: str = "alpha_id"):
        self.spark, self.path, self.key = spark, path, key

    def upsert(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("_version", F.lit(version).cast("long")).write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        return newest(self.spark.read.option("mergeSchema", "true").parquet(self.path), self.key, "_version").drop("_version")

    def compact(self) -> int:
        """Replace all batches by the newest row of each key; the number of files that went.

        The new file comes before the old ones go, so a stop in between leaves rows twice, with equal versions, and loses none.
        Batches that arrive meanwhile stay. Readers of the old files fail: run it when none is at work.
        """
        now = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        old = now.inputFiles()
        newest(now, self.key, "_version").write.mode("append").parquet(self.path)
        for f in old:
            delete(self.spark, f)
        return len(old)

    def get(self, key) -> DataFrame:
        return self.load().where(F.col(self.key) == F.lit(key))


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version for each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return df.withColumn("_nr", F.row_number().over(w)).where("_nr = 1").drop("_nr")


def effective_score(rescored: Column | None = None) -> Column:
    """The stored magnitude, else the stored score, else what a rescore gives (rows from before scores were kept), else 0."""
    return F.coalesce("predictive_magnitude", "score", *([] if rescored is None else [rescored]), F.lit(0.0))


def rescored() -> Column:
    """The magnitude of a metric row, at a novelty of 0.5: what the store held at the time is not known any more."""
    parts = {"performance": scoring.performance(True), "implementation": scoring.implementation(), "simplicity": scoring.simplicity(F.col("complexity")), "novelty": F.lit(0.5)}
    return scoring.composite(parts)


def direction_of_record() -> Column:
    """The stored direction if it is a known one, else that of the metrics; without metrics uncertain."""
    known = F.col("direction_status").isin("supported", "contradicted", "uncertain")
    return F.when(known, F.col("direction_status")).when(F.col("IC_mean").isNull() & F.col("Sharpe").isNull(), "uncertain").otherwise(scoring.direction())


def fatal_of_record() -> Column:
    return F.coalesce("fatal", F.coalesce("failure_reason", F.lit("")).startswith("fatal"))


def stable_contradiction() -> Column:
    negative = (F.col("IC_mean") <= -0.005) & (F.col("Sharpe") <= -0.10)
    return negative & ((F.col("ICIR") <= -0.10) | F.coalesce(F.col("subperiod_stability") >= 0.5, F.lit(False)))


def failure_category() -> Column:
    """Why an experiment did not succeed: the first of eight that fits; null for promising ones."""
    rules = [
        ("wrong_direction", F.col("direction_status") == "contradicted"),
        ("high_turnover", F.col("turnover") > 0.7),
        ("negative_sharpe", F.col("Sharpe") < 0),
        ("weak_ic", F.col("ICIR") < 0.3),
        ("high_noise", F.col("noise_risk") == "high"),
        ("poor_robustness", (F.coalesce("subperiod_stability", F.lit(1.0)) < 0.3) | (F.coalesce("placebo_score", F.lit(1.0)) < 0.3)),
        ("too_complex", F.coalesce("simplicity", F.lit(1.0)) < 0.3),
        ("low_novelty", F.coalesce("novelty", F.lit(1.0)) < 0.2),
    ]
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return F.when(F.col("verdict") != "promising", out)


def counts(records: DataFrame, by: str) -> DataFrame:
    return records.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def best(records: DataFrame, n: int = 3) -> DataFrame:
    return records.where("verdict = 'promising'").withColumn("effective", effective_score()).orderBy(F.desc("effective"), "timestamp").limit(n)


def recent(records: DataFrame, n: int = 30) -> DataFrame:
    """The last n tried, newest first."""
    return records.orderBy(F.desc("timestamp")).limit(n)


def unexplored(records: DataFrame, names: list[str]) -> DataFrame:
    every = records.sparkSession.createDataFrame([(c,) for c in names], "feature string")
    return every.join(records.select(F.explode("features").alias("feature")).distinct(), "feature", "left_anti")


def observations(records: DataFrame, names: list[str] | None = None) -> DataFrame:
    """kind, text: the main failure, the best experiment (or that there is none), and the features nobody has tried."""
    failed = records.where("verdict in ('failed', 'revise')").agg(F.count(F.lit(1)).alias("total"))
    main = counts(records.withColumn("category", failure_category()), "category").orderBy(F.desc("n"), "category").limit(1)
    a = main.crossJoin(failed).where("total > 0").select(F.lit("failure").alias("kind"), F.format_string("%s: %d of %d (%d%%)", "category", "n", "total", F.floor(100 * F.col("n") / F.col("total"))).alias("text"))  # one row each
    top = best(records, 1).agg(F.max(F.struct("effective", F.col("alpha_id").cast("string").alias("id"), "Sharpe")).alias("b"))
    text = F.format_string("%.1f: %s, Sharpe %.3f", F.round(F.col("b.effective") + 1e-9, 1), "b.id", F.round(F.col("b.Sharpe") + 1e-9, 3))
    b = top.select(F.lit("best").alias("kind"), F.coalesce(F.when(F.col("b").isNotNull(), text), F.lit("no promising experiment yet")).alias("text"))
    out = a.unionByName(b)
    if names:
        left = unexplored(records, names).agg(F.array_sort(F.collect_list("feature")).alias("f")).where("size(f) > 0")  # at most as many as there are features
        more = F.when(F.size("f") > 5, F.format_string(" and %d more", F.size("f") - 5)).otherwise("")
        out = out.unionByName(left.select(F.lit("unexplored").alias("kind"), F.concat(F.array_join(F.slice("f", 1, 5), ", "), more).alias("text")))
    return out


def eligible() -> Column:
    usual = F.col("verdict").isin("promising", "revise") & (effective_score() >= PARENT_FLOOR)
    turned = (F.col("direction_status") == "contradicted") & ~F.col("fatal") & (effective_score() >= CONTRADICTED_FLOOR) & stable_contradiction()
    return usual | turned


def arms(records: DataFrame) -> DataFrame:
    """The best eligible parents with their priors."""
    top = records.where(eligible()).withColumn("effective", effective_score()).orderBy(F.desc("effective"), "alpha_id").limit(ARMS)
    return top.select(F.col("alpha_id").alias("arm_id"), "effective", (1 + F.col("effective") / 100).alias("alpha"), F.lit(1.0).alias("beta"))


def reward(child: Column, base: Column) -> Column:
    return F.greatest(F.least(0.5 + (child - base) / (2 * HALF_RANGE), F.lit(1.0)), F.lit(0.0))


def rewards(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """arm pulls with their reward. outcomes: alpha_id, action, parent_id, status, effective (of the child).

    A pull that did not complete earns 0. A mutation is held against its parent, an exploration (or a mutation whose parent
    is not in the store) against the mean of all other records, or BASELINE without any.
    """
    scores = records.select("alpha_id", effective_score().alias("_e"))
    every = scores.agg(F.coalesce(F.sum("_e"), F.lit(0.0)).alias("_sum"), F.count(F.lit(1)).alias("_n"))  # one row
    parents = scores.select(F.col("alpha_id").alias("parent_id"), F.col("_e").alias("_parent"))
    own = scores.select("alpha_id", F.col("_e").alias("_own"))
    x = outcomes.join(parents, "parent_id", "left").join(own, "alpha_id", "left").crossJoin(F.broadcast(every))
    others = F.col("_n") - F.col("_own").isNotNull().cast("int")
    mean = F.when(others > 0, (F.col("_sum") - F.coalesce("_own", F.lit(0.0))) / others).otherwise(BASELINE)
    base = F.when((F.col("action") == "mutate") & F.col("_parent").isNotNull(), F.col("_parent")).otherwise(mean)
    done = F.when(F.col("status") == "completed", reward(F.col("effective"), base)).otherwise(0.0)
    return x.select(*outcomes.columns, base.alias("baseline"), F.coalesce(done, F.lit(0.0)).alias("reward"))


def replay(pulls: DataFrame, priors: DataFrame) -> DataFrame:
    """Posteriors after a batch of pulls (arm_id, reward): fractional successes and failures add up."""
    r = F.greatest(F.least(F.col("reward"), F.lit(1.0)), F.lit(0.0))
    total = pulls.groupBy("arm_id").agg(F.sum(r).alias("up"), F.sum(1 - r).alias("down"), F.count(F.lit(1)).alias("pulls"))
    out = priors.join(total, "arm_id", "left").select("arm_id", (F.col("alpha") + F.coalesce("up", F.lit(0.0))).alias("alpha"), (F.col("beta") + F.coalesce("down", F.lit(0.0))).alias("beta"), F.coalesce("pulls", F.lit(0)).alias("pulls"))
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def choose(posteriors: dict[str, tuple[float, float]], experiments: int, rng: random.Random | None = None) -> str:
    """Thompson sampling over arms; exploration while there are few experiments."""
    rng = rng or random.Random()
    if experiments < COLD_START or not posteriors:
        return EXPLORE
    drawn = {arm: rng.betavariate(a, b) for arm, (a, b) in ({EXPLORE: (2.0, 1.0)} | posteriors).items()}
    return max(drawn, key=drawn.__getitem__)


# lineage


def edges(records: DataFrame) -> DataFrame:
    """parent, child where the parent came before the child."""
    p = records.select(F.col("alpha_id").alias("parent"), F.col("timestamp").alias("t"))
    c = records.where("parent_id is not null").select(F.col("alpha_id").alias("child"), F.col("parent_id").alias("parent"), F.col("timestamp").alias("u"))
    return c.join(p, "parent").where("t < u").select("parent", "child")


def top_n(records: DataFrame, n: int) -> DataFrame:
    """Ranked by magnitude, else by score; those without either come last, by their Sharpe."""
    known = F.coalesce(F.when(F.col("predictive_magnitude") >= 0, F.col("predictive_magnitude")), F.when(F.col("score") >= 0, F.col("score")))
    return records.orderBy(known.isNotNull().desc(), F.coalesce(known, "Sharpe").desc(), "timestamp").limit(n)


def parents(records: DataFrame) -> DataFrame:
    """parent, child where the parent is in the store, whenever it came."""
    p = records.select(F.col("alpha_id").alias("parent"))
    return records.where("parent_id is not null").select(F.col("alpha_id").alias("child"), F.col("parent_id").alias("parent")).join(p, "parent", "left_semi").select("parent", "child").distinct()


def ancestors(edge: DataFrame, start: DataFrame) -> DataFrame:
    """start (alpha_id) and all its ancestors, by doubling: round k adds those 2^k generations above all that are found.

    After it everyone less than 2^(k + 1) generations up is found, so rounds grow with the logarithm of a lineage's length. A
    round that adds nobody is the last one, in loops too.
    """
    at = shared_folder(edge.sparkSession, "lineage")
    jump = kept(edge.select(F.col("child").alias("alpha_id"), F.col("parent").alias("up")).distinct(), f"{at}/jump-0")
    found = kept(start.select("alpha_id").distinct(), f"{at}/found-0")
    step, before, now = 0, -1, found.count()
    while now > before:
        if step:
            next_ = jump.select(F.col("alpha_id").alias("up"), F.col("up").alias("above"))
            jump = kept(jump.join(next_, "up").select("alpha_id", F.col("above").alias("up")).distinct(), f"{at}/jump-{step}")
        step += 1
        found = kept(found.union(found.join(jump, "alpha_id").select("up")).distinct(), f"{at}/found-{step}")
        before, now = now, found.count()
    return found


def rings(records: DataFrame) -> DataFrame:
    """Ring number by batch name; no batch is ring 0."""
    named = records.where("batch_id is not null").select("batch_id").distinct().withColumn("ring", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("batch_id")) - 1)  # one row a batch
    return records.join(small(named), "batch_id", "left").withColumn("ring", F.coalesce("ring", F.lit(0)))


def layout(ringed: DataFrame) -> DataFrame:
    """Places on the rings, by (timestamp, alpha_id). A ring's records are numbered range by range, and ranges by the counts before them, so
    that a ring with most of the records is not one task's."""
    spark = ringed.sparkSession
    ranged = ringed.select("alpha_id", "ring", "timestamp").repartitionByRange("ring", "timestamp", "alpha_id").withColumn("_range", F.spark_partition_id())
    placed = kept(ranged, shared_folder(spark, "layout"))
    by_range = Window.partitionBy("ring").orderBy("_range")
    sizes = placed.groupBy("ring", "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each ring and range that meet
    sizes = sizes.withColumns({"_before": F.sum("_n").over(by_range) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy("ring"))}).drop("_n")
    local = F.row_number().over(Window.partitionBy("ring", "_range").orderBy("timestamp", "alpha_id"))
    numbered = placed.withColumn("_i", local).join(small(sizes), ["ring", "_range"])
    angle = 2 * math.pi * (F.col("_before") + F.col("_i") - 1) / F.col("_all")
    radius = 100 + 160 * F.col("ring")
    return numbered.select("alpha_id", "ring", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


#: Soft and hard limits that node details warn at (fixed values): a value at or below the soft limit is "warn", at or below the hard one "bad".
WARN = {"IC_mean": (0.02, None), "ICIR": (0.30, None), "monotonicity": (0.30, None), "Sharpe": (0.50, 0.0), "max_drawdown": (-0.25, -0.40)}
WARN_TURNOVER = 0.70


def node_detail(records: DataFrame) -> DataFrame:
    """A node's figures with their warnings (a map), and its four sectors of the largest |IC| (sector_ic: a map of sector to IC)."""
    level = lambda c, soft, hard: (F.when(F.col(c) <= hard, "bad") if hard is not None else F).when(F.col(c) <= soft, "warn").otherwise("")
    warned = [x for c, (soft, hard) in WARN.items() for x in (F.lit(c), level(c, soft, hard))]
    warned += [F.lit("turnover"), F.when(F.col("turnover") >= WARN_TURNOVER, "warn").otherwise("")]
    pairs = F.transform(F.map_entries("sector_ic"), lambda e: F.struct((-F.abs(e["value"])).alias("rank"), e["key"].alias("sector"), e["value"].alias("ic")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, 4), lambda x: F.struct(x["sector"].alias("sector"), x["ic"].alias("ic")))
    return records.withColumn("warnings", F.create_map(*warned)).withColumn("top_sectors", F.coalesce(top, F.array().cast("array<struct<sector:string,ic:double>>")))


def export_html(nodes: DataFrame, edge: DataFrame, path: str, most: int = 5000) -> None:
    """A page with the graph's data; refuses graphs too large for a page. Ids are set as text, never as markup."""
    ns = [r.asDict(True) for r in nodes.limit(most + 1).collect()]
    if len(ns) > most:
        raise ValueError(f"more than {most} nodes; filter first")
    keep = {n["alpha_id"] for n in ns}
    inside = edge.join(F.broadcast(nodes.select(F.col("alpha_id").alias("child"))), "child", "left_semi").join(F.broadcast(nodes.select(F.col("alpha_id").alias("parent"))), "parent", "left_semi")  # at most `most` rows
    es = [[r.parent, r.child] for r in inside.select("parent", "child").collect() if r.parent in keep]
    data = json.dumps({"nodes": ns, "edges": es}, default=str).replace("<", "\\u003c")
    page = f"""<!doctype html><meta charset="utf-8"><title>Research lineage</title><svg id="g" viewBox="-900 -900 1800 1800" width="100%" height="95vh"></svg>
<script id="d" type="application/json">{data}</script>
<script>const d=JSON.parse(document.getElementById("d").textContent),g=document.getElementById("g"),at=Object.fromEntries(d.nodes.map(n=>[n.alpha_id,n]));
const add=(tag,a,text)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",tag);for(const k in a)e.setAttribute(k,a[k]);if(text!==undefined){{const t=add("title",{{}});t.textContent=text;e.append(t);}}if(tag!=="title")g.append(e);return e;}};
for(const [p,c] of d.edges)if(at[p]&&at[c])add("line",{{x1:at[p].x,y1:at[p].y,x2:at[c].x,y2:at[c].y,stroke:"#999"}});
for(const n of d.nodes)add("circle",{{cx:n.x,cy:n.y,r:8}},String(n.alpha_id));</script>"""
    at, fs = hadoop_path(nodes.sparkSession, path)
    out = fs.create(at, True)
    out.write(page.encode())
    out.close()


def read_html(text: str) -> dict:
    """The data of an exported page."""
    return json.loads(re.search(r'<script id="d" type="application/json">(.*?)</script>', text, re.S)[1])


# research loop: rule-based, or any Callable[[str], str] that answers prompts

#: Formulas that the planner falls back on (fixed values), each with its direction and features.
IDEAS = [
    ("value screen", "rank(ADJUSTED_PRICE / (REVENUE_LTM / SHARES_DILUTED)) * -1", ["PRICE_TO_SALES"]),
    ("quality + value", "rank((OPERATING_INCOME_LTM + DA_LTM) / REVENUE_LTM) + rank(ADJUSTED_PRICE / (REVENUE_LTM / SHARES_DILUTED)) * -1", ["EBITDA_MARGIN", "PRICE_TO_SALES"]),
    ("earnings growth momentum", "rank(NET_INCOME_LTM / NET_INCOME_LTM.shift(252) - 1) + 0.5 * rank(REVENUE_LTM / REVENUE_LTM.shift(252) - 1)", ["EPS_GROWTH", "SALES_GROWTH"]),
    ("low volatility", "rank(ADJUSTED_PRICE.pct_change().rolling(20).std()) * -1", ["VOL_20D"]),
    ("liquidity + momentum", "rank(ADJUSTED_PRICE.shift(21) / ADJUSTED_PRICE.shift(126) - 1) * rank(ADJUSTED_VOLUME * ADJUSTED_PRICE)", ["MOM6_1", "LIQUIDITY"]),
]


SPARES = 2


def loads(text: str):
    """The JSON of an answer, with or without a fence around it."""
    return json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text))


def plan_prompt(summary: dict, n: int, avoid: list[str] | None = None) -> str:
    """What a model is asked: the store's summary, what to keep away from, and the form of the answer."""
    lines = [f"{k}: {json.dumps(v, sort_keys=True, default=str)}" for k, v in summary.items()]
    if avoid:
        lines += ["Turned down as duplicates, propose none of these:", *[f"- {f}" for f in avoid]]
    lines += [f"Operators: {', '.join(sorted(OPERATORS))}", f"Columns: {', '.join(RAW_COLUMNS)}"]
    lines.append(f"Answer with a JSON array of {n} objects with direction, hypothesis, formula, features, parent_id, rationale. Simple formulas that nobody has tried score best; a change of sign is a duplicate.")
    return "\n".join(lines)


def parse_plan(text: str) -> list[dict]:
    """The suggestions of an answer whose formulas are valid; raises ValueError if it is no JSON array."""
    data = loads(text)
    if not isinstance(data, list):
        raise ValueError("the answer is no list")
    found = []
    for item in data:
        if isinstance(item, dict) and isinstance(item.get("formula"), str) and not formulas.validate(DEFAULTS | {"alpha_id": "plan", "formula": item["formula"]})[0]:
            found.append({k: item.get(k, d) for k, d in (("direction", ""), ("hypothesis", ""), ("formula", ""), ("features", []), ("parent_id", None), ("rationale", ""))})
    return found


def plan(explored: set[str], n: int, duplicate: Callable[[str], bool] = lambda f: False, answer: Callable[[str], str] | None = None, summary: dict | None = None, avoid: list[str] | None = None) -> list[dict]:
    """n suggestions that are no duplicates: a model's if one is given, and ideas (untried features first) for the places it leaves free."""
    found: list[dict] = []
    if answer is not None:
        try:
            found = parse_plan(answer(plan_prompt(summary or {}, n + SPARES, avoid)))
        except Exception:  # any failure of the model leaves the places to the ideas
            found = []
    found = [s for s in found if not duplicate(s["formula"])]
    if len(found) < n:
        order = sorted(IDEAS, key=lambda i: bool(set(i[2]) & explored))
        spare = [{"direction": d, "hypothesis": d, "formula": f, "features": x, "parent_id": None, "rationale": ""} for d, f, x in order[: n - len(found) + SPARES]]
        found += [s for s in spare if not duplicate(s["formula"])]
    return found[:n]


#: What a configuration has where neither the suggestion nor the base says otherwise (fixed values).
DEFAULTS = {"universe": "sp500", "start_date": "2021-01-01", "end_date": "2026-06-01", "neutralization": "sector", "rebalance": "monthly", "transaction_cost_bps": 5, "holding_period_days": 20}


def as_config(suggestion: dict, alpha_id: str, batch_id: str | None = None, base: dict | None = None) -> dict:
    """A suggestion as a configuration; base (the first experiment's) keeps experiments comparable."""
    shared = {k: (base or {}).get(k, v) for k, v in DEFAULTS.items()}
    own = {"alpha_id": alpha_id, "parent_id": suggestion.get("parent_id"), "batch_id": batch_id, "hypothesis": suggestion.get("hypothesis", ""), "formula": suggestion["formula"], "features": suggestion.get("features", [])}
    return shared | own | {"mutation": f"planned: {suggestion.get('direction', '')}"}


def write_configs(configs: DataFrame, path: str) -> None:
    """One JSON object a line; many configurations share a file."""
    configs.write.mode("overwrite").json(path)


def read_configs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, over one line or several."""
    return spark.read.schema(schema).option("multiLine", "true").json(path) if path.endswith(".json") else spark.read.schema(schema).json(path)


# Overlays and weights of the mutation rules (fixed values).
QUALITY = "rank((OPERATING_INCOME_LTM + DA_LTM) / REVENUE_LTM)"
VOLATILITY = "rank(ADJUSTED_PRICE.pct_change().rolling(20).std())"
LIQUIDITY = "rank(ADJUSTED_VOLUME * ADJUSTED_PRICE)"
OVERLAY = 0.3
MANY_TURNS, WEAK_SHARPE, WEAK_ICIR = 0.7, 0.3, 0.2


def mutated(records: DataFrame) -> DataFrame:
    """records (formula, rebalance, turnover, Sharpe, ICIR) with the child's formula, rebalance and change: the first of five rules that fits."""
    f = F.col("formula")
    quality = f.contains("OPERATING_INCOME_LTM") | f.contains("NET_INCOME_LTM")
    momentum = f.contains("shift") & f.contains("ADJUSTED_PRICE")
    overlay = F.concat(F.lit("("), f, F.lit(f") + {OVERLAY} * {QUALITY}"))
    rules = [
        (F.coalesce("turnover", F.lit(0.0)) > MANY_TURNS, f, "quarterly rebalance"),
        ((F.coalesce("Sharpe", F.lit(0.0)) < WEAK_SHARPE) & ~quality, overlay, "quality overlay"),
        (F.coalesce("ICIR", F.lit(0.0)) < WEAK_ICIR, F.concat(F.lit("("), f, F.lit(f") * (1 - {VOLATILITY})")), "volatility damper"),
        (momentum & ~quality, overlay, "quality beside momentum"),
        (F.lit(True), F.concat(F.lit("("), f, F.lit(f") * {LIQUIDITY}")), "liquidity weight"),
    ]
    new, change = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, formula, name in reversed(rules):
        new, change = F.when(test, formula).otherwise(new), F.when(test, name).otherwise(change)
    out = records.withColumns({"child_formula": new, "change": change})
    return out.withColumn("child_rebalance", F.when(F.col("change") == "quarterly rebalance", "quarterly").otherwise(F.coalesce("rebalance", F.lit("monthly"))))


def mutate(formula: str, metrics: dict) -> tuple[str, str]:
    """(formula, what changed) for one experiment, by the same rules as ``mutated``."""
    quality = "OPERATING_INCOME_LTM" in formula or "NET_INCOME_LTM" in formula
    overlay = f"({formula}) + {OVERLAY} * {QUALITY}"
    if metrics.get("turnover", 0) > MANY_TURNS:
        return formula, "quarterly rebalance"
    if metrics.get("Sharpe", 0) < WEAK_SHARPE and not quality:
        return overlay, "quality overlay"
    if metrics.get("ICIR", 0) < WEAK_ICIR:
        return f"({formula}) * (1 - {VOLATILITY})", "volatility damper"
    if "shift" in formula and "ADJUSTED_PRICE" in formula and not quality:
        return overlay, "quality beside momentum"
    return f"({formula}) * {LIQUIDITY}", "liquidity weight"


def child_by_rule(config: dict, metrics: dict) -> dict:
    """The configuration of an experiment's child, by rule."""
    formula, change = mutate(config["formula"], metrics)
    more = {"rebalance": "quarterly"} if change == "quarterly rebalance" else {}
    return DEFAULTS | config | more | {"parent_id": config.get("alpha_id"), "alpha_id": f"{config.get('alpha_id')}_mut", "formula": formula, "features": sorted(formulas.columns(formula)), "mutation": change}


ATTEMPTS = 3


def mutate_with(answer: Callable[[list[str]], str], config: dict, metrics: dict, duplicate: Callable[[str], str | None] = lambda f: None) -> dict:
    """A model's child of an experiment: it is asked up to three times, each time with what was wrong before.

    duplicate(formula) names the experiment that it repeats, or is None. Raises ValueError after the last attempt.
    """
    said = [f"Improve this experiment by one structural change. Answer with a JSON object with hypothesis, formula, mutation.\n{json.dumps(config, sort_keys=True, default=str)}\n{json.dumps(metrics, sort_keys=True)}"]
    wrong = ""
    for _ in range(ATTEMPTS):
        text = answer(said)
        try:
            data = loads(text)
            if not isinstance(data, dict):
                raise ValueError("the answer is no object")
            child = DEFAULTS | {k: config[k] for k in DEFAULTS if k in config} | data
            child |= {"alpha_id": f"{config.get('alpha_id')}_mut", "parent_id": config.get("alpha_id"), "features": sorted(formulas.columns(str(child.get("formula", ""))))}
            errors = formulas.validate(child)[0]
            if errors:
                raise ValueError("; ".join(errors))
            other = duplicate(child["formula"])
            if other is not None:
                raise ValueError(f"a structural duplicate of {other}: use other columns or other operators")
            return child
        except ValueError as e:
            wrong = str(e)
            said += [text, f"This does not do: {wrong}. Answer with the corrected JSON object."]
    raise ValueError(f"no valid child after {ATTEMPTS} attempts: {wrong}")


def child_of(config: dict, metrics: dict, duplicate: Callable[[str], str | None] = lambda f: None, answer: Callable[[list[str]], str] | None = None) -> dict:
    """A child by the model if one is given and succeeds, else by rule; a rule's child that repeats an experiment is an error."""
    if answer is not None:
        try:
            return mutate_with(answer, config, metrics, duplicate)
        except Exception:  # any failure of the model falls back on the rules
            pass
    child = child_by_rule(config, metrics)
    other = duplicate(child["formula"])
    if other is not None:
        raise ValueError(f"the child is a structural duplicate of {other}")
    return child


DISCLAIMER = "Notes on a past test, no statement about the future."


def reflected(records: DataFrame) -> DataFrame:
    """records with reflection: four lines on each experiment, by rule.

    Reads verdict, failure_reason, Sharpe, ICIR, deflated_sharpe, noise_risk, subperiod_stability, features and sector_ic (a map).
    """
    two = lambda c: F.format_string("%.2f", F.round(F.col(c) + 1e-9, 2))
    any_feature = lambda part: F.exists("features", lambda x: x.contains(part))
    quality = F.arrays_overlap("features", F.array(*[F.lit(x) for x in ("EBITDA_MARGIN", "EBITDA_LTM", "EPS_LTM")]))
    momentum, growth = any_feature("MOM"), any_feature("GROWTH")
    seen = (
        F.when(F.col("verdict") == "promising", F.concat(F.lit("promising, Sharpe "), two("Sharpe"), F.lit(", ICIR "), two("ICIR")))
        .when(F.col("verdict") == "failed", F.concat(F.lit("under the thresholds, Sharpe "), two("Sharpe"), F.lit(", ICIR "), two("ICIR")))
        .otherwise(F.concat(F.lit("noisy, Sharpe "), two("Sharpe"), F.lit(" but deflated "), two("deflated_sharpe")))
    )
    inverted = (F.size("sector_ic") > 0) & F.forall(F.map_values("sector_ic"), lambda v: v < 0)
    why = (
        F.when(inverted, "the IC is negative in every sector: the direction may be the other one")
        .when(F.col("subperiod_stability") == 0.0, "not stable across time, likely bound to a regime")
        .when(momentum & quality, "quality and momentum move together in trends only")
        .when(growth, "growth figures are noisy near announcements")
        .when(F.col("noise_risk") == "high", "likely fitted to the sample: the raw Sharpe is overstated")
        .otherwise("names differ by the signal, but it may not persist")
    )
    step = (
        F.when((F.col("verdict") == "failed") & (F.col("Sharpe") < WEAK_SHARPE), "add a value dimension")
        .when((F.col("verdict") == "failed") & (F.col("ICIR") < WEAK_ICIR), "screen by low volatility")
        .when((F.col("verdict") == "revise") & (F.col("noise_risk") == "high"), "weight by liquidity")
        .when(momentum & ~quality, "add a quality overlay")
        .when(quality & ~momentum, "add a momentum overlay")
        .otherwise("try another neutralisation")
    )
    lines = [F.lit(DISCLAIMER), F.concat(F.lit("Observation: "), seen), F.concat(F.lit("Failure Reason: "), F.coalesce("failure_reason", F.lit("N/A"))), F.concat(F.lit("Possible Explanation: "), why), F.concat(F.lit("Next Mutation: "), step)]
    return records.withColumn("reflection", F.concat_ws("\n", *lines))


def reflect_with(records: DataFrame, answer: Callable[[str], str], most: int = 1000) -> list[str]:
    """A model's reflections on a few records, in their order; where it fails, the rule's."""
    rows = reflected(records).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} records for a model")
    out = []
    for row in rows:
        try:
            out.append(f"{DISCLAIMER}\n{answer(json.dumps(row.asDict(True), sort_keys=True, default=str))}")
        except Exception:  # any failure of the model falls back on the rules
            out.append(row.reflection)
    return out
