"""Experiments from configuration to record, many in one go, and the research loop over them.

A batch of configurations is validated as a table, held against the store through its inverted index, backtested by one plan for
each span of dates, checked for robustness, scored and reflected on. What completed becomes records of the store; every
configuration gets an outcome that says how far it came.

A batch is judged against the store as it stood when the batch began, so scores do not depend on the order inside it. Of formulas
in a batch that are duplicates of each other the first by (timestamp, alpha_id) runs. A batch holds at most BATCH formulas: they
are columns of plans, and the driver holds their texts.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import formulas as fm
from panelforge.functions.tables import exists, kept, shared_folder
from panelforge.operators import backtest as bt
from panelforge.operators import memory as me
from panelforge.operators import robustness, scoring, screening, similarity

STATUSES = ["completed", "duplicate", "validation_failed", "backtest_error"]
BATCH = 2000
#: Rounds after which a folder's batches are merged.
COMPACT = 16
CONFIG = {
    "alpha_id": "string", "parent_id": "string", "batch_id": "string", "timestamp": "string", "hypothesis": "string", "formula": "string",
    "features": "array<string>", "mutation": "string", "universe": "string", "start_date": "string", "end_date": "string", "rebalance": "string",
}
METRICS = {"IC_mean": "IC_mean", "ICIR": "ICIR", "sharpe": "Sharpe", "deflated_sharpe": "deflated_sharpe", "monotonicity": "monotonicity", "turnover": "turnover", "max_drawdown": "max_drawdown", "Q5_Q1_return": "Q5_Q1_return"}
CHECKS = {"sector_ic": "map<string,double>", "regime_sharpe": "map<string,double>", "subperiod_stability": "double", "placebo_score": "double"}
RECORD_SCHEMA = "alpha_id string, formula string, features array<string>, timestamp string"


def shaped(configs: DataFrame) -> DataFrame:
    """Configurations with all the columns of CONFIG; others go."""
    return configs.select(*[(F.col(c).cast(t) if c in configs.columns else F.lit(None).cast(t)).alias(c) for c, t in CONFIG.items()])


def twins(candidates: DataFrame) -> dict[str, str]:
    """alpha_id of each candidate that repeats an earlier one of the batch that runs, and the id of that one.

    Formulas that are the same up to their sign meet by their canonical form. The others meet in the rarest elements of their
    shapes: an overlap of DUPLICATE of n elements cannot avoid the n - ceil(DUPLICATE n) + 1 rarest ones.
    """
    d = kept(similarity.prepared(candidates, "alpha_id", ["timestamp"]).where("canonical is not null"), shared_folder(candidates.sparkSession, "twins"))
    same = Window.partitionBy("canonical").orderBy("timestamp", "alpha_id")
    firsts = d.withColumn("first", F.first("alpha_id").over(same))
    out = {r.alpha_id: r.first for r in firsts.where("alpha_id != first").select("alpha_id", "first").collect()}  # a batch's ids
    d = firsts.where("alpha_id = first").drop("first")
    e = similarity.elements(d, "alpha_id", True).where("kind = 'shape'")
    e = e.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("element")))
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("alpha_id").orderBy("df", "element"))).where(F.col("at") <= F.col("size") - F.ceil(fm.DUPLICATE * F.col("size") - 1e-6) + 1)
    e = e.join(d.select("alpha_id", "timestamp"), "alpha_id").select("element", "size", F.struct("timestamp", "alpha_id").alias("o"))
    a, b = e.select("element", F.col("size").alias("m"), F.col("o").alias("p")), e
    met = a.join(b, "element").where((F.col("p") < F.col("o")) & (F.least("size", "m") + 1e-6 >= fm.DUPLICATE * F.greatest("size", "m")))
    met = met.select(F.col("o.alpha_id").alias("c_id"), F.col("p.alpha_id").alias("r_id"))
    near = similarity._verified(met, d, d, "alpha_id", "alpha_id", "timestamp").where(F.col("structural") >= fm.DUPLICATE)
    earlier: dict[str, list[str]] = {}
    for r in near.orderBy("r_order", "r_id").collect():
        earlier.setdefault(r.c_id, []).append(r.r_id)
    for r in d.where(F.col("alpha_id").isin(list(earlier))).orderBy("timestamp", "alpha_id").select("alpha_id").collect():
        found = next((x for x in earlier[r.alpha_id] if x not in out), None)
        if found is not None:
            out[r.alpha_id] = found
    return {k: out.get(v, v) for k, v in out.items()}


def _dead() -> Column:
    return (F.abs("IC_mean") < scoring.FATAL_IC) & (F.abs("Sharpe") < scoring.FATAL_SHARPE)


def measured(asked: DataFrame, panel: DataFrame, prices: DataFrame | None, reg: DataFrame | None, shuffles: int) -> DataFrame:
    """alpha_id, ran (ok, few periods, invalid), why, n_periods, metrics, noise_risk and checks of asked formulas.

    One plan for each span of dates. Signals without an edge in either direction are not checked for robustness: their checks are 0.
    """
    spark = panel.sparkSession
    rows = asked.select("alpha_id", "formula", "start_date", "end_date").limit(BATCH + 1).collect()
    if len(rows) > BATCH:
        raise ValueError(f"more than {BATCH} formulas in a batch")
    spans: dict[tuple[str, str], dict[str, str]] = {}
    for r in rows:
        spans.setdefault((r.start_date, r.end_date), {})[r.alpha_id] = r.formula
    out = None
    for (start, end), formulas in spans.items():
        inside = F.col("date").between(F.to_date(F.lit(start), "yyyy-M-d"), F.to_date(F.lit(end), "yyyy-M-d"))
        part = panel.where(inside)
        good, bad, pairs, periods = screening.tables(part, formulas, part if prices is None else prices.where(inside), bt.calendar(part))
        found = screening.measured(spark, good, bad, pairs, periods)
        found = found.select(F.col(screening.KEY).alias("alpha_id"), F.col("status").alias("ran"), F.col("reason").alias("why"), "n_periods", *[F.col(a).alias(b) for a, b in METRICS.items()], "noise_risk")
        if pairs is None:
            found = found.select("*", *[F.lit(None).cast(t).alias(c) for c, t in CHECKS.items()])
        else:
            found = kept(found, shared_folder(spark, "metrics"))
            alive = F.broadcast(found.where((F.col("ran") == "ok") & ~_dead()).select(F.col("alpha_id").alias(screening.KEY)))  # at most BATCH rows
            kind = [x.join(alive, screening.KEY, "left_semi") for x in (pairs, periods)]
            found = found.join(robustness.checks(*kind, reg, shuffles).withColumnRenamed(screening.KEY, "alpha_id"), "alpha_id", "left")
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = {"alpha_id": "string", "ran": "string", "why": "string", "n_periods": "long", **dict.fromkeys(METRICS.values(), "double"), "noise_risk": "string"} | CHECKS
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in none.items()))
    zero = {c: F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")) if t.startswith("map") else F.lit(0.0) for c, t in CHECKS.items()}
    return out.withColumns({c: F.coalesce(c, F.when(F.col("ran") == "ok", v)) for c, v in zero.items()})


def run(configs: DataFrame, store: DataFrame | None, panel: DataFrame, prices: DataFrame | None = None, reg: DataFrame | None = None, force: bool = False, shuffles: int = 100) -> DataFrame:
    """One outcome a configuration: its columns with status, error, most_similar_id, similarity, metrics, checks, scores, verdict and reflection.

    store has alpha_id, formula, features and timestamp of earlier experiments. force runs duplicates too. Ids name one configuration
    each; a configuration without an id fails validation. Dates without a panel leave too few periods, which is a backtest_error.
    """
    spark = panel.sparkSession
    at = shared_folder(spark, "experiments")
    told = kept(fm.checked(shaped(configs)), f"{at}/checked")
    valid = told.where("valid")
    none = spark.createDataFrame([], RECORD_SCHEMA)
    seen = (none if store is None else store).select(F.col("alpha_id").cast("string"), "formula", F.col("features").cast("array<string>"), F.col("timestamp").cast("string"))
    near, _ = similarity.closest(valid.select(F.col("alpha_id").alias("candidate_id"), "formula", "features"), seen)
    near = near.withColumnRenamed("candidate_id", "alpha_id").withColumnRenamed("similarity_score", "similarity")
    copies = twins(valid.join(near.where("is_unique").select("alpha_id"), "alpha_id", "left_semi"))
    copied = spark.createDataFrame(list(copies.items()), "alpha_id string, _twin string")
    told = told.join(near, "alpha_id", "left").join(F.broadcast(copied), "alpha_id", "left")  # at most BATCH rows
    repeated = F.col("valid") & (~F.col("is_unique") | F.col("_twin").isNotNull())
    told = kept(told.withColumn("_repeated", F.coalesce(repeated, F.lit(False))), f"{at}/told")
    ask = told.where("valid" if force else "valid and not _repeated")
    found = told.join(kept(measured(ask, panel, prices, reg, shuffles), f"{at}/measured"), "alpha_id", "left")
    status = F.when(~F.col("valid"), "validation_failed").when(F.col("_repeated") & F.lit(not force), "duplicate").when(F.col("ran") == "ok", "completed").otherwise("backtest_error")
    kind = F.when(F.col("is_exact_duplicate"), "the same up to its sign").when(~F.col("is_unique"), F.format_string("structural similarity %.2f", "structural_similarity")).otherwise("repeats one of its batch")
    why = F.when(status == "validation_failed", F.array_join("errors", "; ")).when(status == "duplicate", kind).when(status == "backtest_error", F.col("why"))
    found = found.withColumns({"status": status, "error": why, "most_similar_id": F.coalesce("_twin", "most_similar_id")})
    found = scoring.scored(fm.described(found).drop("canonical", "shape", "cols"))
    found = found.withColumn("robustness", F.when(_dead(), F.lit(0.0)).otherwise(scoring.robustness())).withColumn("score", F.col("total"))
    done = F.col("status") == "completed"
    scores = ["performance", "implementation", "simplicity", "novelty", "robustness", "score", "predictive_magnitude", "direction_status", "fatal", "weakest", "verdict", "failure_reason"]
    found = me.reflected(found.withColumns({c: F.when(done, F.col(c)) for c in scores})).withColumn("reflection", F.when(done, F.col("reflection")))
    shown = ["n_periods", *METRICS.values(), "noise_risk", *CHECKS, "complexity", *scores, "reflection"]
    return kept(found.select(*CONFIG, "status", "error", "warnings", "most_similar_id", "similarity", *shown), f"{at}/outcomes")


def records(outcomes: DataFrame) -> DataFrame:
    """What the store keeps of outcomes."""
    return outcomes.where("status = 'completed'").drop("status", "error")


# the loop


class Research:
    """Rounds of experiments over a folder: records, posteriors of the arms, and formulas turned down.

    All three are written before the next round begins, so a loop that is stopped goes on where it was. A round draws `width` arms and
    runs their configurations as one batch. answer(prompt) and mutator(said) may be models; without them rules do the work.
    """

    def __init__(self, spark: SparkSession, folder: str, panel: DataFrame, prices: DataFrame | None = None, reg: DataFrame | None = None, answer: Callable[[str], str] | None = None, mutator: Callable[[list[str]], str] | None = None, base: dict | None = None, seed: int | None = None, shuffles: int = 100):
        self.spark, self.folder, self.panel, self.prices, self.reg = spark, folder.rstrip("/"), panel, prices, reg
        self.answer, self.mutator, self.base, self.rng, self.shuffles = answer, mutator, base or {}, random.Random(seed), shuffles
        self.store = me.Store(spark, f"{self.folder}/records")
        self.arms = me.Store(spark, f"{self.folder}/arms", "arm_id")
        self.refused = me.Store(spark, f"{self.folder}/refused", "formula")

    def _load(self, of: me.Store) -> DataFrame | None:
        return of.load() if exists(self.spark, of.path) else None

    def _version(self) -> int:
        """The number of rounds so far; each writes its arms."""
        if not exists(self.spark, self.arms.path):
            return 0
        return self.spark.read.parquet(self.arms.path).agg(F.max("_version")).first()[0]

    def posteriors(self) -> dict[str, tuple[float, float]]:
        """Kept posteriors of the eligible parents and of exploration; a parent that is new has its prior."""
        past, now = self._load(self.arms), self._load(self.store)
        old = {r.arm_id: (r.alpha, r.beta) for r in past.where(F.col("arm_id").isin([me.EXPLORE, *self._parents(now)])).collect()} if past is not None else {}
        fresh = {r.arm_id: (r.alpha, r.beta) for r in me.arms(now).collect()} if now is not None else {}
        return {me.EXPLORE: (2.0, 1.0)} | fresh | old

    def _parents(self, now: DataFrame | None) -> list[str]:
        return [] if now is None else [r.arm_id for r in me.arms(now).collect()]  # at most ARMS

    def _repeats(self, now: DataFrame | None, refused: set[str]) -> Callable[[str], str | None]:
        """Names the experiment that a formula repeats."""

        def other(formula: str) -> str | None:
            if formula in refused:
                return "a formula turned down"
            if now is None:
                return None
            r = fm.most_similar(fm.search(now, formula)).first()
            return None if r is None or r.is_unique is not False else r.most_similar_id

        return other

    def round(self, width: int = 1) -> DataFrame:
        """One batch: arms drawn, configurations made, run, rewarded and kept. Returns a row a pull: action, arm_id, alpha_id, status, reward."""
        number = self._version() + 1
        now, past = self._load(self.store), self._load(self.refused)
        refused: dict[str, set[str]] = {}
        for r in [] if past is None else past.collect():  # the formulas that this folder's rounds have turned down
            refused.setdefault(r.arm_id, set()).add(r.formula)
        known = self.posteriors()
        tried = 0 if now is None else now.count()
        drawn = [me.choose(known, tried, self.rng) for _ in range(width)]
        stamp, batch = datetime.now(UTC).isoformat(), f"round-{number:06d}"
        configs, pulls = [], []
        explore = drawn.count(me.EXPLORE)
        ideas: list[dict] = []
        if explore:
            explored = set() if now is None else {r.f for r in now.select(F.explode("features").alias("f")).distinct().collect()}  # feature names
            avoid = sorted(refused.get(me.EXPLORE, set()))
            repeats = self._repeats(now, set(avoid))
            ideas = me.plan(explored, explore, lambda f: repeats(f) is not None, self.answer, {"experiments": tried}, avoid)
        for i, arm in enumerate(drawn):
            name = f"{batch}-{i:03d}"
            try:
                if arm == me.EXPLORE:
                    if not ideas:
                        raise ValueError("the planner has no suggestion")
                    s = ideas.pop(0)
                    config = me.as_config(s, f"{name}-{re.sub(r'[^a-z0-9]+', '-', s['direction'].lower()).strip('-')}", batch, self.base)
                else:
                    parent = self.store.get(arm).first().asDict(True)
                    old = {c: parent[c] for c in CONFIG if parent.get(c) is not None}
                    config = me.child_of(old, {m: parent[m] for m in METRICS.values()}, self._repeats(now, refused.get(arm, set())), self.mutator) | {"alpha_id": name, "batch_id": batch}
            except Exception as e:  # a configuration that cannot be made costs its arm, not the round
                pulls.append((arm, None, "generation_failed", str(e)))
                continue
            config["timestamp"] = f"{stamp}#{i:03d}"
            configs.append(tuple(config.get(c) for c in CONFIG))
            pulls.append((arm, config["alpha_id"], None, None))
        frame = self.spark.createDataFrame(pulls, "arm_id string, alpha_id string, failed string, why string")
        if configs:
            outcomes = run(self.spark.createDataFrame(configs, ", ".join(f"{c} {t}" for c, t in CONFIG.items())), now, self.panel, self.prices, self.reg, shuffles=self.shuffles)
            write = self.spark.createDataFrame([(c[0], json.dumps(dict(zip(CONFIG, c, strict=True)), sort_keys=True)) for c in configs], "alpha_id string, config string")
            self.store.upsert(records(outcomes).join(F.broadcast(write), "alpha_id"), number)  # at most `width` rows
            result = outcomes.select("alpha_id", "status", "error", "formula", me.effective_score().alias("effective"))
        else:
            result = self.spark.createDataFrame([], "alpha_id string, status string, error string, formula string, effective double")
        x = frame.join(result, "alpha_id", "left").withColumns({"status": F.coalesce("failed", "status"), "error": F.coalesce("why", "error")})
        x = x.withColumns({"action": F.when(F.col("arm_id") == me.EXPLORE, "explore").otherwise("mutate"), "parent_id": F.when(F.col("arm_id") != me.EXPLORE, F.col("arm_id"))})
        before = self.spark.createDataFrame([], "alpha_id string, predictive_magnitude double, score double") if now is None else now.select("alpha_id", "predictive_magnitude", "score")
        x = kept(me.rewards(x.select("arm_id", "alpha_id", "action", "parent_id", "status", "error", "formula", "effective"), before), shared_folder(self.spark, "pulls"))
        turned_down = x.where("status = 'duplicate'").select("formula", "arm_id").dropDuplicates(["formula"])
        self.refused.upsert(turned_down, number)
        priors = self.spark.createDataFrame([(k, *v) for k, v in known.items()], "arm_id string, alpha double, beta double")
        self.arms.upsert(me.replay(x.select("arm_id", "reward"), priors).select("arm_id", "alpha", "beta"), number)
        if number % COMPACT == 0:
            for of in (self.store, self.arms, self.refused):
                if exists(self.spark, of.path):
                    of.compact()
        return x.withColumn("batch_id", F.lit(batch)).select("batch_id", "action", "arm_id", "alpha_id", "status", "error", "effective", "reward")

    def loop(self, rounds: int, width: int = 1, most_failures: int = 3) -> list[list]:
        """Rounds until the number is reached, or until the last most_failures pulls have all failed. The pulls of each round."""
        told, failures = [], 0
        for _ in range(rounds):
            pulls = self.round(width).orderBy("alpha_id").collect()  # at most `width`
            told.append(pulls)
            failures = 0 if any(p.status == "completed" for p in pulls) else failures + len(pulls)
            if failures >= most_failures:
                break
        return told
