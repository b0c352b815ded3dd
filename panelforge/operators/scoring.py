"""Scores of backtest metrics, as Column expressions over metric rows.

A metric row has IC_mean, ICIR, Sharpe, deflated_sharpe, monotonicity, turnover, max_drawdown; robustness columns are
subperiod_stability, placebo_score and regime_sharpe (a map).
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Anchors, weights and gates (fixed values).
RAMPS = {"IC_mean": (0.0, 0.02, 0.05), "ICIR": (0.0, 0.30, 1.0), "Sharpe": (0.0, 0.50, 1.5), "monotonicity": (-0.2, 0.3, 0.8), "max_drawdown": (-0.40, -0.25, -0.10), "regime": (-0.5, 0.0, 1.0)}
WEIGHTS = {"performance": 0.65, "implementation": 0.20, "simplicity": 0.10, "novelty": 0.05}
TURNOVER = (0.30, 0.70, 0.90)
COMPLEXITY = (4, 20)
FATAL_IC, FATAL_SHARPE, FATAL_DRAWDOWN = 0.005, 0.10, -0.40
PROMISING, REVISE = 65.0, 35.0


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def width(lo: float, hi: float) -> float:
    """hi - lo of the anchors as written: 0.1, where a difference of doubles may end on another last digit and move a score over a gate."""
    return float(Decimal(str(hi)) - Decimal(str(lo)))


def ramp(x: Column, lo: float, hi: float) -> Column:
    return clip01((x - lo) / width(lo, hi))


def ramp2(x: Column, lo: float, mid: float, hi: float) -> Column:
    """0 at lo, a half at mid, 1 at hi."""
    return F.when(x <= mid, 0.5 * ramp(x, lo, mid)).otherwise(0.5 + 0.5 * ramp(x, mid, hi))


def performance(magnitude: bool = False) -> Column:
    of = (lambda c: F.abs(F.col(c))) if magnitude else F.col
    sharpe = 0.7 * ramp2(of("Sharpe"), *RAMPS["Sharpe"]) + 0.3 * ramp2(of("deflated_sharpe"), *RAMPS["Sharpe"])
    return 0.30 * ramp2(of("IC_mean"), *RAMPS["IC_mean"]) + 0.25 * ramp2(of("ICIR"), *RAMPS["ICIR"]) + 0.30 * sharpe + 0.15 * ramp2(of("monotonicity"), *RAMPS["monotonicity"])


def turnover_score(x: Column) -> Column:
    good, most, worst = TURNOVER
    return F.when(x <= good, F.lit(1.0)).when(x <= most, 1 - 0.5 * ramp(x, good, most)).otherwise(0.5 - 0.5 * ramp(x, most, worst))


def implementation() -> Column:
    return 0.5 * turnover_score(F.col("turnover")) + 0.5 * ramp2(F.col("max_drawdown"), *RAMPS["max_drawdown"])


def robustness() -> Column:
    values = F.map_values("regime_sharpe")
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + ramp2(v, *RAMPS["regime"])) / F.size(values)
    regime = F.when(F.size(values) > 0, mean).otherwise(0.5)
    return F.coalesce((clip01(F.col("subperiod_stability")) + clip01(F.col("placebo_score")) + regime) / 3, F.lit(0.0))


def simplicity(complexity: Column) -> Column:
    return 1 - ramp(complexity.cast("double"), *COMPLEXITY)


def novelty(similarity: Column) -> Column:
    return clip01(1 - similarity)


def composite(parts: dict[str, Column]) -> Column:
    return 100 * reduce(lambda a, b: a + b, [w * parts[k] for k, w in WEIGHTS.items()])


def direction() -> Column:
    ic, sharpe = F.col("IC_mean"), F.col("Sharpe")
    dead = (F.abs(ic) < FATAL_IC) & (F.abs(sharpe) < FATAL_SHARPE)
    return F.when(dead, "uncertain").when((ic > 0) & (sharpe > 0), "supported").when((ic < 0) & (sharpe < 0), "contradicted").otherwise("uncertain")


def fatal() -> Column:
    dead = (F.abs("IC_mean") < FATAL_IC) & (F.abs("Sharpe") < FATAL_SHARPE)
    return dead | (F.col("max_drawdown") <= FATAL_DRAWDOWN)


def verdict(total: Column, is_fatal: Column) -> Column:
    return F.when(is_fatal, "failed").when(total >= PROMISING, "promising").when(total >= REVISE, "revise").otherwise("failed")


def weakest(parts: dict[str, Column]) -> Column:
    """The lowest sub-score's name; the first listed on a tie. Robustness is a diagnostic and has no part."""
    order = [k for k in WEIGHTS]
    return F.array_min(F.array(*[F.struct(parts[k].alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(order)]))["k"]


def scored(df, complexity: str = "complexity", similarity: str = "similarity"):
    """Metric rows with sub-scores, total, predictive_magnitude, direction_status, fatal, verdict and weakest."""
    parts = {"performance": F.col("performance"), "implementation": F.col("implementation"), "simplicity": F.col("simplicity"), "novelty": F.col("novelty")}
    df = df.withColumns({"performance": performance(), "magnitude": performance(True), "implementation": implementation(), "simplicity": simplicity(F.col(complexity)), "novelty": novelty(F.col(similarity))})
    df = df.withColumns({"total": composite(parts), "predictive_magnitude": composite(parts | {"performance": F.col("magnitude")}), "direction_status": direction(), "fatal": fatal(), "weakest": weakest(parts)})
    df = df.withColumn("verdict", verdict(F.col("total"), F.col("fatal")))
    return df.withColumn("failure_reason", reason(complexity, similarity)).drop("magnitude")


def number(x: Column | str, digits: int) -> Column:
    """A number as text; rounded off the halves, which engines round apart."""
    return F.format_string(f"%.{digits}f", F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, digits))


def reason(complexity: str = "complexity", similarity: str = "similarity") -> Column:
    """Why a scored row is not promising: its fatal gates, or its weakest part with what drives it; and a contradicted direction."""
    dead = (F.abs("IC_mean") < FATAL_IC) & (F.abs("Sharpe") < FATAL_SHARPE)
    gates = F.array_compact(
        F.array(
            F.when(dead, F.concat(F.lit("dead signal, IC "), number("IC_mean", 4), F.lit(", Sharpe "), number("Sharpe", 4))),
            F.when(F.col("max_drawdown") <= FATAL_DRAWDOWN, F.concat(F.lit("drawdown "), number("max_drawdown", 4))),
        )
    )
    value = F.when(F.col("weakest") == "performance", F.col("performance")).when(F.col("weakest") == "implementation", F.col("implementation")).when(F.col("weakest") == "simplicity", F.col("simplicity")).otherwise(F.col("novelty"))
    detail = F.when(F.col("weakest") == "simplicity", F.concat(F.lit(", complexity "), F.col(complexity).cast("string"))).when(F.col("weakest") == "novelty", F.concat(F.lit(", similarity "), number(similarity, 2))).otherwise("")
    low = F.concat(F.lit("score "), number("total", 1), F.lit(", weakest "), F.col("weakest"), F.lit(" "), number(value, 2), detail)
    turned = F.concat(F.lit("; direction contradicted, magnitude "), number("predictive_magnitude", 1), F.lit(" against "), number("total", 1))
    why = F.when(F.col("fatal"), F.concat(F.lit("fatal: "), F.array_join(gates, "; "))).when(F.col("verdict") != "promising", low)
    return F.when(why.isNotNull(), F.concat(why, F.when(F.col("direction_status") == "contradicted", turned).otherwise("")))


def tier_gates() -> tuple[Column, Column]:
    """The older gates, kept for comparison: predictive power, then implementation; each promising, revise or failed."""
    hard = (F.col("IC_mean") <= 0) | (F.col("ICIR") <= 0) | (F.col("monotonicity") <= -0.2)
    soft = (F.col("IC_mean") <= 0.02) | (F.col("ICIR") <= 0.3) | (F.col("monotonicity") <= 0.3)
    hard2 = (F.col("Sharpe") <= 0) | (F.col("max_drawdown") <= -0.40)
    soft2 = (F.col("Sharpe") <= 0.5) | (F.col("turnover") >= 0.7) | (F.col("max_drawdown") <= -0.25)
    return F.when(hard, "failed").when(soft, "revise").otherwise("promising"), F.when(hard2, "failed").when(soft2, "revise").otherwise("promising")
