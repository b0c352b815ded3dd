"""Robustness of many formulas at once: the formula is a key through every check.

All checks read the pairs and periods that ``screening.tables`` has written, so that nothing is evaluated again. The checks are
those of ``backtest`` for one formula: IC by sector, agreement of the two halves of time, Sharpe by market regime, and the IC of
shuffled signals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import backtest as bt
from panelforge.operators.screening import KEY

REGIMES = ["bull", "bear", "high_vol", "low_vol", "neutral_vol"]
MIN_REGIME = 3


def sector_ic(rows: DataFrame) -> DataFrame:
    """formula_id, sector, ic: the mean over dates of the rank IC within a sector."""
    w = Window.partitionBy(KEY, "date", "sector")
    enough = rows.where("sector is not null").withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= bt.MIN_SECTOR)
    # ranks within a sector are the same from a date's ranks as from the values
    each = bt.spearman(enough, [KEY, "date", "sector"], "rank_signal", "rank_fwd", "ic").where("ic is not null")
    return each.groupBy(KEY, "sector").agg(F.avg("ic").alias("ic"))


def subperiod_stability(per: DataFrame) -> DataFrame:
    """formula_id, subperiod_stability."""
    w = Window.partitionBy(KEY)
    x = per.select(KEY, "ic", F.row_number().over(w.orderBy("date")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))  # one row a month
    half = F.floor(F.col("n") / 2)
    x = x.groupBy(KEY).agg(F.max("n").alias("n"), F.avg(F.when(F.col("i") <= half, F.col("ic"))).alias("a"), F.avg(F.when(F.col("i") > half, F.col("ic"))).alias("b"))
    value = 1 - F.abs(F.col("a") - F.col("b")) / (F.abs("a") + F.abs("b") + 1e-9)
    return x.select(KEY, F.when(F.col("n") < 4, F.lit(0.5)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("subperiod_stability"))


def regime_sharpe(per: DataFrame, reg: DataFrame) -> DataFrame:
    """formula_id, regime, n, sharpe of the regimes with at least MIN_REGIME periods."""
    x = per.select(KEY, "date", "port_ret").join(F.broadcast(reg), "date")  # one row a month
    on = [F.col("bull"), ~F.col("bull"), *map(F.col, REGIMES[2:])]
    flags = F.explode(F.array(*[F.struct(F.lit(k).alias("regime"), v.alias("on")) for k, v in zip(REGIMES, on, strict=True)])).alias("f")
    x = x.select(KEY, "port_ret", flags).where("f.on").groupBy(KEY, F.col("f.regime").alias("regime"))
    out = x.agg(F.count(F.lit(1)).alias("n"), (F.avg("port_ret") / (F.stddev_samp("port_ret") + 1e-9) * F.sqrt(F.lit(12.0))).alias("sharpe"))
    return out.where(F.col("n") >= MIN_REGIME)


def placebo(rows: DataFrame, per: DataFrame, shuffles: int = 100, seed: int = 42) -> DataFrame:
    """formula_id, placebo_score. A group is one formula's cross-section on one date; permutations come from (seed, date)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker", kind="stable")
        x, y = (pdf[c].to_numpy(float) - pdf[c].mean() for c in ("rank_signal", "rank_fwd"))
        size = math.sqrt(float(x @ x) * float(y @ y))
        if len(x) < bt.MIN_SHUFFLED or not size:
            return pd.DataFrame({KEY: [], "noise": []}).astype({KEY: str, "noise": float})
        rng = np.random.default_rng([seed, pd.Timestamp(pdf["date"].iloc[0]).toordinal()])
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "noise": [np.mean([abs(x[rng.permutation(len(x))] @ y) / size for _ in range(shuffles)])]})

    ranks = rows.select(KEY, "date", "ticker", "rank_signal", "rank_fwd")
    noise = ranks.groupBy(KEY, "date").applyInPandas(run, f"{KEY} string, noise double").groupBy(KEY).agg(F.avg("noise").alias("noise"))
    mean = per.groupBy(KEY).agg(F.abs(F.avg("ic")).alias("m"))
    value = 1 - F.col("noise") / (F.col("m") + 1e-9)
    return mean.join(noise, KEY, "left").select(KEY, F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("placebo_score"))


def checks(rows: DataFrame, per: DataFrame, reg: DataFrame | None = None, shuffles: int = 100) -> DataFrame:
    """formula_id, sector_ic and regime_sharpe (maps), subperiod_stability, placebo_score: a row for each formula with a period.

    Without a regime series, regime_sharpe is empty.
    """
    mapped = lambda df, k, v, name: df.groupBy(KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(name))  # noqa: E731  (sectors, regimes: few)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    out = subperiod_stability(per).join(placebo(rows, per, shuffles), KEY, "left")
    out = out.join(mapped(sector_ic(rows), "sector", "ic", "sector_ic"), KEY, "left")
    if reg is None:
        out = out.withColumn("regime_sharpe", empty)
    else:
        out = out.join(mapped(regime_sharpe(per, reg), "regime", "sharpe", "regime_sharpe"), KEY, "left")
    return out.select(KEY, F.coalesce("sector_ic", empty).alias("sector_ic"), F.coalesce("regime_sharpe", empty).alias("regime_sharpe"), "subperiod_stability", "placebo_score")
