"""Month-end long-short backtest of a signal: calendar, forward returns, rank IC, quantile bins, metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import nullsafe as ns
from panelforge.functions.tables import kept, shared_folder

BINS = 5
MIN_NAMES, MIN_RETURNS, MIN_SECTOR, MIN_PERIODS, MIN_SHUFFLED = 20, 10, 5, 3, 5


def month_end(date: Column) -> Column:
    """The last weekday of a date's month."""
    last = F.last_day(date)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))


def calendar(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """date, next_date: the last panel date at or before each business month end between start and end."""
    days = panel.select("date").distinct()
    if start:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        days = days.where(F.col("date") <= F.lit(end).cast("date"))
    # a month counts once its own business month end is within the range
    hi = F.lit(end).cast("date") if end else F.max("date").over(Window.partitionBy(F.lit(0)))
    bounds = days.withColumn("hi", hi).withColumn("bme", month_end(F.col("date"))).where("bme <= hi and date <= bme")
    dates = bounds.groupBy("bme").agg(F.max("date").alias("date")).select("date").distinct()
    return dates.withColumn("next_date", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")))  # one row a month


def forward_returns(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """date, ticker, fwd: price at the next rebalance over price now, less 1; missing dropped."""
    px = prices.select("date", "ticker", F.col("adjusted_price").alias("p"))
    dates = F.broadcast(dates.where("next_date is not null"))  # one row a month
    now = px.join(dates, "date")
    later = px.select(F.col("date").alias("next_date"), "ticker", F.col("p").alias("p2"))
    out = now.join(later, ["next_date", "ticker"]).select("date", "ticker", (ns.divide(F.col("p2"), F.col("p")) - 1).alias("fwd"))
    return out.where("fwd is not null")


def aligned(signal: DataFrame, prices: DataFrame, dates: DataFrame, strict: bool = False) -> DataFrame:
    """Signal and forward return of the periods that pass the gates. strict: skip a period with an unpriced name."""
    at = signal.join(F.broadcast(dates.where("next_date is not null").select("date")), "date", "left_semi")
    w = Window.partitionBy("date")
    at = at.withColumn("n_signal", F.count(F.lit(1)).over(w)).where(F.col("n_signal") >= MIN_NAMES)
    if strict:
        unpriced = at.join(prices.where("adjusted_price is not null").select("ticker").distinct(), "ticker", "left_anti").select("date").distinct()
        at = at.join(unpriced, "date", "left_anti")
    both = at.join(forward_returns(prices, dates), ["date", "ticker"])
    return both.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= MIN_RETURNS).select("date", "ticker", "sector", "signal", "fwd", "n")


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    """Rank correlation by keys, ties at mean rank; null where a side is constant."""
    by = [F.col(k) for k in keys]
    ranked = df.select(*keys, ns.average_rank(F.col(x), *by).alias("_x"), ns.average_rank(F.col(y), *by).alias("_y"))
    return ranked.groupBy(*keys).agg(ns.pearson(F.col("_x"), F.col("_y")).alias(name))


def ic(pairs: DataFrame) -> DataFrame:
    return spearman(pairs, ["date"], "signal", "fwd", "ic").where("ic is not null")


def sector_ic(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("date", "sector")
    enough = pairs.where("sector is not null").withColumn("k", F.count(F.lit(1)).over(w)).where(F.col("k") >= MIN_SECTOR)
    return spearman(enough, ["date", "sector"], "signal", "fwd", "ic").where("ic is not null")


def binned(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """pairs with bin (right-closed quantile intervals on distinct cuts) and k, the number of bins of the date."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cut = pairs.withColumn("_cuts", F.array_distinct(F.percentile("signal", shares).over(Window.partitionBy("date"))))
    bin_ = F.lit(1) + F.size(F.filter("_cuts", lambda c: c < F.col("signal")))
    return cut.withColumn("bin", bin_).withColumn("k", F.size("_cuts") + 1).drop("_cuts")


def _quantiles(bins: int) -> list[Column]:
    return [F.coalesce(F.avg(F.when(F.col("bin") == i, F.col("fwd"))), F.lit(0.0)).alias(f"q{i}") for i in range(1, bins + 1)]


def _port(bins: int) -> Column:
    return F.element_at(F.array(*[F.col(f"q{i}") for i in range(1, bins + 1)]), F.greatest("k", F.lit(1))) - F.col("q1")


def bin_returns(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """date, q1..q5 (an empty bin is 0.0), k and port_ret (top bin less bottom bin)."""
    out = binned(pairs, bins).groupBy("date").agg(F.max("k").alias("k"), *_quantiles(bins))
    return out.withColumn("port_ret", _port(bins))


def ranked(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """binned pairs with the ranks of signal and return on their date: all by one exchange on the date."""
    by = F.col("date")
    return binned(pairs, bins).withColumns({"rank_signal": ns.average_rank(F.col("signal"), by), "rank_fwd": ns.average_rank(F.col("fwd"), by)})


def periods_of(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """One row a valid period of ranked pairs: date, n, ic, q1..q5, k, port_ret."""
    out = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), ns.pearson(F.col("rank_signal"), F.col("rank_fwd")).alias("ic"), F.max("k").alias("k"), *_quantiles(bins))
    return out.where("ic is not null").withColumn("port_ret", _port(bins)).select("date", "ic", "n", "k", *[f"q{i}" for i in range(1, bins + 1)], "port_ret")


def periods(pairs: DataFrame) -> DataFrame:
    """One row a valid period: date, n, ic, q1..q5, k, port_ret."""
    return periods_of(ranked(pairs))


def degenerate(per: DataFrame, bins: int = BINS) -> DataFrame:
    """periods, degraded (those with fewer than the wanted bins) and a warning, or null: the signal hardly tells names apart."""
    x = per.agg(F.count(F.lit(1)).alias("periods"), F.count_if(F.col("k") < bins).alias("degraded"))
    share = F.round(100 * F.col("degraded") / F.col("periods") + 1e-9).cast("int")
    return x.withColumn("warning", F.when(F.col("degraded") > 0, F.format_string(f"fewer than {bins} bins in %d of %d periods (%d%%): many names share a signal", "degraded", "periods", share)))


def drawdown(per: DataFrame, r: str = "port_ret") -> DataFrame:
    """date, equity, drawdown; the running peak starts with the first period."""
    so_far = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    eq = per.withColumn("equity", F.product(1 + F.col(r)).over(so_far))
    return eq.select("date", "equity", (F.col("equity") / F.max("equity").over(so_far) - 1).alias("drawdown"))


def turnover(pairs: DataFrame) -> DataFrame:
    """date, side, replaced: the share of the last valid period's top or bottom bin that is gone."""
    return turnover_of(binned(pairs))


def turnover_of(rows: DataFrame) -> DataFrame:
    """``turnover`` of binned pairs. Names meet themselves one period later; no set of names is ever gathered."""
    sides = F.array_compact(F.array(F.when(F.col("bin") == F.col("k"), F.lit("top")), F.when(F.col("bin") == 1, F.lit("bottom"))))
    held = rows.select("date", "ticker", F.explode(sides).alias("side"))
    dates = rows.select("date").distinct()
    after = F.broadcast(dates.withColumn("next", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))).where("next is not null"))  # one row a month
    was = held.join(after, "date").select(F.col("next").alias("date"), "side", "ticker")
    both = was.join(held.withColumn("stays", F.lit(1)), ["date", "side", "ticker"], "left")
    return both.groupBy("date", "side").agg((1 - F.count("stays") / F.count(F.lit(1))).alias("replaced"))


def monotonicity(per: DataFrame, bins: int = BINS) -> DataFrame:
    """date, mono: rank correlation of bin number and bin return."""
    long = per.select("date", F.posexplode(F.array(*[F.col(f"q{i}") for i in range(1, bins + 1)])).alias("i", "r"))
    return spearman(long.withColumn("i", F.col("i").cast("double")), ["date"], "i", "r", "mono").where("mono is not null")


def deflated(per: DataFrame, r: str = "port_ret") -> DataFrame:
    """sharpe and deflated_sharpe in one row."""
    per = per.select(r)
    m = per.agg(F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.count(r).alias("n"))
    z = per.crossJoin(F.broadcast(m)).withColumn("z", (F.col(r) - F.col("m")) / (F.col("s") + 1e-9))  # m is one row
    x = z.groupBy("m", "s", "n").agg(F.avg(F.pow("z", F.lit(3))).alias("skew"), F.avg(F.pow("z", F.lit(4))).alias("kurt"))
    sharpe = F.col("m") / (F.col("s") + 1e-9) * F.sqrt(F.lit(12.0))
    x = x.withColumn("sharpe", sharpe)
    var = (1 + 0.5 * F.pow("sharpe", F.lit(2)) - F.col("skew") * F.col("sharpe") + ((F.col("kurt") - 3) / 4) * F.pow("sharpe", F.lit(2))) / (F.col("n") - 1)
    return x.select("n", "sharpe", F.when(F.col("n") < 4, F.lit(0.0)).otherwise(F.col("sharpe") - F.sqrt(F.greatest(var, F.lit(0.0)))).alias("deflated_sharpe"), "skew", "kurt")


def noise_risk(sharpe: Column, deflated_sharpe: Column) -> Column:
    ratio = F.try_divide(deflated_sharpe, sharpe)
    return F.when(sharpe <= 0, "high").when(ratio < 0.5, "high").when(ratio < 0.75, "medium").otherwise("low")


def metrics(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """One row with the backtest's metrics; an error with fewer than MIN_PERIODS valid periods.

    The pairs are evaluated once, into a table with bins and ranks that all metrics read.
    """
    at = shared_folder(pairs.sparkSession, "backtest")
    rows = kept(ranked(pairs).select("date", "ticker", "fwd", "bin", "k", "rank_signal", "rank_fwd"), f"{at}/pairs")
    per = kept(periods_of(rows).coalesce(1), f"{at}/periods")  # one row a month
    a = per.agg(F.avg("ic").alias("IC_mean"), (F.avg("ic") / (F.stddev_samp("ic") + 1e-9)).alias("ICIR"), F.avg("port_ret").alias("Q5_Q1_return"), F.count(F.lit(1)).alias("n_periods"))
    dd = drawdown(per).agg(F.min("drawdown").alias("max_drawdown"))
    valid = rows.join(F.broadcast(per.select("date")), "date", "left_semi")  # one row a month
    to = turnover_of(valid).groupBy("side").agg(F.avg("replaced").alias("x")).agg(F.avg("x").alias("turnover"))
    mono = monotonicity(per).agg(F.coalesce(F.avg("mono"), F.lit(0.0)).alias("monotonicity"))
    shape = deflated(per).select("sharpe", "deflated_sharpe").agg(F.max("sharpe").alias("sharpe"), F.max("deflated_sharpe").alias("deflated_sharpe"))  # one row, also without periods
    one = a.crossJoin(shape).crossJoin(dd).crossJoin(to).crossJoin(mono)  # each side is one row
    names = ["IC_mean", "ICIR", "sharpe", "deflated_sharpe", "monotonicity", "turnover", "max_drawdown", "Q5_Q1_return"]
    few = F.raise_error(F.format_string(f"the backtest has %d valid periods, fewer than {MIN_PERIODS}: check the dates and the data", "n_periods"))
    n = F.when(F.col("n_periods") >= MIN_PERIODS, F.col("n_periods")).otherwise(few.cast("long"))
    return one.select(n.alias("n_periods"), *[F.round(c, digits).alias(c) for c in names], noise_risk(F.col("sharpe"), F.col("deflated_sharpe")).alias("noise_risk"))


# robustness


def subperiod_stability(per: DataFrame) -> DataFrame:
    """1 - |a - b| / (|a| + |b|) of the two halves' mean IC, clipped; 0.5 with under four periods."""
    w = Window.partitionBy(F.lit(0))
    x = per.select("ic", F.row_number().over(w.orderBy("date")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    half = F.floor(F.col("n") / 2)
    x = x.agg(F.max("n").alias("n"), F.avg(F.when(F.col("i") <= half, F.col("ic"))).alias("a"), F.avg(F.when(F.col("i") > half, F.col("ic"))).alias("b"))
    value = 1 - F.abs(F.col("a") - F.col("b")) / (F.abs("a") + F.abs("b") + 1e-9)
    return x.select(F.when(F.col("n") < 4, F.lit(0.5)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("subperiod_stability"))


def regimes(index: DataFrame) -> DataFrame:
    """date (business month end), bull, high_vol, low_vol, neutral_vol from daily index_close and vol_close."""
    m = index.groupBy(month_end(F.col("date")).alias("date")).agg(F.max_by("index_close", "date").alias("i"), F.max_by("vol_close", "date").alias("v"))
    w = Window.partitionBy(F.lit(0))
    m = m.withColumn("trend", ns.divide(F.col("i"), F.lag("i", 12).over(w.orderBy("date"))) - 1).withColumn("q", F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).over(w))
    high, low = F.col("v") > F.col("q")[1], F.col("v") < F.col("q")[0]
    return m.select("date", F.coalesce(F.col("trend") > 0, F.lit(False)).alias("bull"), high.alias("high_vol"), low.alias("low_vol"), (~high & ~low).alias("neutral_vol"))


def regime_sharpe(per: DataFrame, reg: DataFrame) -> DataFrame:
    """regime, n, sharpe for the regimes with at least three periods."""
    x = per.join(reg, "date")
    flags = F.array(*[F.struct(F.lit(k).alias("regime"), v.alias("on")) for k, v in (("bull", F.col("bull")), ("bear", ~F.col("bull")), ("high_vol", F.col("high_vol")), ("low_vol", F.col("low_vol")), ("neutral_vol", F.col("neutral_vol")))])
    x = x.select("port_ret", F.explode(flags).alias("f")).where("f.on").groupBy(F.col("f.regime").alias("regime"))
    out = x.agg(F.count(F.lit(1)).alias("n"), (F.avg("port_ret") / (F.stddev_samp("port_ret") + 1e-9) * F.sqrt(F.lit(12.0))).alias("sharpe"))
    return out.where("n >= 3")


def placebo(pairs: DataFrame, mean_ic: float | None = None, shuffles: int = 100, seed: int = 42) -> DataFrame:
    """1 - mean |IC of shuffled signals| / |mean IC|. A date's cross-section is ranked once; shuffles permute the ranks.

    The permutations of a date come from (seed, date) and the order of its tickers: the same in every run and on any cluster.
    """
    by = F.col("date")
    ranks = pairs.select("date", "ticker", ns.average_rank(F.col("signal"), by).alias("x"), ns.average_rank(F.col("fwd"), by).alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker", kind="stable")
        x, y = (pdf[c].to_numpy(float) - pdf[c].mean() for c in ("x", "y"))
        size = math.sqrt(float(x @ x) * float(y @ y))
        if len(x) < MIN_SHUFFLED or not size:
            return pd.DataFrame({"noise": []}, dtype=float)
        rng = np.random.default_rng([seed, pd.Timestamp(pdf["date"].iloc[0]).toordinal()])
        return pd.DataFrame({"noise": [np.mean([abs(x[rng.permutation(len(x))] @ y) / size for _ in range(shuffles)])]})

    noise = ranks.groupBy("date").applyInPandas(run, "noise double").agg(F.avg("noise").alias("noise"))
    mean = ic(pairs).agg(F.abs(F.avg("ic")).alias("m")) if mean_ic is None else noise.sparkSession.range(1).select(F.lit(abs(mean_ic)).alias("m"))
    value = 1 - F.col("noise") / (F.col("m") + 1e-9)
    return noise.crossJoin(mean).select(F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("placebo_score"))  # one row each


def placebo_exact(pairs: DataFrame, shuffles: int = 100, seed: int = 42) -> DataFrame:
    """``placebo`` with permutations that SQL can state: in shuffle s, a date's names are put in the order of the MD5 of
    ``seed:s:date:ticker``, and the i-th of them lends its signal to the i-th name by ticker. No rows meet in Python."""
    by = F.col("date")
    place = F.row_number().over(Window.partitionBy("date").orderBy("ticker"))
    ranks = pairs.select("date", "ticker", ns.average_rank(F.col("signal"), by).alias("x"), ns.average_rank(F.col("fwd"), by).alias("y"), place.alias("i"))
    ranks = kept(ranks, shared_folder(pairs.sparkSession, "placebo"))
    each = ranks.select("date", "ticker", "x", F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("s"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("s").cast("string"), F.date_format("date", "yyyy-MM-dd"), F.col("ticker").cast("string")))
    moved = each.select("date", "s", "x", F.row_number().over(Window.partitionBy("date", "s").orderBy(mark, "ticker")).alias("i"))
    shuffled = moved.join(ranks.select("date", "i", "y"), ["date", "i"]).groupBy("date", "s").agg(F.abs(ns.pearson(F.col("x"), F.col("y"))).alias("r"), F.count(F.lit(1)).alias("n"))
    noise = shuffled.where(F.col("r").isNotNull() & (F.col("n") >= MIN_SHUFFLED)).groupBy("date").agg(F.avg("r").alias("r")).agg(F.avg("r").alias("noise"))
    mean = ranks.groupBy("date").agg(ns.pearson(F.col("x"), F.col("y")).alias("ic")).where("ic is not null").agg(F.abs(F.avg("ic")).alias("m"))
    value = 1 - F.col("noise") / (F.col("m") + 1e-9)
    return noise.crossJoin(mean).select(F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("placebo_score"))  # one row each
