"""Many formulas backtested in one plan: the formula is a key from the signal to the metrics.

All formulas are compiled together, so equal subtrees are one column and all windows of a stage share an exchange by ticker and
one by date, however many formulas there are. Only rebalance dates go on; there the forward return is attached once, and the
formulas' values become rows of (formula, date, ticker). From here every step is keyed by formula and date: one exchange for
winsorising, standardising, gates, bins and ranks together, then one row a formula and period.

Formulas that do not compile, or have fewer valid periods than a backtest needs, get a row that says so; they do not stop the
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import nullsafe as ns
from panelforge.functions.tables import kept, shared_folder
from panelforge.operators import backtest as bt
from panelforge.plans import compiler

KEY = "formula_id"
NAMES = ["IC_mean", "ICIR", "sharpe", "deflated_sharpe", "monotonicity", "turnover", "max_drawdown", "Q5_Q1_return"]
#: Columns of one plan. More formulas than this run in several plans over the same panel.
AT_ONCE = 64


def compiled(panel: DataFrame, formulas: dict[str, str]) -> tuple[list[str], dict[str, str]]:
    """The formulas that compile on the panel, and why the others do not."""
    good, bad = [], {}
    for name, formula in formulas.items():
        try:
            compiler.Compiler(panel).add(formula, "_")
        except (compiler.FormulaError, ValueError, TypeError, KeyError) as e:
            bad[name] = str(e)
        else:
            good.append(name)
    return good, bad


def values_at(panel: DataFrame, formulas: dict[str, str], dates: DataFrame, prices: DataFrame) -> DataFrame:
    """formula_id, date, ticker, sector, fwd and each formula's raw value, at the rebalance dates alone."""
    columns = {f"_f{i}": name for i, name in enumerate(formulas)}
    wide = compiler.evaluate(panel, {c: formulas[name] for c, name in columns.items()}).select("date", "ticker", "sector", *columns)
    wide = wide.join(F.broadcast(dates.where("next_date is not null").select("date")), "date", "left_semi")  # one row a month
    wide = wide.join(bt.forward_returns(prices, dates), ["date", "ticker"], "left")
    long = F.explode(F.array(*[F.struct(F.lit(name).alias(KEY), F.col(c).alias("raw")) for c, name in columns.items()])).alias("v")
    return wide.select("date", "ticker", "sector", "fwd", long).select(f"v.{KEY}", "date", "ticker", "sector", "fwd", "v.raw")


def signals(values: DataFrame) -> DataFrame:
    """values with ``signal``, winsorised and standardised within formula and date; rows without one go."""
    w = Window.partitionBy(KEY, "date")
    x = ns.finite(F.col("raw"))
    cuts = F.percentile(x, F.array(F.lit(0.01), F.lit(0.99))).over(w)
    out = values.withColumn("_cuts", cuts).withColumn("_x", F.when(x.isNotNull(), F.least(F.greatest(x, F.col("_cuts")[0]), F.col("_cuts")[1])))
    sd = F.stddev_samp("_x").over(w)
    signal = (F.col("_x") - F.avg("_x").over(w)) / (F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd) + 1e-9)
    return out.withColumn("signal", signal).where("signal is not null").drop("_cuts", "_x", "raw")


def pairs(signal: DataFrame, bins: int = bt.BINS) -> DataFrame:
    """Signal and return of the periods that pass the gates, with bin, number of bins and ranks."""
    w = Window.partitionBy(KEY, "date")
    both = signal.withColumn("_named", F.count(F.lit(1)).over(w)).where(F.col("_named") >= bt.MIN_NAMES).where("fwd is not null")
    both = both.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= bt.MIN_RETURNS)
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    both = both.withColumn("_cuts", F.array_distinct(F.percentile("signal", shares).over(w)))
    both = both.withColumn("bin", 1 + F.size(F.filter("_cuts", lambda c: c < F.col("signal")))).withColumn("k", F.size("_cuts") + 1)
    by = [F.col(KEY), F.col("date")]
    ranks = {"rank_signal": ns.average_rank(F.col("signal"), *by), "rank_fwd": ns.average_rank(F.col("fwd"), *by)}
    return both.withColumns(ranks).select(KEY, "date", "ticker", "sector", "fwd", "bin", "k", *ranks)


def periods(rows: DataFrame, bins: int = bt.BINS) -> DataFrame:
    """One row a formula and valid period."""
    quantiles = [F.coalesce(F.avg(F.when(F.col("bin") == i, F.col("fwd"))), F.lit(0.0)).alias(f"q{i}") for i in range(1, bins + 1)]
    out = rows.groupBy(KEY, "date").agg(F.count(F.lit(1)).alias("n"), ns.pearson(F.col("rank_signal"), F.col("rank_fwd")).alias("ic"), F.max("k").alias("k"), *quantiles)
    spread = F.element_at(F.array(*[F.col(f"q{i}") for i in range(1, bins + 1)]), F.greatest("k", F.lit(1))) - F.col("q1")
    return out.where("ic is not null").withColumn("port_ret", spread)


def replaced(rows: DataFrame, per: DataFrame) -> DataFrame:
    """formula_id, turnover: the mean share of names that left the top and the bottom bin, over periods and sides."""
    next_of = F.lead("date").over(Window.partitionBy(KEY).orderBy("date"))  # one row a month
    after = per.select(KEY, "date", next_of.alias("_next"))
    sides = F.array_compact(F.array(F.when(F.col("bin") == F.col("k"), F.lit("top")), F.when(F.col("bin") == 1, F.lit("bottom"))))
    held = rows.select(KEY, "date", "ticker", F.explode(sides).alias("side")).join(after, [KEY, "date"])
    was = held.where("_next is not null").select(KEY, F.col("_next").alias("date"), "side", "ticker")
    both = was.join(held.select(KEY, "date", "side", "ticker", F.lit(1).alias("_stays")), [KEY, "date", "side", "ticker"], "left")
    each = both.groupBy(KEY, "date", "side").agg((1 - F.count("_stays") / F.count(F.lit(1))).alias("x"))
    return each.groupBy(KEY, "side").agg(F.avg("x").alias("x")).groupBy(KEY).agg(F.avg("x").alias("turnover"))


def summary(per: DataFrame, bins: int = bt.BINS) -> DataFrame:
    """One row a formula of all metrics but turnover."""
    whole = Window.partitionBy(KEY)
    so_far = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    r = F.col("port_ret")
    x = per.withColumn("_m", F.avg(r).over(whole)).withColumn("_s", F.stddev_samp(r).over(whole)).withColumn("_z", (r - F.col("_m")) / (F.col("_s") + 1e-9))
    x = x.withColumn("_equity", F.product(1 + r).over(so_far)).withColumn("_fall", F.col("_equity") / F.max("_equity").over(so_far) - 1)
    q = F.array(*[F.col(f"q{i}") for i in range(1, bins + 1)])
    # the rank correlation of five numbers with 1 to 5, from counts of smaller and equal ones
    rank = F.transform(q, lambda a: F.size(F.filter(q, lambda b: b < a)) + (F.size(F.filter(q, lambda b: b == a)) + 1) / F.lit(2.0))
    middle = (bins + 1) / 2
    number = F.array(*[F.lit(float(i)) for i in range(1, bins + 1)])
    product = F.aggregate(F.zip_with(rank, number, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda s, v: s + v)
    square = F.aggregate(F.transform(rank, lambda a: (a - middle) * (a - middle)), F.lit(0.0), lambda s, v: s + v)
    x = x.withColumn("_mono", F.when(square > 0, product / (F.sqrt(square) * (sum((i - middle) ** 2 for i in range(1, bins + 1))) ** 0.5)))
    a = x.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.avg("ic").alias("IC_mean"),
        (F.avg("ic") / (F.stddev_samp("ic") + 1e-9)).alias("ICIR"),
        F.avg(r).alias("Q5_Q1_return"),
        (F.avg(r) / (F.stddev_samp(r) + 1e-9) * F.sqrt(F.lit(12.0))).alias("sharpe"),
        F.avg(F.pow("_z", F.lit(3))).alias("_skew"),
        F.avg(F.pow("_z", F.lit(4))).alias("_kurt"),
        F.min("_fall").alias("max_drawdown"),
        F.coalesce(F.avg("_mono"), F.lit(0.0)).alias("monotonicity"),
    )
    variance = (1 + 0.5 * F.pow("sharpe", F.lit(2)) - F.col("_skew") * F.col("sharpe") + ((F.col("_kurt") - 3) / 4) * F.pow("sharpe", F.lit(2))) / (F.col("n_periods") - 1)
    deflated = F.when(F.col("n_periods") < 4, F.lit(0.0)).otherwise(F.col("sharpe") - F.sqrt(F.greatest(variance, F.lit(0.0))))
    return a.withColumn("deflated_sharpe", deflated).drop("_skew", "_kurt")


def tables(panel: DataFrame, formulas: dict[str, str], prices: DataFrame | None = None, dates: DataFrame | None = None) -> tuple[list[str], dict[str, str], DataFrame | None, DataFrame | None]:
    """The formulas that compile, why the others do not, and the written pairs and periods of the former; None if none compiles."""
    prices, dates = panel if prices is None else prices, bt.calendar(panel) if dates is None else dates
    good, bad = compiled(panel, formulas)
    rows = None
    for a in range(0, len(good), AT_ONCE):
        some = pairs(signals(values_at(panel, {n: formulas[n] for n in good[a : a + AT_ONCE]}, dates, prices)))
        rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        return good, bad, None, None
    at = shared_folder(panel.sparkSession, "screening")
    rows = kept(rows, f"{at}/pairs")
    return good, bad, rows, kept(periods(rows), f"{at}/periods")


def measured(spark: SparkSession, good: list[str], bad: dict[str, str], rows: DataFrame | None, per: DataFrame | None, digits: int = 4) -> DataFrame:
    """The metric rows of what ``tables`` gives."""
    out = spark.createDataFrame([(n, "invalid", why) for n, why in bad.items()], f"{KEY} string, status string, reason string")
    if rows is None:
        return out.select(KEY, "status", "reason", F.lit(None).cast("long").alias("n_periods"), *[F.lit(None).cast("double").alias(c) for c in NAMES], F.lit(None).cast("string").alias("noise_risk"))
    asked = spark.createDataFrame([(n,) for n in good], f"{KEY} string")
    found = asked.join(summary(per), KEY, "left").join(replaced(rows, per), KEY, "left").withColumn("n_periods", F.coalesce("n_periods", F.lit(0)))
    enough = F.col("n_periods") >= bt.MIN_PERIODS
    value = lambda c: F.when(enough, F.round(c, digits)).alias(c)
    reason = F.when(~enough, F.format_string(f"%d valid periods, fewer than {bt.MIN_PERIODS}", "n_periods"))
    risk: Column = F.when(enough, bt.noise_risk(F.col("sharpe"), F.col("deflated_sharpe")))
    found = found.select(KEY, F.when(enough, "ok").otherwise("few periods").alias("status"), reason.alias("reason"), "n_periods", *[value(c) for c in NAMES], risk.alias("noise_risk"))
    return found.unionByName(out, allowMissingColumns=True)


def screen(panel: DataFrame, formulas: dict[str, str], prices: DataFrame | None = None, dates: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """formula_id, status (ok, few periods, invalid), reason, n_periods, the metrics and noise_risk: a row for each formula."""
    return measured(panel.sparkSession, *tables(panel, formulas, prices, dates), digits)
