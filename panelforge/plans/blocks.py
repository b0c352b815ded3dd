"""Rolling windows in time linear in the history, whatever their length.

Spark evaluates a sliding frame anew for each row, in time proportional to its length. Here a ticker's rows are cut into blocks
of n. A window of n rows is then the end of one block and the beginning of the next, and running aggregates from either end
of each block, one step a row, give both. They are merged, not subtracted, so nothing cancels: sums add, extremes compare,
and variances and covariances follow the rule for two groups. The blocks lie within tickers, so no exchange is added.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelforge.functions import nullsafe as ns
from panelforge.functions.registry import DATE, TICKER, wt

#: Windows of at least this many rows go by blocks; shorter ones are cheap as they are.
LEAST = 48


def fold_rank(x: pd.Series, n: int) -> pd.Series:
    """Rank of the last value among the last n, ties at their mean rank, over n; a sorted list follows the window."""
    v = x.replace([np.inf, -np.inf], np.nan).to_numpy()
    out, held = np.full(len(v), np.nan), []
    for i, a in enumerate(v):
        if i >= n and v[i - n] == v[i - n]:
            del held[bisect_left(held, v[i - n])]
        if a == a:
            insort(held, a)
            if len(held) == n:
                low = bisect_left(held, a)
                out[i] = (low + (bisect_right(held, a) - low + 1) / 2) / n
    return pd.Series(out, x.index)


class Block:
    """The two parts of each row's window of n rows: aggregates of the part in its own block and of the part before."""

    def __init__(self, compiler, n: int, after: int):
        self.c, self.n = compiler, n
        self.i, ready = compiler.row_number()
        self.at = max(after, ready)
        block = F.floor(self.i / n)
        self.ahead = Window.partitionBy(TICKER, block).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
        self.back = Window.partitionBy(TICKER, block).orderBy(F.col(DATE).desc()).rowsBetween(Window.unboundedPreceding, 0)
        self.whole = self.i % n == n - 1  # the window is the block

    def pair(self, aggregate: Column) -> tuple[Column, Column]:
        here, _ = self.c.windowed("ticker", aggregate.over(self.ahead), self.at)
        end, ready = self.c.windowed("ticker", aggregate.over(self.back), self.at)
        before, self.ready = self.c.windowed("ticker", F.lag(end, self.n - 1).over(wt()), ready)
        return here, before

    def merged(self, aggregate: Column, merge) -> Column:
        here, before = self.pair(aggregate)
        return F.when(self.whole, here).otherwise(merge(here, before))

    def sum(self, x: Column) -> Column:
        return self.merged(F.sum(x), lambda a, b: a + b)

    def full(self, x: Column, value: Column) -> tuple[Column, int]:
        """value where all n rows of the window have one."""
        count = self.merged(F.count(x), lambda a, b: a + b)
        return F.when(count == self.n, value), self.ready

    def spread(self, x: Column, y: Column) -> Column:
        """The sum of products of deviations of x and y, for windows without gaps."""
        (c1, c0), (x1, x0) = self.pair(F.covar_pop(x, y) if x is not y else F.var_pop(x)), self.pair(F.avg(x))
        y1, y0 = (x1, x0) if x is y else self.pair(F.avg(y))
        here = self.i % self.n + 1
        rest = self.n - here
        return F.when(self.whole, c1 * self.n).otherwise(c1 * here + c0 * rest + (x1 - x0) * (y1 - y0) * here * rest / self.n)


def _mean(b: Block, x: Column) -> Column:
    return b.sum(x) / b.n


def _std(b: Block, x: Column) -> Column:
    return F.sqrt(b.spread(x, x) / (b.n - 1))


def _weighted(b: Block, x: Column) -> Column:
    """Weights 1 to n from the oldest to the newest row, over their sum."""
    place = (b.i % b.n).cast("double")
    (s1, s0), (w1, w0) = b.pair(F.sum(x)), b.pair(F.sum(x * place))
    here = b.i % b.n
    own = w1 + (b.n - here) * s1  # a row of this block at place p weighs p + n - here
    total = own + F.when(b.whole, F.lit(0.0)).otherwise(w0 - here * s0)  # one of the block before, p - here
    return total / (b.n * (b.n + 1) / 2)


def _arg(b: Block, x: Column, largest: bool) -> Column:
    at = F.struct(x.alias("v"), (-b.i if largest else b.i).alias("p"))
    best = (F.max if largest else F.min)(F.when(x.isNotNull(), at))
    found = b.merged(best, lambda a, c: F.greatest(a, c) if largest else F.least(a, c))
    place = -found["p"] if largest else found["p"]
    return (place - (b.i - b.n + 1)).cast("double")


_ONE = {
    "ts_mean": _mean,
    "sma": _mean,
    "boll_mid": _mean,
    "ts_sum": lambda b, x: b.sum(x),
    "ts_std": _std,
    "ts_max": lambda b, x: b.merged(F.max(x), F.greatest),
    "ts_min": lambda b, x: b.merged(F.min(x), F.least),
    "product": lambda b, x: b.merged(F.product(x), lambda a, c: a * c),
    "ts_argmax": lambda b, x: _arg(b, x, True),
    "ts_argmin": lambda b, x: _arg(b, x, False),
    "boll_upper": lambda b, x: _mean(b, x) + 2.0 * _std(b, x),
    "boll_lower": lambda b, x: _mean(b, x) - 2.0 * _std(b, x),
    "decay_linear": _weighted,
    "wma": _weighted,
}
NAMES = {*_ONE, "ts_corr", "ts_cov", "ts_av_diff", "ts_zscore"}


def build(compiler, name: str, values: list, n: int, after: int) -> tuple[Column, int]:
    """The operator's column and the stage from which it can be read."""
    b = Block(compiler, n, after)
    x = ns.finite(ns.col(values[0]))
    if name in ("ts_corr", "ts_cov"):
        y = ns.finite(ns.col(values[1]))
        x, y = ns.both(x, y, x), ns.both(x, y, y)
        if name == "ts_cov":
            return b.full(x, b.spread(x, y) / (n - 1))
        return b.full(x, F.try_divide(b.spread(x, y), F.sqrt(b.spread(x, x) * b.spread(y, y))))
    if name == "ts_av_diff":
        mean, ready = b.full(x, _mean(b, x))
        return ns.col(values[0]) - mean, ready
    if name == "ts_zscore":
        mean, ready = b.full(x, _mean(b, x))
        return (ns.col(values[0]) - mean) / (_std(b, x) + 1e-9), ready
    return b.full(x, _ONE[name](b, x))
