"""The operators of the formula language. ``register`` adds more: a name, its place, and a function of Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelforge.functions import nullsafe as ns

DATE, TICKER = "date", "ticker"


def cs():
    """The date's cross-section. Windows are made when asked for: workers import this module without a session."""
    return Window.partitionBy(DATE)


def wt():
    return Window.partitionBy(TICKER).orderBy(DATE)


def last(n: int):
    return wt().rowsBetween(-(n - 1), 0)


@dataclass(frozen=True)
class Operator:
    name: str
    keyed: str  # scalar, date, ticker, or fold (a pass over each ticker's history)
    arity: int
    fn: Callable


OPERATORS: dict[str, Operator] = {}


def register(name: str, keyed: str, arity: int, fn: Callable) -> None:
    if keyed not in ("scalar", "date", "ticker", "fold"):
        raise ValueError(f"unknown place {keyed!r}")
    OPERATORS[name] = Operator(name, keyed, arity, fn)


def _guard(fn: Callable) -> Callable:
    return lambda x: F.when(x.isNotNull(), fn(x))


def cs_zscore(x):
    sd = F.stddev_samp(x).over(cs())
    return (x - F.avg(x).over(cs())) / (F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd) + 1e-9)


def cs_scale(x):
    low, high = F.min(x).over(cs()), F.max(x).over(cs())
    return F.try_divide(x - low, high - low)


def group_rank(x, g):
    return F.when(g.isNotNull(), ns.percent_rank(x, F.col(DATE), g))


def group_zscore(x, g):
    w = Window.partitionBy(DATE, g)
    return F.when(g.isNotNull(), (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-9))


def where(cond, a, b):
    return F.when(cond, ns.col(a)).otherwise(ns.col(b))


def shift(x, n, allow_lookahead: bool = False):
    if n < 0 and not allow_lookahead:
        raise ValueError("a negative shift looks ahead")
    return F.lag(x, n).over(wt()) if n >= 0 else F.lead(x, -n).over(wt())


def rolling(fn: Callable) -> Callable:
    def out(x, n):
        x = ns.finite(x)
        return ns.full(x, n, last(n), fn(x).over(last(n)))

    return out


def ts_rank(x, n):
    x = ns.finite(x)
    a = F.collect_list(x).over(last(n))
    return ns.full(x, n, last(n), (F.size(F.filter(a, lambda v: v < x)) + (F.size(F.filter(a, lambda v: v == x)) + 1) / F.lit(2.0)) / n)


def ts_arg(pick: Callable) -> Callable:
    def out(x, n):
        x = ns.finite(x)
        a = F.collect_list(x).over(last(n))
        return ns.full(x, n, last(n), (F.array_position(a, pick(a)) - 1).cast("double"))

    return out


def ts_corr(x, y, n):
    x, y = ns.finite(x), ns.finite(y)
    pair = ns.both(x, y, x)
    return ns.full(pair, n, last(n), ns.pearson(x, y, last(n)))


def ts_cov(x, y, n):
    x, y = ns.finite(x), ns.finite(y)
    pair = ns.both(x, y, x)
    return ns.full(pair, n, last(n), F.covar_samp(pair, ns.both(x, y, y)).over(last(n)))


def decay_linear(x, n):
    x = ns.finite(x)
    total = n * (n + 1) / 2
    out = None
    for i in range(n):
        term = F.lag(x, n - 1 - i).over(wt()) * ((i + 1) / total)
        out = term if out is None else out + term
    return out


def ts_mean(x, n):
    return rolling(F.avg)(x, n)


def ts_std(x, n):
    return rolling(F.stddev_samp)(x, n)


def boll(k: float) -> Callable:
    return lambda x, n: ts_mean(x, n) + k * ts_std(x, n)


def ewm(x: pd.Series, alpha: float, adjust: bool, least: int = 1) -> pd.Series:
    """Exponentially weighted mean whose weights decay across gaps."""
    return x.ewm(alpha=alpha, adjust=adjust, min_periods=least).mean()


def fold_ema(x, n):
    return ewm(x, 2 / (n + 1), False)


def fold_rsi(x, n):
    steps = x.diff()
    up, down = ewm(steps.clip(lower=0), 1 / n, True, n), ewm((-steps).clip(lower=0), 1 / n, True, n)
    return 100 - 100 / (1 + up / down.where(down != 0))


def fold_macd(x, n):
    line = fold_ema(x, max(1, n // 2)) - fold_ema(x, n)
    return line - fold_ema(line, max(1, n // 4))


for _name, _fn in {
    "sign": F.signum,
    "log": _guard(lambda x: F.ln(F.greatest(x, F.lit(1e-9)))),
    "abs": F.abs,
    "tanh": F.tanh,
    "sigmoid": _guard(lambda x: 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))),
    "exp": _guard(lambda x: F.exp(F.least(x, F.lit(500.0)))),
    "sqrt": _guard(lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))),
}.items():
    register(_name, "scalar", 1, _fn)
register("power", "scalar", 2, lambda a, b: ns.clean(F.pow(ns.col(a), ns.col(b))))
register("sign_power", "scalar", 2, lambda a, b: ns.clean(F.signum(a) * F.pow(F.abs(a), ns.col(b))))
register("max", "scalar", 2, ns.maximum)
register("min", "scalar", 2, ns.minimum)
register("clip", "scalar", 3, lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, ns.col(lo)), ns.col(hi))))
register("where", "scalar", 3, where)
for _name, _fn in {"rank": lambda x: ns.percent_rank(x, F.col(DATE)), "zscore": cs_zscore, "scale": cs_scale}.items():
    register(_name, "date", 1, _fn)
for _name, _fn in {"group_rank": group_rank, "group_zscore": group_zscore, "indneutralize": group_zscore}.items():
    register(_name, "date", 2, _fn)
for _name, _fn in {
    "delta": lambda x, n: x - shift(x, n),
    "ts_delta": lambda x, n: x - shift(x, n),
    "ts_shift": shift,
    "ts_mean": ts_mean,
    "ts_std": ts_std,
    "ts_max": rolling(F.max),
    "ts_min": rolling(F.min),
    "ts_sum": rolling(F.sum),
    "ts_rank": ts_rank,
    "ts_argmax": ts_arg(F.array_max),
    "ts_argmin": ts_arg(F.array_min),
    "decay_linear": decay_linear,
    "product": rolling(F.product),
    "ts_av_diff": lambda x, n: x - ts_mean(x, n),
    "ts_zscore": lambda x, n: (x - ts_mean(x, n)) / (ts_std(x, n) + 1e-9),
    "sma": ts_mean,
    "wma": decay_linear,
    "boll_upper": boll(2.0),
    "boll_lower": boll(-2.0),
    "boll_mid": ts_mean,
}.items():
    register(_name, "ticker", 2, _fn)
register("ts_corr", "ticker", 3, ts_corr)
register("ts_cov", "ticker", 3, ts_cov)
for _name, _fn in {"ema": fold_ema, "rsi": fold_rsi, "macd": fold_macd}.items():
    register(_name, "fold", 2, _fn)
