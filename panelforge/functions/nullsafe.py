"""Null-safe building blocks. Null means missing; NaN never leaves an operator; +-inf is data outside rolling windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

INF = float("inf")


def col(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clean(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NaN and +-inf as null, as rolling windows take them."""
    return F.when(~F.isnan(x) & (F.abs(x) != INF), x)


def divide(a: Column, b: Column) -> Column:
    """IEEE division without ANSI errors: x/0 is +-inf, 0/0 is null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    over_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b.isNull() | a.isNull(), None).when(b == 0, over_zero).otherwise(clean(F.try_divide(a, b)))


def both(a: Column, b: Column, value: Column) -> Column:
    """value where neither side is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def maximum(a, b) -> Column:
    a, b = col(a), col(b)
    return both(a, b, F.greatest(a, b))


def minimum(a, b) -> Column:
    a, b = col(a), col(b)
    return both(a, b, F.least(a, b))


def full(x: Column, n: int, frame: WindowSpec, value: Column) -> Column:
    """value where the n-row window is full of values."""
    return F.when(F.count(x).over(frame) == n, value)


def pearson(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Correlation of complete pairs; null where a side is constant (the built-in raises under ANSI)."""
    x, y = both(x, y, x), both(x, y, y)
    parts = [F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])


def average_rank(x: Column, *keys: Column) -> Column:
    """Rank within keys, ties sharing the mean rank; null for null."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(*keys, x.isNull()).orderBy(x)
    tied = Window.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0))


def percent_rank(x: Column, *keys: Column) -> Column:
    from pyspark.sql import Window

    return average_rank(x, *keys) / F.count(x).over(Window.partitionBy(*keys))
