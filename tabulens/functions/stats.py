"""Aggregates with the definitions of bias-adjusted statistics.

Spark's skewness and kurtosis are population moments, its correlation throws on a constant column under ANSI rules,
and NaN counts as a value; these builders settle all three.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN as null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def adjusted_skewness(c: Column) -> Column:
    """Null below three values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g = F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n < 3, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(g)


def adjusted_kurtosis(c: Column) -> Column:
    """Excess kurtosis; null below four values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(g)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null where one is constant there."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def quantiles(c: Column, *q: float, approximate: int = 0) -> Column:
    """Linear quantiles, exact; with approximate > 0, the sketch of that accuracy, which holds bounded state."""
    wanted = F.array(*map(F.lit, q))
    return F.percentile_approx(c, wanted, F.lit(approximate)) if approximate else F.percentile(c, wanted)
