"""Numeric expressions that behave the same on constant, short and empty groups: null instead of NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 9) -> Column:
    """Rounded, without a negative zero. Sums of doubles depend on their order below 9 digits; readings have two, so at 9 their means hardly ever lie on a rounding edge."""
    return F.round(x, digits) + F.lit(0.0)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation over rows where both are known; null where either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def zscore(v: Column, mu: Column, sd: Column) -> Column:
    return F.try_divide(v - mu, sd)


def adjusted_skewness(x: str) -> Column:
    """The sample skewness; null below three rows."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
