"""Aggregate expressions whose null and zero-variance rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson over rows where both sides are present; NULL when either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pair_count(a: Column, b: Column) -> Column:
    return F.count_if(a.isNotNull() & b.isNotNull())


def adjusted_skew(c: Column) -> Column:
    """Sample (bias-adjusted) skewness; NULL for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def adjusted_kurtosis(c: Column) -> Column:
    """Sample (bias-adjusted) excess kurtosis; NULL for fewer than four values."""
    n = F.count(c).cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, scale * ((n + 1) * F.kurtosis(c) + 6))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def to_micros(c: Column) -> Column:
    """Microseconds since the epoch (session time zone must be UTC)."""
    return F.unix_micros(c.cast("timestamp"))
