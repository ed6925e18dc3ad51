"""Aggregate expressions whose definition differs from Spark's built-in one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness G1 (null below three values; 0 for a constant column)."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(F.count(c) < 3, F.lit(None).cast("double")).when(
        F.min(c) == F.max(c), F.lit(0.0)
    ).otherwise(g1)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (null below four values; 0 for a constant column)."""
    n = F.count(c).cast("double")
    g2 = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(F.count(c) < 4, F.lit(None).cast("double")).when(
        F.min(c) == F.max(c), F.lit(0.0)
    ).otherwise(g2)


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or ``default`` where the denominator is 0."""
    return F.when(den == 0, F.lit(default)).otherwise(num / F.when(den != 0, den))
