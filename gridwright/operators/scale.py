"""Scaling: fit (centre, scale) pairs, apply them as literals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import as_number
from gridwright.functions.special import normal_quantile
from gridwright.functions.vectors import fold_sum
from gridwright.plans.quantiles import fit_quantiles

Scaler = dict[str, tuple[float, float]]


def _value(df: DataFrame, c: str, null_as_zero: bool) -> Column:
    x = as_number(df, c)
    return F.coalesce(x, F.lit(0.0)) if null_as_zero else x


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard", null_as_zero: bool = False) -> Scaler:
    """standard: mean and population std; minmax: min and range; robust: median and IQR.

    A zero scale becomes 1. `null_as_zero` fits on missing cells counted as 0.
    """
    cols = list(cols)
    if not cols:
        return {}
    work = df.select(*[_value(df, c, null_as_zero).alias(c) for c in cols])
    if method == "robust":
        q = fit_quantiles(work, cols, [0.25, 0.5, 0.75])
        pairs = {c: (b, None if a is None else d - a) for c, (a, b, d) in q.items()}
    else:
        fns = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        row = work.agg(*[f(c).alias(f"{c}:{i}") for i, f in enumerate(fns) for c in cols]).first()
        pairs = {c: (row[f"{c}:0"], row[f"{c}:1"]) for c in cols}
        if method == "minmax":
            pairs = {c: (a, None if a is None else b - a) for c, (a, b) in pairs.items()}
    return {c: (a, s or 1.0) for c, (a, s) in pairs.items() if a is not None}


def apply_scaler(df: DataFrame, scaler: Scaler, null_as_zero: bool = False) -> DataFrame:
    def one(c):
        a, s = scaler[c]
        return ((_value(df, c, null_as_zero) - F.lit(a)) / F.lit(s)).alias(c)

    return df.select(*[one(c) if c in scaler else F.col(c) for c in df.columns])


def fit_normal_scores(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000) -> dict[str, list[float]]:
    return fit_quantiles(df, cols, list(np.linspace(0, 1, n_quantiles)))


def apply_normal_scores(df: DataFrame, fitted: dict[str, list[float]]) -> DataFrame:
    """Piecewise-linear CDF over the fitted quantiles, then the inverse normal, both Arrow-batched."""

    def cdf(edges: list[float]):
        x = np.asarray(edges, dtype=float)
        p = np.linspace(0, 1, len(x))

        @F.pandas_udf("double")
        def apply(s: pd.Series) -> pd.Series:
            v = s.to_numpy(dtype=float)
            # the mean of both directions is the middle of a run of equal quantiles
            up = np.interp(v, x, p)
            down = 1.0 - np.interp(-v, -x[::-1], p)
            return pd.Series(np.clip((up + down) / 2, 1e-7, 1 - 1e-7)).where(s.notna())

        return apply

    return df.select(
        *[
            normal_quantile(cdf(fitted[c])(as_number(df, c))).alias(c) if c in fitted else F.col(c)
            for c in df.columns
        ]
    )


def normalize_row(vector: Column, method: str = "standard", eps: float = 1e-8) -> Column:
    """Normalize the entries of one row's array among themselves."""
    n = F.size(vector)
    if method == "standard":
        mean = fold_sum(vector) / n
        var = fold_sum(F.transform(vector, lambda x: (x - mean) * (x - mean))) / F.when(n > 1, n - 1)
        return F.transform(vector, lambda x: (x - mean) / (F.sqrt(var) + F.lit(eps)))
    if method == "minmax":
        lo, hi = F.array_min(vector), F.array_max(vector)
        return F.transform(vector, lambda x: (x - lo) / (hi - lo + F.lit(eps)))
    ordered = F.array_sort(vector)

    def quantile(p):
        h = (n - 1) * F.lit(p)
        a = F.element_at(ordered, (F.floor(h) + 1).cast("int"))
        b = F.element_at(ordered, (F.ceil(h) + 1).cast("int"))
        return a + (b - a) * (h - F.floor(h))

    iqr = quantile(0.75) - quantile(0.25)
    med = quantile(0.5)
    return F.transform(vector, lambda x: (x - med) / (iqr + F.lit(eps)))
