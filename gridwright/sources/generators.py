"""Synthetic tables. A generator adds columns to a frame of ids, each value a hash of (id, column,
seed); `spark.range(n)` or the key column of a real table both serve as ids."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.hashing import gaussian, pick, uniform
from gridwright.plans.quantiles import fit_quantiles


def _weight(*parts, seed: int) -> float:
    """Fixed number in [-1, 1) for a coefficient."""
    h = hashlib.md5("|".join(map(str, (*parts, seed))).encode()).hexdigest()
    return int(h[:13], 16) / 2**52 * 2 - 1


def classification(
    ids: DataFrame, key: str, n_features: int = 20, n_classes: int = 2, class_sep: float = 1.0, flip_y: float = 0.01, seed: int = 42
) -> DataFrame:
    """Gaussian classes around corners +-class_sep; a share of labels is redrawn."""
    y = pick([key], n_classes, "class", seed)
    base = ids.select(key, y.alias("__y"))
    cells = []
    for j in range(n_features):
        corner = F.lit(class_sep)
        signs = F.array(*[F.lit(1.0 if _weight("corner", c, j, seed=seed) >= 0 else -1.0) for c in range(n_classes)])
        cells.append((gaussian([key], f"x{j}", seed) + corner * signs[F.col("__y")]).alias(f"feature_{j}"))
    flipped = F.when(uniform([key], "flip", seed) < flip_y, pick([key], n_classes, "redraw", seed)).otherwise(F.col("__y"))
    return base.select(key, *cells, flipped.alias("target"))


def regression(ids: DataFrame, key: str, n_features: int = 20, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Linear target of gaussian features plus noise."""
    feats = ids.select(key, *[gaussian([key], f"x{j}", seed).alias(f"feature_{j}") for j in range(n_features)])
    y = F.lit(0.0)
    for j in range(n_features):
        y = y + F.lit(100.0 * _weight("coef", j, seed=seed)) * F.col(f"feature_{j}")
    return feats.withColumn("target", y + F.lit(noise) * gaussian([key], "noise", seed))


def _choice(key: str, values: Sequence[str], salt: str, seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), pick([key], len(values), salt, seed) + 1)


def mixed(
    ids: DataFrame, key: str, n_numeric: int = 10, n_categorical: int = 5, n_values: int = 5, n_classes: int = 2, seed: int = 42
) -> DataFrame:
    """Numbers and strings; the class is the quantile range of a score over the first numbers."""
    names = [f"category_{v}" for v in range(n_values)]
    out = ids.select(
        key, *[gaussian([key], f"n{j}", seed).alias(f"num_feature_{j}") for j in range(n_numeric)],
        *[_choice(key, names, f"c{j}", seed).alias(f"cat_feature_{j}") for j in range(n_categorical)],
    )
    score = reduce(lambda a, b: a + b, [F.col(f"num_feature_{j}") for j in range(min(3, n_numeric))]) + 0.1 * gaussian([key], "score", seed)
    scored = out.withColumn("__s", score)
    cuts = fit_quantiles(scored, ["__s"], [i / n_classes for i in range(1, n_classes)])["__s"]
    label = reduce(lambda a, b: a + b, [(F.col("__s") > c).cast("int") for c in cuts], F.lit(0))
    return scored.withColumn("target", label).drop("__s")


def messy(ids: DataFrame, key: str, n_numeric: int = 5, n_categorical: int = 2, seed: int = 42) -> DataFrame:
    """Mixed table with 5% outliers (x10), 10% nulls, 100-value categories, a column of mixed types and
    a date column with invalid entries."""
    df = mixed(ids, key, n_numeric, n_categorical, 100, 2, seed)
    cells: list[Column] = [F.col(key)]
    for c in df.columns:
        if c == key:
            continue
        v = F.col(c)
        if c.startswith("num_"):
            v = F.when(uniform([key], f"out-{c}", seed) < 0.05, v * 10).otherwise(v)
        if c != "target":
            v = F.when(uniform([key], f"null-{c}", seed) >= 0.1, v)
        cells.append(v.alias(c))
    u = uniform([key], "mixed", seed)
    mixed_types = F.when(u < 0.7, (F.round(gaussian([key], "mt", seed), 3) + F.lit(0.0)).cast("string")).when(u < 0.9, F.lit("text")).otherwise(F.lit("N/A"))
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), pick([key], 365, "day", seed)), "yyyy-MM-dd")
    dates = F.when(uniform([key], "bad-date", seed) < 0.01, F.lit("invalid_date")).otherwise(day)
    return df.select(*cells, mixed_types.alias("mixed_types"), dates.alias("datetime_col"))


def domains(ids: DataFrame, key: str, names: Sequence[str], n_features: int = 10, task: str = "classification", seed: int = 42) -> DataFrame:
    """One table per domain with its own seed, separation and noise, stacked with a domain column."""
    parts = []
    for i, d in enumerate(names):
        if task == "classification":
            t = classification(ids, key, n_features, class_sep=0.5 + 0.25 * i, flip_y=0.01 * (i + 1), seed=seed + i)
        else:
            t = regression(ids, key, n_features, noise=0.1 * (i + 1), seed=seed + i)
        parts.append(t.withColumn("domain", F.lit(d)))
    return reduce(lambda a, b: a.unionByName(b), parts)
