"""Feature importance: mutual information, absolute correlation, variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import as_number, numeric_columns, present
from gridwright.operators.profile import column_rows
from gridwright.plans.quantiles import fit_median


def equal_width_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Right-closed equal-width bin, clamped to 0..bins-1."""
    if hi == lo:
        return F.lit(0)
    pos = F.ceil((x - F.lit(lo)) / F.lit(hi - lo) * bins) - 1
    return F.least(F.greatest(pos, F.lit(0)), F.lit(bins - 1))


def mutual_information(df: DataFrame, target: str, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """MI (natural log) of every feature with the target from one contingency count.

    Each row contributes one (feature, level, target) cell per feature; cells are counted with
    partial aggregation, so the shuffle carries distinct cells only.
    """
    nums = [c for c in cols if c in numeric_columns(df)]
    med = fit_median(df, nums)
    row = df.agg(
        *[F.min(as_number(df, c)).alias(f"{c}:a") for c in nums],
        *[F.max(as_number(df, c)).alias(f"{c}:b") for c in nums],
    ).first() if nums else None

    def level(c):
        if c in nums:
            x = F.coalesce(as_number(df, c), F.lit(med[c]))
            return equal_width_bin(x, row[f"{c}:a"], row[f"{c}:b"], bins).cast("string")
        return F.coalesce(present(df, c).cast("string"), F.lit("missing"))

    y = F.coalesce(present(df, target).cast("string"), F.lit("missing"))
    cells = df.select(y.alias("y"), *[level(c).alias(c) for c in cols]).unpivot(["y"], list(cols), "feature", "level")
    counts = cells.groupBy("feature", "level", "y").agg(F.count("*").alias("n"))
    by_level = counts.groupBy("feature", "level").agg(F.sum("n").alias("nx"))
    by_target = counts.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("tot"))  # one row a feature
    joined = counts.join(by_level, ["feature", "level"]).join(by_target, ["feature", "y"]).join(totals, "feature")
    p = F.col("n") / F.col("tot")
    pxy = (F.col("nx") / F.col("tot")) * (F.col("ny") / F.col("tot"))
    return joined.groupBy("feature").agg(F.sum(p * F.log(p / pxy)).alias("importance"))


def absolute_correlation(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    y = as_number(df, target)
    rows = column_rows(df, list(cols), {"importance": lambda c: F.abs(F.corr(as_number(df, c), y))})
    return rows.withColumnRenamed("column", "feature")


def variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = column_rows(df, list(cols), {"importance": lambda c: F.var_samp(as_number(df, c))})
    return rows.withColumnRenamed("column", "feature")


def ranked(scores: DataFrame) -> DataFrame:
    """Features by falling importance; one row per column of the table."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).orderBy("rank")
