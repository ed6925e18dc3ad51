"""Analytics over a results table in long form (model, dataset, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.statistics import ratio

# Words that mark a metric as better when lower.
LOWER_IS_BETTER = ("loss", "error", "mse", "mae")


def ascending(metric: str) -> bool:
    return any(w in metric.lower() for w in LOWER_IS_BETTER)


def leaderboard(results: DataFrame, primary: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per model, best model first; ties by name. One row per model."""
    wide = results.groupBy("model").pivot("metric", list(metrics)).agg(F.avg("value"))
    by = F.col(primary).asc_nulls_last() if ascending(primary) else F.col(primary).desc_nulls_last()
    w = Window.partitionBy(F.lit(0)).orderBy(by, "model")
    return wide.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def suite_summary(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per model: number of data sets and mean and population std of each metric."""
    cells = [F.count_distinct("dataset").alias("n_datasets")]
    for m in metrics:
        v = F.when(F.col("metric") == m, F.col("value"))
        cells += [F.avg(v).alias(f"{m}_mean"), F.stddev_pop(v).alias(f"{m}_std")]
    return results.groupBy("model").agg(*cells)


def improvements(results: DataFrame, baseline: str) -> DataFrame:
    """Absolute and relative difference to the baseline model (relative 0 when the baseline is 0)."""
    base = results.where(F.col("model") == baseline).select("dataset", "metric", F.col("value").alias("base"))
    d = F.col("value") - F.col("base")
    return results.where(F.col("model") != baseline).join(base, ["dataset", "metric"]).select(
        "model", "dataset", "metric", d.alias("absolute"), ratio(d, F.abs("base")).alias("relative")
    )


def transfer_matrix(results: DataFrame, metric: str, targets: Sequence[str]) -> DataFrame:
    """Source domains as rows, target domains as columns."""
    return results.where(F.col("metric") == metric).groupBy("source").pivot("target", list(targets)).agg(F.max("value"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """(metric, mean, std, n) over the folds; population std."""
    return folds.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n")
    )
