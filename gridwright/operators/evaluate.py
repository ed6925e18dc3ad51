"""One entry for all metrics of a task, in long form (metric, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators import classification, outlier, regression, survival


def long_form(wide: DataFrame) -> DataFrame:
    cols = wide.columns
    return wide.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value")


def evaluate(df: DataFrame, task: str) -> DataFrame:
    """task: classification (y_true, y_pred, optional proba array), regression (y_true, y_pred),
    anomaly (y_true, y_pred, score) or survival (key, time, event, risk)."""
    if task == "classification":
        parts = [classification.classification_metrics(df)]
        if "proba" in df.columns:
            parts += [classification.multiclass_areas(df), classification.log_loss(df)]
    elif task == "regression":
        parts = [regression.regression_metrics(df), regression.residual_metrics(df)]
    elif task == "anomaly":
        parts = [outlier.anomaly_report(df, "score", "y_true", "y_pred"), classification.binary_areas(df, "score")]
    elif task == "survival":
        parts = [survival.concordance(df), survival.cox_loss(df)]
    else:
        raise ValueError(f"unknown task {task}")
    return reduce(lambda a, b: a.unionByName(b), [long_form(p) for p in parts])
