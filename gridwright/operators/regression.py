"""Regression metrics and losses, each one aggregate over (y_true, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.statistics import ratio
from gridwright.plans.quantiles import fit_quantiles


def _e() -> Column:
    return F.col("y_pred") - F.col("y_true")


def _sse() -> Column:
    return F.sum(_e() * _e())


def _sst() -> Column:
    return F.var_pop("y_true") * F.count("y_true")


def regression_metrics(df: DataFrame) -> DataFrame:
    """mse, rmse, mae, r2, rmse over the population std, MAPE (non-zero targets), max and median error."""
    med = fit_quantiles(df.select(F.abs(_e()).alias("e")), ["e"], [0.5])["e"][0]
    mse = F.avg(_e() * _e())
    nonzero = F.col("y_true") != 0
    return df.agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(_e())).alias("mae"),
        (1.0 - ratio(_sse(), _sst(), 0.0)).alias("r2"),
        ratio(F.sqrt(mse), F.stddev_pop("y_true")).alias("nrmse"),
        (100.0 * F.avg(F.when(nonzero, F.abs(_e() / F.when(nonzero, F.col("y_true")))))).alias("mape"),
        F.max(F.abs(_e())).alias("max_error"), F.lit(med).alias("median_absolute_error"),
    )


def residual_metrics(df: DataFrame) -> DataFrame:
    """Mean and population std of the residual, explained variance (population and sample forms agree)."""
    r = F.col("y_true") - F.col("y_pred")
    return df.agg(
        F.avg(r).alias("mean_residual"), F.stddev_pop(r).alias("std_residual"), F.stddev_samp(r).alias("std_residual_sample"),
        (1.0 - ratio(F.var_pop(r), F.var_pop("y_true"))).alias("explained_variance"),
    )


def guarded_metrics(df: DataFrame) -> DataFrame:
    """Variant with 1e-8 terms instead of guards: r2 and MAPE (%)."""
    return df.agg(
        F.avg(_e() * _e()).alias("mse"), F.sqrt(F.avg(_e() * _e())).alias("rmse"), F.avg(F.abs(_e())).alias("mae"),
        (1.0 - _sse() / (_sst() + 1e-8)).alias("r2"),
        (100.0 * F.avg(F.abs(_e() / (F.col("y_true") + 1e-8)))).alias("mape"),
    )


def multi_target(df: DataFrame, y_true: str = "targets", y_pred: str = "predictions") -> DataFrame:
    """Per target and overall: mse, mae, r2 (the overall r2 is the mean over targets)."""
    cells = df.select(F.posexplode(F.arrays_zip(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))).alias("target", "z"))
    e = F.col("z.p") - F.col("z.t")
    per = cells.groupBy("target").agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        (1.0 - F.sum(e * e) / (F.var_pop("z.t") * F.count("z.t") + 1e-8)).alias("r2"),
    )
    whole = per.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))
    return per.withColumn("target", F.col("target").cast("string")).unionByName(whole.withColumn("target", F.lit("overall")))


def multi_target_loss(df: DataFrame, weights: Sequence[float], y_true: str = "targets", y_pred: str = "predictions") -> DataFrame:
    w = F.array(*[F.lit(float(x)) for x in weights])
    cells = df.select(F.explode(F.arrays_zip(F.col(y_true).alias("t"), F.col(y_pred).alias("p"), w.alias("w"))).alias("z"))
    e = F.col("z.p") - F.col("z.t")
    return cells.agg(F.avg(F.col("z.w") * e * e).alias("loss"))


def pinball(df: DataFrame, quantiles: Sequence[float], y_pred: str = "quantile_pred") -> DataFrame:
    """Pinball loss per quantile and their mean."""
    q = F.array(*[F.lit(float(x)) for x in quantiles])
    cells = df.select("y_true", F.explode(F.arrays_zip(F.col(y_pred).alias("p"), q.alias("q"))).alias("z"))
    e = F.col("y_true") - F.col("z.p")
    loss = F.greatest(F.col("z.q") * e, (F.col("z.q") - 1) * e)
    per = cells.groupBy(F.col("z.q").cast("string").alias("quantile")).agg(F.avg(loss).alias("loss"))
    return per.unionByName(per.agg(F.avg("loss").alias("loss")).select(F.lit("mean").alias("quantile"), "loss"))


def quantile_metrics(df: DataFrame, quantiles: Sequence[float], y_pred: str = "quantile_pred") -> DataFrame:
    qs = list(quantiles)
    m = qs.index(0.5) if 0.5 in qs else len(qs) // 2
    p = F.col(y_pred)
    e = p[m] - F.col("y_true")
    lo, hi = p[0], p[len(qs) - 1]
    cells = [F.avg(e * e).alias("median_mse"), F.avg(F.abs(e)).alias("median_mae"), F.sqrt(F.avg(e * e)).alias("median_rmse")]
    if len(qs) >= 3:
        inside = (F.col("y_true") >= lo) & (F.col("y_true") <= hi)
        cells += [
            F.avg(inside.cast("double")).alias("coverage"), F.avg(hi - lo).alias("mean_width"),
            F.max(F.lit(qs[-1] - qs[0])).alias("expected_coverage"),
        ]
    return df.agg(*cells)


def interval_indices(quantiles: Sequence[float], level: float = 0.9) -> tuple[int, int]:
    """Indices of the quantiles nearest to the two ends of the wanted central interval."""
    alpha = (1.0 - level) / 2.0
    near = lambda x: min(range(len(quantiles)), key=lambda i: abs(quantiles[i] - x))
    return near(alpha), near(1.0 - alpha)


def prediction_intervals(df: DataFrame, quantiles: Sequence[float], level: float = 0.9, y_pred: str = "quantile_pred") -> DataFrame:
    a, b = interval_indices(quantiles, level)
    return df.select("*", F.col(y_pred)[a].alias("lower"), F.col(y_pred)[b].alias("upper"))


def robust_losses(df: DataFrame, delta: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """Huber, log-cosh and asymmetric (quantile) loss."""
    e = F.abs(_e())
    huber = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    log_cosh = e + F.log1p(F.exp(-2.0 * e)) - F.log(F.lit(2.0))
    d = F.col("y_true") - F.col("y_pred")
    asym = F.when(d >= 0, alpha * d).otherwise((alpha - 1) * d)
    return df.agg(F.avg(huber).alias("huber"), F.avg(log_cosh).alias("log_cosh"), F.avg(asym).alias("asymmetric"))
