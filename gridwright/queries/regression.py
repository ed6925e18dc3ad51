"""Regression metrics over order lines (truth: price, guess: quantity * 1500)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import regression as reg
from gridwright.queries.base import query, rounded, table, union_sql

P = "(SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p, l_discount * 100 AS y2, l_tax * 100 AS p2 FROM lineitem)"


def pairs(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y_true"), (F.col("l_quantity") * 1.5).alias("y_pred"))


@query(
    "mr1_metrics",
    f"""SELECT round(avg((p - y) * (p - y)), 6) AS mse, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
    round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((p - y) * (p - y))) / stddev_pop(y), 6) AS nrmse,
    round(100 * avg(abs((p - y) / y)) FILTER (y <> 0), 6) AS mape, round(max(abs(p - y)), 6) AS max_error, round(quantile_cont(abs(p - y), 0.5), 6) AS median_absolute_error FROM {P}""",
)
def mr1(spark, sf):
    return rounded(reg.regression_metrics(pairs(spark, sf)))


@query(
    "mr2_residuals",
    f"""SELECT round(avg(y - p), 6) AS mean_residual, round(stddev_pop(y - p), 6) AS std_residual, round(stddev_samp(y - p), 6) AS std_residual_sample,
    round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance FROM {P}""",
)
def mr2(spark, sf):
    return rounded(reg.residual_metrics(pairs(spark, sf)))


@query(
    "mr3_guarded",
    f"""SELECT round(avg((p - y) * (p - y)), 6) AS mse, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
    round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*) + 1e-8), 6) AS r2, round(100 * avg(abs((p - y) / (y + 1e-8))), 6) AS mape FROM {P}""",
)
def mr3(spark, sf):
    return rounded(reg.guarded_metrics(pairs(spark, sf)))


def two_targets(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.array(F.col("l_extendedprice") / 1000, F.col("l_discount") * 100).alias("targets"),
        F.array(F.col("l_quantity") * 1.5, F.col("l_tax") * 100).alias("predictions"),
    )


def _target_sql(name, y, p):
    return f"""SELECT '{name}' AS target, avg(({p} - {y}) * ({p} - {y})) AS mse, avg(abs({p} - {y})) AS mae,
    1 - sum(({p} - {y}) * ({p} - {y})) / (var_pop({y}) * count(*) + 1e-8) AS r2 FROM {P}"""


_TARGETS = f"({_target_sql('0', 'y', 'p')} UNION ALL {_target_sql('1', 'y2', 'p2')})"


@query(
    "mr4_multi_target",
    f"""SELECT target, round(mse, 6) AS mse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM {_TARGETS}
    UNION ALL SELECT 'overall', round(avg(mse), 6), round(avg(mae), 6), round(avg(r2), 6) FROM {_TARGETS}""",
)
def mr4(spark, sf):
    return rounded(reg.multi_target(two_targets(spark, sf)))


QS = (0.1, 0.5, 0.9)


def quantile_pred(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") / 1000).alias("y_true"), F.array(q * 1.0, q * 1.5, q * 2.0).alias("quantile_pred")
    )


_PIN = "(" + union_sql(
    f"SELECT '{q}' AS quantile, avg(greatest({q} * (y - p * {f}), ({q} - 1) * (y - p * {f}))) AS loss FROM {P}"
    for q, f in zip(QS, ("(1/1.5::DOUBLE)", "1", "(2/1.5::DOUBLE)"))
) + ")"


@query("mr5_pinball", f"SELECT quantile, round(loss, 6) AS loss FROM {_PIN} UNION ALL SELECT 'mean', round(avg(loss), 6) FROM {_PIN}")
def mr5(spark, sf):
    return rounded(reg.pinball(quantile_pred(spark, sf), QS))


_Q = "(SELECT l_extendedprice / 1000 AS y, l_quantity AS lo, l_quantity * 1.5 AS p, l_quantity * 2 AS hi, l_orderkey FROM lineitem)"


@query(
    "mr6_quantile_metrics",
    f"""SELECT round(avg((p - y) * (p - y)), 6) AS median_mse, round(avg(abs(p - y)), 6) AS median_mae, round(sqrt(avg((p - y) * (p - y))), 6) AS median_rmse,
    round(avg((y >= lo AND y <= hi)::INT::DOUBLE), 6) AS coverage, round(avg(hi - lo), 6) AS mean_width, 0.8::DOUBLE AS expected_coverage FROM {_Q}""",
)
def mr6(spark, sf):
    return rounded(reg.quantile_metrics(quantile_pred(spark, sf), QS))


@query("mr7_intervals", f"SELECT l_orderkey, lo AS lower, hi AS upper FROM {_Q}")
def mr7(spark, sf):
    return reg.prediction_intervals(quantile_pred(spark, sf), QS, 0.85).select("l_orderkey", "lower", "upper")


@query(
    "mr8_robust_losses",
    f"""SELECT round(avg(CASE WHEN e <= 1 THEN 0.5 * e * e ELSE e - 0.5 END), 6) AS huber, round(avg(e + ln(1 + exp(-2 * e)) - ln(2)), 6) AS log_cosh,
    round(avg(CASE WHEN y - p >= 0 THEN 0.5 * (y - p) ELSE -0.5 * (y - p) END), 6) AS asymmetric FROM (SELECT *, abs(p - y) AS e FROM {P})""",
)
def mr8(spark, sf):
    return rounded(reg.robust_losses(pairs(spark, sf)))


@query(
    "mr9_weighted_loss",
    f"SELECT round(avg((2 * (p - y) * (p - y) + 0.5 * (p2 - y2) * (p2 - y2)) / 2), 6) AS loss FROM {P}",
)
def mr9(spark, sf):
    return rounded(reg.multi_target_loss(two_targets(spark, sf), [2.0, 0.5]))
