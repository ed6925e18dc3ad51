"""Baselines, ensembles, evaluation loops and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gridwright.operators import baselines as bl
from gridwright.operators import scoring
from gridwright.plans import prepare
from gridwright.queries.base import hash_sql, query, rounded, table


def part_prices(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


@query(
    "bl1_linear_regression",
    "SELECT p_partkey, p_retailprice AS y_true, round(a + b * p_size, 4) AS y_pred FROM part, (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part)",
)
def bl1_linear(spark, sf):
    df = part_prices(spark, sf)
    model = bl.Baseline("linear_regression", "regression", "p_retailprice", ["p_partkey"]).fit(df)
    return rounded(model.predict(df), 4)


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.month("o_orderdate").alias("month"))


def _shown(pred):
    return pred.withColumn("proba", F.array_join(F.transform("proba", lambda p: F.round(p, 4).cast("string")), ","))


def _classifier(name, trees):
    def run(spark, sf):
        df = _orders(spark, sf)
        model = bl.Baseline(name, "classification", "o_orderstatus", ["o_orderkey"], trees=trees).fit(df)
        return _shown(model.predict(df))

    return run


query("bl1_random_forest")(_classifier("random_forest", 100))
query("bl1_logistic_regression")(_classifier("logistic_regression", 1))


@query("bl1_gradient_boosting")
def bl1_gbt(spark, sf):
    df = _orders(spark, sf).withColumn("urgent", (F.substring("o_orderpriority", 1, 1) < "3").cast("string")).drop("o_orderpriority")
    model = bl.Baseline("gradient_boosting", "classification", "urgent", ["o_orderkey"]).fit(df)
    return _shown(model.predict(df))


# three guesses of a three-class label of an event, as models
_P = {
    "a": ("value / 500", "(event_id % 10) / 10.0D", "0.5D"),
    "b": ("(user_id % 7) / 7.0D", "value / 1000", "0.3D"),
    "c": ("0.4D", "(user_id % 5) / 5.0D", "value / 600"),
}
_GUESS = {"a": "event_id % 3", "b": "user_id % 3", "c": "length(event_type) % 3"}


@query(
    "bl2_soft_voting",
    """WITH p AS (SELECT event_id, (value / 500 + (user_id % 7) / 7.0::DOUBLE + 0.4) / 3 AS p0, ((event_id % 10) / 10.0::DOUBLE + value / 1000 + (user_id % 5) / 5.0::DOUBLE) / 3 AS p1, (0.5 + 0.3 + value / 600) / 3 AS p2 FROM events)
    SELECT event_id, (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END)::INTEGER AS y_pred, round(greatest(p0, p1, p2), 6) AS confidence FROM p""",
)
def bl2_soft(spark, sf):
    return rounded(bl.vote(_voters(spark, sf), ["event_id"], "soft"))


def _voters(spark, sf):
    # one row per model and event, from a single scan
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.array(*[F.expr(e).cast("double") for e in p]).alias("proba"), F.expr(_GUESS[m]).cast("int").alias("y_pred"))
        for m, p in _P.items()
    ])
    return table(spark, sf, "events").select("event_id", F.explode(models).alias("s")).select("event_id", "s.*")


@query(
    "bl2_hard_voting",
    """SELECT event_id, (CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE 0 END)::INTEGER AS y_pred FROM (
    SELECT *, event_id % 3 AS a, user_id % 3 AS b, length(event_type) % 3 AS c FROM events)""",
)
def bl2_hard(spark, sf):
    return bl.vote(_voters(spark, sf), ["event_id"], "hard")


@query(
    "bl2_mean_voting",
    """SELECT event_id, round((value / 500 + (user_id % 7) / 7.0::DOUBLE + 0.4) / 3, 6) AS y_pred FROM events""",
)
def bl2_mean(spark, sf):
    first = _voters(spark, sf).select("event_id", "model", F.col("proba")[0].alias("y_pred"))
    return rounded(bl.vote(first, ["event_id"], "mean"))


# all regression metrics of a fold, from (fold, y, p)
_NAMES = ("mse", "rmse", "mae", "r2", "nrmse", "mape", "max_error", "median_absolute_error", "mean_residual", "std_residual", "std_residual_sample", "explained_variance")


def _metrics_sql(pred: str) -> str:
    return f"""SELECT fold, avg((p - y) ** 2) AS mse, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae, 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) AS r2,
      sqrt(avg((p - y) ** 2)) / stddev_pop(y) AS nrmse, 100 * avg(abs((p - y) / y)) FILTER (y <> 0) AS mape, max(abs(p - y)) AS max_error, quantile_cont(abs(p - y), 0.5) AS median_absolute_error,
      avg(y - p) AS mean_residual, stddev_pop(y - p) AS std_residual, stddev_samp(y - p) AS std_residual_sample, 1 - var_pop(y - p) / var_pop(y) AS explained_variance
      FROM ({pred}) GROUP BY fold"""


def _cv_sql(train: str, test: str) -> str:
    """Fold summary of the regression of price on size; ``train`` and ``test`` give (fold, x, y)."""
    pred = f"SELECT t.fold, t.y, a + b * t.x AS p FROM ({test}) t JOIN (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ({train}) GROUP BY fold) USING (fold)"
    each = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM m" for m in _NAMES)
    return f"WITH m AS ({_metrics_sql(pred)}) SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS n FROM ({each}) GROUP BY metric"


def _linear():
    return bl.Baseline("linear_regression", "regression", "p_retailprice", ["p_partkey"])


_FOLDS = f"SELECT p_size::DOUBLE AS x, p_retailprice AS y, CAST((row_number() OVER (ORDER BY {hash_sql('p_partkey')}, p_partkey) - 1) % 3 AS INTEGER) AS fold FROM part"
_TIME = "SELECT x, y, k::INTEGER AS fold, i, n - (3 - k) * (n // 4) AS start, n // 4 AS size FROM (SELECT p_size::DOUBLE AS x, p_retailprice AS y, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), range(3) t(k)"
_HOLD = f"SELECT p_size::DOUBLE AS x, p_retailprice AS y, 0 AS fold, row_number() OVER (ORDER BY {hash_sql('p_partkey')}, p_partkey) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS ev FROM part"


@query("bl3_cross_validation", _cv_sql(f"SELECT g.fold, x, y FROM (SELECT DISTINCT fold FROM ({_FOLDS})) g JOIN ({_FOLDS}) f ON f.fold <> g.fold", _FOLDS))
def bl3_cv(spark, sf):
    return rounded(bl.cross_validate(part_prices(spark, sf), _linear, 3), 4)


@query(
    "bl3_holdout",
    f"""WITH m AS ({_metrics_sql(f"SELECT 0 AS fold, h.y, a + b * h.x AS p FROM ({_HOLD}) h, (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ({_HOLD}) WHERE NOT ev) WHERE h.ev")})
    SELECT metric, round(value, 4) AS value FROM ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM m" for m in _NAMES)})""",
)
def bl3_holdout(spark, sf):
    return rounded(bl.holdout(part_prices(spark, sf), _linear), 4)


@query("bl3_time_series", _cv_sql(f"SELECT * FROM ({_TIME}) WHERE i < start", f"SELECT * FROM ({_TIME}) WHERE i >= start AND i < start + size"))
def bl3_time(spark, sf):
    return rounded(bl.time_series_validate(part_prices(spark, sf), _linear, ["p_partkey"], 3), 4)


@query("bl3_classifier_folds")
def bl3_classifier(spark, sf):
    make = lambda: bl.Baseline("logistic_regression", "classification", "o_orderstatus", ["o_orderkey"])
    return rounded(bl.cross_validate(_orders(spark, sf), make, 3, "o_orderstatus"), 4)


@query("bl4_suite")
def bl4(spark, sf):
    parts = part_prices(spark, sf)
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return rounded(bl.run_suite(
        {"parts": (parts, "p_retailprice", "regression", ["p_partkey"]), "customers": (customers, "c_acctbal", "regression", ["c_custkey"])},
        ["linear_regression", "random_forest", "no_such_model"], times=False,
    ), 4)


@query(
    "bl8_anomaly_benchmark",
    """WITH n AS (SELECT avg(value) AS m, var_pop(value) AS v FROM events WHERE event_type <> 'error'),
    s AS (SELECT round((value - m) * (value - m) / v, 9) AS score, (event_type = 'error')::INT AS y FROM events, n),
    g AS (SELECT score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY 1),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT round(sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)), 5) AS roc_auc, round(sum(pos / p * tp / (tp + fp)), 5) AS average_precision FROM c""",
)
def bl8(spark, sf):
    df = table(spark, sf, "events").select("value", (F.col("event_type") == "error").cast("int").alias("y"))
    return rounded(bl.anomaly_benchmark(df, ["value"], "y"), 5)


# ---------------------------------------------------------------- scoring


def fitted_scorer(df, keys=("o_orderkey",)):
    """Normalizer and linear model for the order price from its priority and month."""
    norm = prepare.fit_robust(df, prepare.RobustConfig(categorical="frequency"), target="o_totalprice", exclude=list(keys))
    ready = norm.transform(df)
    feats = [c for c in norm.feature_names() if c in ready.columns]
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"),
                             LinearRegression(featuresCol="features", labelCol="o_totalprice")]).fit(ready)
    return scoring.Scorer(norm, model, list(keys))


@query("sc1_batch_scoring")
def sc1(spark, sf):
    df = _orders(spark, sf).drop("o_orderstatus")
    out, _ = fitted_scorer(df).score(df)
    return rounded(out, 4)


@query("sc1_custom_function", "SELECT event_id, round(value * 2 + 1, 6) AS prediction FROM events")
def sc1_custom(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")

    def fn(pdf):
        pdf["prediction"] = pdf["value"] * 2 + 1
        return pdf[["event_id", "prediction"]]

    return rounded(scoring.score_with_function(df, fn, "event_id long, prediction double"))


@query(
    "sc2_distinct_scoring",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 2 + l_tax * 100 + length(l_returnflag), 6) AS prediction FROM lineitem",
)
def sc2(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag")
    score = lambda d: d.withColumn("prediction", F.col("l_quantity") * 2 + F.col("l_tax") * 100 + F.length("l_returnflag"))
    out = scoring.score_distinct(df, ["l_quantity", "l_tax", "l_returnflag"], score, ["prediction"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction"))


@query(
    "sc3_fallback",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value WHEN event_id % 2 = 0 THEN value / 2 ELSE 0 END AS prediction,
    CASE WHEN event_id % 3 <> 0 THEN 'primary' WHEN event_id % 2 = 0 THEN 'fallback' ELSE 'constant' END AS source FROM events""",
)
def sc3(spark, sf):
    i = F.col("event_id")
    out = scoring.with_fallback(table(spark, sf, "events"), F.when(i % 3 != 0, F.col("value")), F.when(i % 2 == 0, F.col("value") / 2))
    return out.select("event_id", "prediction", "source")
