"""MLlib baselines, ensembles, and the evaluation loops over folds, models and data sets."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators import outlier, split
from gridwright.operators.classification import binary_areas, log_loss, multiclass_areas
from gridwright.operators.encode import Design, fit_design
from gridwright.operators.evaluate import evaluate, long_form
from gridwright.operators.experiments import fold_summary
from gridwright.plans.storage import written

log = logging.getLogger(__name__)

BOOSTED = ("gradient_boosting", "xgboost", "lightgbm", "catboost")
NAMES = ("random_forest", *BOOSTED, "logistic_regression", "linear_regression")


def estimator(name: str, task: str, n_classes: int = 2, trees: int = 100, seed: int = 42):
    """MLlib estimator behind a baseline name. Boosting is binary in MLlib; more classes are
    handled one against the rest."""
    cls = task == "classification"
    label = dict(featuresCol="features", labelCol="__label")
    if name == "random_forest":
        return (RandomForestClassifier if cls else RandomForestRegressor)(numTrees=trees, seed=seed, **label)
    if name in BOOSTED:
        if not cls:
            return GBTRegressor(maxIter=trees, seed=seed, **label)
        boosted = GBTClassifier(maxIter=trees, seed=seed, **label)
        return boosted if n_classes == 2 else OneVsRest(classifier=boosted, **label)
    if name == "logistic_regression" and cls:
        return LogisticRegression(maxIter=100, **label)
    if name == "linear_regression" and not cls:
        return LinearRegression(**label)
    raise ValueError(f"{name} does not support {task}")


def default_baselines(task: str) -> tuple[str, ...]:
    linear = "logistic_regression" if task == "classification" else "linear_regression"
    return ("random_forest", "gradient_boosting", linear)


class Baseline:
    """Design matrix plus estimator; predictions come as key, y_true, y_pred (and proba). Classes are numbered in sorted
    order of their names."""

    def __init__(self, name: str, task: str, target: str, key_cols: Sequence[str], trees: int = 100, seed: int = 42):
        self.name, self.task, self.target = name, task, target
        self.key_cols, self.trees, self.seed = list(key_cols), trees, seed
        self.model = None
        self.design: Design | None = None
        self.labels: list[str] = []

    def fit(self, df: DataFrame) -> "Baseline":
        df = df.where(F.col(self.target).isNotNull())
        kind = "linear" if self.name.endswith("regression") else "tree"
        self.design = fit_design(df, self.target, kind, exclude=self.key_cols)
        work = self.design.transform(df)
        if self.task == "classification":
            names = df.select(F.col(self.target).cast("string").alias("c")).distinct()
            self.labels = sorted(r[0] for r in names.collect())  # the classes
            work = work.withColumn("__label", (F.array_position(self._names(), F.col(self.target).cast("string")) - 1).cast("double"))
        else:
            work = work.withColumn("__label", F.col(self.target).cast("double"))
        self.model = estimator(self.name, self.task, len(self.labels) or 2, self.trees, self.seed).fit(work.select("features", "__label"))
        return self

    def _names(self):
        return F.array(*[F.lit(x) for x in self.labels])

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.design.transform(df))
        keys = [F.col(k) for k in self.key_cols]
        if self.task == "regression":
            return out.select(*keys, F.col(self.target).cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))
        cols = [*keys, F.col(self.target).cast("string").alias("y_true"), F.element_at(self._names(), F.col("prediction").cast("int") + 1).alias("y_pred")]
        if "probability" in out.columns:
            cols.append(vector_to_array("probability").alias("proba"))
        return out.select(*cols)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """(metric, value) on a table: of labels by name; of probabilities where the true class was there at fit time."""
        pred = self.predict(df)
        out = evaluate(pred.drop("proba"), self.task)
        if "proba" in pred.columns:
            index = lambda c: (F.array_position(self._names(), F.col(c)) - 1).cast("int").alias(c)
            known = pred.select(*self.key_cols, index("y_true"), index("y_pred"), "proba").where("y_true >= 0")
            out = out.unionByName(long_form(multiclass_areas(known))).unionByName(long_form(log_loss(known)))
        return out


def create_baselines(names: Sequence[str], task: str, target: str, key_cols: Sequence[str], **kw) -> dict[str, Baseline]:
    return {n: Baseline(n, task, target, key_cols, **kw) for n in names}


def vote(predictions: DataFrame, key_cols: Sequence[str], how: str = "soft") -> DataFrame:
    """Combine the models' rows (key, model, y_pred, proba): soft averages the probability arrays, hard
    takes the most frequent label (smallest on ties), mean averages predictions. One shuffle: a key has one row
    per model, so its group is small."""
    if how == "mean":
        return predictions.groupBy(*key_cols).agg(F.avg("y_pred").alias("y_pred"))
    if how == "hard":
        labels = predictions.groupBy(*key_cols).agg(F.sort_array(F.collect_list("y_pred")).alias("v"))
        count = lambda x: F.size(F.filter("v", lambda y: y == x))
        best = F.array_max(F.transform("v", lambda x: F.struct(count(x).alias("n"))))
        return labels.withColumn("n", best["n"]).select(*key_cols, F.element_at(F.filter("v", lambda x: count(x) == F.col("n")), 1).alias("y_pred"))
    arrays = predictions.groupBy(*key_cols).agg(F.collect_list("proba").alias("v"))
    mean = F.transform(F.sequence(F.lit(0), F.size(F.element_at("v", 1)) - 1), lambda i: F.aggregate("v", F.lit(0.0), lambda a, p: a + p[i]) / F.size("v"))
    means = arrays.select(*key_cols, mean.alias("p"))
    return means.select(*key_cols, (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("y_pred"), F.array_max("p").alias("confidence"))


def _validated(folds: DataFrame, make: Callable[[], Baseline], k: int, train: str, test: str) -> DataFrame:
    """(fold, metric, value): one fit a fold, as in any validation. The folds are written once; of each fold only its
    metric rows come to the driver."""
    spark, folds, rows = folds.sparkSession, written(folds, "folds"), []
    for i in range(k):
        model = make().fit(folds.where(train.format(i)).drop("fold", "role"))
        got = model.evaluate(folds.where(test.format(i)))
        rows += [(i, r["metric"], r["value"]) for r in got.collect()]
    return spark.createDataFrame(rows, "fold int, metric string, value double")


def fold_metrics(
    df: DataFrame, make: Callable[[], Baseline], k: int = 5, stratify: str | None = None, seed: int = 42
) -> DataFrame:
    """(fold, metric, value): fit on the other folds, evaluated on each."""
    return _validated(split.folds(df, make().key_cols, k, stratify, seed), make, k, "fold <> {}", "fold = {}")


def cross_validate(df: DataFrame, make: Callable[[], Baseline], k: int = 5, stratify: str | None = None, seed: int = 42) -> DataFrame:
    return fold_summary(fold_metrics(df, make, k, stratify, seed))


def holdout(df: DataFrame, make: Callable[[], Baseline], share: float = 0.2, stratify: str | None = None, seed: int = 42, times: bool = False) -> DataFrame:
    """(metric, value) on the rows held out; with ``times`` also the seconds of fit and evaluation."""
    parts = written(split.train_eval(df, make().key_cols, share, stratify, seed), "holdout")
    began = time.time()
    model = make().fit(parts.where("split = 'train'").drop("split"))
    fitted = time.time()
    rows = [(r["metric"], r["value"]) for r in model.evaluate(parts.where("split = 'eval'")).collect()]
    if times:
        rows += [("train_time", fitted - began), ("eval_time", time.time() - fitted)]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def time_series_validate(df: DataFrame, make: Callable[[], Baseline], order_cols: Sequence[str], k: int = 5) -> DataFrame:
    folds = split.time_folds(df, order_cols, k)
    return fold_summary(_validated(folds, make, k, "fold = {} and role = 'train'", "fold = {} and role = 'test'"))


def run_suite(datasets: dict[str, tuple[DataFrame, str, str, list[str]]], models: Sequence[str], trees: int = 100, times: bool = True) -> DataFrame:
    """results(model, dataset, metric, value) over models x data sets; data sets map to (table, target,
    task, key columns). A failing combination is logged and left out."""
    spark = next(iter(datasets.values()))[0].sparkSession
    rows: list[tuple] = []
    for d, (df, target, task, keys) in datasets.items():
        for m in models:
            try:
                res = holdout(df, lambda: Baseline(m, task, target, keys, trees=trees), times=times).collect()
                rows += [(m, d, r["metric"], r["value"]) for r in res]
            except Exception as e:  # one bad model must not stop the suite
                log.warning("%s on %s skipped: %s", m, d, e)
    return spark.createDataFrame(rows, "model string, dataset string, metric string, value double")


def anomaly_benchmark(df: DataFrame, cols: Sequence[str], y_true: str) -> DataFrame:
    """Fit the Mahalanobis score on normal rows only, evaluate it on all rows."""
    normal = df.where(F.col(y_true) == 0)
    scored = outlier.mahalanobis(df, cols, fit_on=normal)
    return binary_areas(scored, "score", y_true)
