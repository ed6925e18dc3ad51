"""Special functions, design matrices, model quality and draws that do not depend on the number of rows."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridwright.functions.special import erfc, normal_quantile
from gridwright.operators import augment, outlier, profile, significance
from gridwright.operators.baselines import Baseline, cross_validate, run_suite
from gridwright.operators.encode import fit_design
from gridwright.operators.validate import Rules, ValidationFailed, validate
from gridwright.plans.storage import scratch_path, shared_dir


def test_erfc_and_normal_quantile(spark):
    xs = [x / 37 for x in range(-400, 1000)] + [0.46875, 4.0, 26.5, 28.0]
    rows = spark.createDataFrame([(x,) for x in [*xs, None, float("nan")]], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    for r in rows[:-2]:
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-13, abs=1e-300)
    assert rows[-2].y is None and math.isnan(rows[-1].y)
    ps = [1e-300, 1e-12, 0.02425, 0.5, 0.97575, 1 - 1e-12] + [i / 997 for i in range(1, 997)]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    for r in rows[:-3]:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-9, abs=1e-12)
    assert [r.z for r in rows[-3:]] == [None] * 3


def test_design_with_a_thousand_levels(spark):
    df = spark.range(4_000).select("id", F.format_string("l%04d", F.col("id") % 1000).alias("c"), (F.col("id") % 7).cast("double").alias("y"))
    design = fit_design(df, "y", "linear", exclude=["id"])
    new = df.where("id < 1000").unionByName(spark.createDataFrame([(5_000, "unseen", 0.0), (5_001, None, 0.0)], "id long, c string, y double"))
    rows = {r.id: r.v for r in design.transform(new).select("id", vector_to_array("features").alias("v")).collect()}
    assert len(rows[0]) == 999 and sum(rows[0]) == 0 and sum(rows[5_000]) == 0 and sum(rows[5_001]) == 0
    assert all(rows[i][i - 1] == 1.0 and sum(rows[i]) == 1.0 for i in range(1, 1000, 97))
    tree = fit_design(df, "y", "tree", exclude=["id"]).transform(new)
    codes = {r.id: r.v[0] for r in tree.select("id", vector_to_array("features").alias("v")).collect()}
    assert codes[0] == 0 and codes[999] == 999 and codes[5_000] == -1


def test_trees_take_many_levels_and_learn(spark):
    df = spark.range(3_000).select("id", F.format_string("s%02d", F.col("id") % 40).alias("s"), F.when(F.col("id") % 40 < 20, "a").otherwise("b").alias("y"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("x"))
    for name in ("random_forest", "gradient_boosting", "logistic_regression"):
        metrics = {r.metric: r.value for r in Baseline(name, "classification", "y", ["id"], trees=10).fit(df).evaluate(df).collect()}
        assert metrics["accuracy"] > 0.99 and metrics["roc_auc"] > 0.99 and metrics["log_loss"] < 0.3, name


def test_cross_validation_of_a_classifier_has_probability_metrics(spark):
    df = spark.range(600).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 > 4, "p").otherwise("q").alias("y"))
    got = {r.metric: r for r in cross_validate(df, lambda: Baseline("logistic_regression", "classification", "y", ["id"]), 3).collect()}
    assert {"accuracy", "f1", "roc_auc", "average_precision", "log_loss"} <= set(got) and got["roc_auc"]["mean"] > 0.99
    suite = run_suite({"d": (df, "y", "classification", ["id"])}, ["logistic_regression"])
    assert {"train_time", "eval_time"} <= {r.metric for r in suite.collect()}


def test_forest_scores_outliers_highest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (2_000, 2)))] + [(10_000 + i, 9.0 + i, -9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = outlier.IsolationForest(["a", "b"], ["id"]).fit(df)
    top = [r.id for r in forest.score(df).orderBy(F.desc("score")).limit(5).collect()]
    assert sorted(top) == [10_000 + i for i in range(5)]


@pytest.mark.parametrize("n", [900, 1_100, 20_000])
def test_bootstrap_draws_blocks_at_every_size(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 50).cast("double").alias("v"))
    means = [r.mean for r in significance.bootstrap_means(df, "v", "id", 300).collect()]
    assert np.std(means) == pytest.approx(14.43 / math.sqrt(n), rel=0.35)


def test_cutmix_partner_does_not_depend_on_other_rows_gate(spark):
    df = spark.range(200).select("id", F.array(*[F.col("id") * 10.0 + i for i in range(6)]).alias("x"), F.array(*[F.lit(1)] * 6).alias("m"))
    out = {r.id: r.x for r in augment.cutmix(df, ["id"], probability=1.0).collect()}
    assert len(out) == 200
    partners = {d: {int(v // 10) for v in x} - {d} for d, x in out.items()}
    assert all(len(p) <= 1 for p in partners.values()) and sum(map(len, partners.values())) == 200


def test_strict_validation_names_every_error(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValidationFailed) as e:
        validate(df, Rules(expected_columns=tuple(["a", *[f"c{i}" for i in range(40)]])), strict=True)
    assert all(f"c{i}" in str(e.value) for i in range(40))


def test_top_values_of_long_texts(spark):
    long_ = ["x" * 500 + str(i) for i in range(3)]
    rows = [(t,) for t, n in zip(long_, (5, 3, 2), strict=True) for _ in range(n)] + [("short",)] * 4
    df = spark.createDataFrame(rows, "t string")
    got = [(r["rank"], r["value"], r["count"]) for r in profile.top_values(df, ["t"], 3).orderBy("rank").collect()]
    assert got == [(1, long_[0], 5), (2, "short", 4), (3, long_[1], 3)]
    plan = profile.value_counts(df, ["t"], narrow=True)._jdf.queryExecution().toString()
    assert "md5" in plan


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
