"""Robust covariance against a search of all subsets, and rows planted far away."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import outlier, pretraining
from gridwright.operators.robust import chi_square_quantile, fit_robust_covariance, robust_envelope


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_least_determinant_of_all_subsets(spark, seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(11, 2)) @ [[1, 0.5], [0, 1]], r.normal(9, 1, size=(3, 2))])
    h = (14 + 2 + 1) // 2
    least = min(np.linalg.det(np.cov(x[list(s)].T, bias=True)) for s in itertools.combinations(range(14), h))
    fit = fit_robust_covariance(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"])
    assert fit.h == h and fit.raw_determinant == pytest.approx(least, rel=1e-9)


def test_planted_rows_do_not_mask_themselves(spark):
    """A fifth of the rows in one place: the classical distance calls them ordinary, the robust one does not."""
    r = np.random.default_rng(5)
    good = r.normal(size=(4000, 3)) @ [[1, 0.8, 0], [0, 1, 0], [0, 0, 2]]
    bad = r.normal([8, -8, 8], 0.5, size=(1000, 3))
    rows = [(i, i >= 4000, *map(float, v)) for i, v in enumerate(np.concatenate([good, bad]))]
    df = spark.createDataFrame(rows, "k long, planted boolean, a double, b double, c double").repartition(5)
    caught = lambda d: d.where("planted").agg(F.avg("is_anomaly")).first()[0]
    found = robust_envelope(df, ["a", "b", "c"], 0.2)
    assert caught(found) > 0.99 and found.where("not planted").agg(F.avg("is_anomaly")).first()[0] < 0.01
    plain = outlier.mahalanobis(df, ["a", "b", "c"])
    assert plain.where("planted").agg(F.avg("score")).first()[0] < 8 < found.where("planted").agg(F.avg("score")).first()[0]
    fit = fit_robust_covariance(df, ["a", "b", "c"])
    assert np.allclose(fit.mean, 0, atol=0.15) and np.allclose(fit.cov, np.cov(good.T, bias=True), atol=0.4)


def test_degenerate_tables(spark):
    flat = spark.createDataFrame([(1.0, 2.0)] * 6 + [(None, 2.0)], "a double, b double")
    assert robust_envelope(flat, ["a", "b"]).count() == 7
    assert robust_envelope(spark.createDataFrame([(1.0,)], "a double"), ["a"]).count() == 1
    with pytest.raises(ValueError):
        fit_robust_covariance(flat.limit(0), ["a", "b"])


def test_chi_square():
    for p, k, want in ((0.975, 2, 7.377758908227871), (0.5, 1, 0.454936423119572), (0.5, 10, 9.341817765591965), (0.975, 10, 20.483177350807388)):
        assert chi_square_quantile(p, k) == pytest.approx(want, rel=1e-9)


def batches(spark, sizes, dims=6):
    r = np.random.default_rng(8)
    rows = []
    for b, n in enumerate(sizes):
        a = r.normal(size=(n, dims))
        p = a + r.normal(size=(n, dims)) * 0.8
        rows += [(f"{b}-{i}", b, a[i].tolist(), p[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "key string, batch_id long, anchor array<double>, positive array<double>")


@pytest.mark.parametrize("keep_self", [False, True])
@pytest.mark.parametrize("temperature", [0.07, 0.001])
def test_loss_by_blocks_equals_the_matrix(spark, keep_self, temperature):
    df = batches(spark, [90, 1, 7, 40])
    cols = ("loss", "correct", "positive_similarity", "negative_similarity")
    read = lambda d: {r["key"]: [r[c] for c in cols] for r in d.collect()}
    whole = read(pretraining.info_nce(df, temperature=temperature, keep_self=keep_self))
    cut = read(pretraining.info_nce(df, temperature=temperature, keep_self=keep_self, block=16))
    assert whole.keys() == cut.keys() and len(cut) == 138
    assert all(cut[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in whole.items())


def test_statistics_by_sums_equal_the_matrix(spark):
    df = batches(spark, [90, 1, 7, 40])
    whole, cut = pretraining.similarity_statistics(df).first(), pretraining.similarity_statistics(df, block=16).first()
    assert list(cut) == pytest.approx(list(whole), rel=1e-9)


def test_a_batch_of_many_rows(spark):
    """20,000 rows of one batch: four hundred million pairs, no matrix of them."""
    df = spark.range(0, 20_000, 1, 8).select(
        F.col("id").cast("string").alias("key"), F.lit(0).cast("long").alias("batch_id"),
        *[F.array(*[F.pmod(F.xxhash64("id", F.lit(j), F.lit(s)), F.lit(1000)) / 500 - 1 for j in range(4)]).alias(c) for s, c in ((1, "anchor"), (2, "positive"))],
    )
    out = pretraining.info_nce(df).agg(F.count("*"), F.min("loss"), F.avg("negative_similarity")).first()
    assert out[0] == 20_000 and out[1] > 0
    a, p = (np.array([r[0] for r in df.select(c).collect()]) for c in ("anchor", "positive"))
    a, p = a / np.linalg.norm(a, axis=1, keepdims=True), p / np.linalg.norm(p, axis=1, keepdims=True)
    sums = (a @ p.sum(axis=0) - (a * p).sum(axis=1)) + (a @ a.sum(axis=0) - 1)
    assert out[2] == pytest.approx(sums.mean() / (2 * 20_000 - 2), rel=1e-6)
