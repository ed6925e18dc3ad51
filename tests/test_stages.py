"""Pipelines of fitted operators: what is loaded gives the rows of what was fitted, also on other data."""

import pytest
from pyspark.ml import Pipeline, PipelineModel

from gridwright.plans import stages

SCHEMA = "k long, x double, n long, s string, d timestamp_ntz"


@pytest.fixture(scope="module")
def tables(spark):
    from datetime import datetime, timedelta

    cell = lambda i: (i, None if i % 7 == 0 else i * 1.5, None if i % 5 == 0 else i % 11, None if i % 6 == 0 else f"s{i % 4}", datetime(2024, 1, 1) + timedelta(hours=i))
    train = spark.createDataFrame([cell(i) for i in range(200)], SCHEMA)
    other = spark.createDataFrame([cell(i) for i in range(150, 260)] + [(999, None, None, "unseen", None), (1000, None, None, None, None)], SCHEMA)
    return train, other


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


PIPELINES = {
    "fill": lambda: [stages.Fill(strategies={"x": "median", "n": "mode", "s": "constant"})],
    "scale": lambda: [stages.Scale(cols=["x", "n"], method="robust")],
    "bins": lambda: [stages.Bins(cols=["x", "n"], n_bins=10)],
    "uniform bins": lambda: [stages.Bins(cols=["x"], n_bins=4, kind="uniform")],
    "label": lambda: [stages.Category(col="s", out="code")],
    "frequency": lambda: [stages.Category(col="s", method="frequency", unseen="most_frequent")],
    "target": lambda: [stages.Category(col="s", method="target", target="x")],
    "prepare": lambda: [stages.Prepare(key_cols=["k"], config={"outlier_method": "zscore"})],
    "normalize": lambda: [stages.Normalize(exclude=["k"])],
    "normalize one-hot": lambda: [stages.Normalize(exclude=["k"], config={"categorical": "onehot"})],
    "chain": lambda: [stages.Fill(strategies={"x": "mean", "s": "mode"}), stages.Category(col="s", out="code"), stages.Scale(cols=["x", "code"]), stages.Bins(cols=["n"], n_bins=5)],
}


@pytest.mark.parametrize("name", PIPELINES)
def test_round_trip(spark, tables, tmp_path, name):
    train, other = tables
    pipeline = Pipeline(stages=PIPELINES[name]())
    pipeline.write().save(str(tmp_path / "unfitted"))
    fitted = Pipeline.load(str(tmp_path / "unfitted")).fit(train)
    fitted.write().save(str(tmp_path / "model"))
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    for df in (train, other):
        want = rows(fitted.transform(df))
        assert rows(loaded.transform(df)) == want and len(want) > 0


def test_a_model_keeps_what_it_was_fitted_on(spark, tables, tmp_path):
    """The fill values and codes come from the training rows, not from the rows that are transformed."""
    train, other = tables
    Pipeline(stages=PIPELINES["chain"]()).fit(train).write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    last = {r["k"]: r for r in loaded.transform(other).collect()}
    # an unseen category has code -1, scaled by the training rows' mean and deviation of the codes
    codes = [r["code"] for r in Pipeline(stages=PIPELINES["chain"]()[:2]).fit(train).transform(train).collect()]
    mean = sum(codes) / len(codes)
    deviation = (sum((c - mean) ** 2 for c in codes) / len(codes)) ** 0.5
    assert last[999]["code"] == pytest.approx((-1 - mean) / deviation) and last[1000]["x"] == pytest.approx(0.0, abs=1e-12)
