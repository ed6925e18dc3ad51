"""Fitted operators as pipeline stages: each query fits a pipeline, saves it, loads it, and transforms with what was loaded. The SQL is
that of the operator itself."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from gridwright.plans import stages
from gridwright.plans.storage import scratch_path
from gridwright.queries.base import SQL, messy, query, rounded, table
from gridwright.queries.cleaning import KEY_COLS
from gridwright.queries.encoding import _orders, _robust_input


def _saved(train, df, *parts):
    """The pipeline of ``parts``, fitted on ``train``, applied to ``df`` after a round trip through files."""
    path = scratch_path(df.sparkSession, "model")
    Pipeline(stages=list(parts)).fit(train).write().save(path)
    return PipelineModel.load(path).transform(df)


@query("mv1_stage", SQL["mv1_mean_median"])
def mv1(spark, sf):
    df = messy(spark, sf).select(*KEY_COLS, "quantity", "price")
    return rounded(_saved(df, df, stages.Fill(strategies={"quantity": "mean", "price": "median"})))


@query("nrm1_stage", SQL["nrm1_standard"])
def nrm1(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = _saved(df, df, stages.Scale(cols=["l_quantity", "l_extendedprice"]))
    return rounded(out)


@query("enc1_stage", SQL["enc1_label"])
def enc1(spark, sf):
    t, early = _orders(spark, sf)
    return _saved(early, t, stages.Category(col="o_custkey", out="code")).select("o_orderkey", "code")


@query("enc8_stage", SQL["enc8_quantile_bins"])
def enc8(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY_COLS, F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice")).alias("price"))
    return rounded(_saved(df, df, stages.Bins(cols=["price"])).drop("price"))


@query("pip1_stage", SQL["pip1_prepare"])
def pip1(spark, sf):
    df = messy(spark, sf)
    return rounded(_saved(df, df, stages.Prepare(key_cols=KEY_COLS)))


@query("pip2_stage", SQL["pip2_robust"])
def pip2(spark, sf):
    df = _robust_input(spark, sf)
    out = _saved(df, df, stages.Normalize(exclude=["o_orderkey"]))
    return rounded(out.select("o_orderkey", "price", "priority", "o_orderdate_year", "o_orderdate_month", "o_orderdate_dayofweek", "o_orderdate_day_sin"))
