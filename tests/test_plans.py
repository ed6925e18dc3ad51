"""Plan shapes that matter at scale: pruned scans, pushed filters, no pairwise joins, no one-task windows."""

import pytest
from pyspark.sql import functions as F

from gridwright.operators import drift, joins, profile, sequence, split
from gridwright.queries import load
from gridwright.queries.base import table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    p = plan(profile.quality(table(spark, SF, "lineitem"), ["l_tax", "l_returnflag"]))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in p


def test_filter_is_pushed(spark):
    t = table(spark, SF, "orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    p = plan(profile.normalized_counts(t, ["o_orderstatus"]))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in p


def test_quality_is_one_scan_and_aggregates_before_the_shuffle(spark):
    p = plan(profile.quality(table(spark, SF, "lineitem")))
    assert p.count("FileScan") == 1 and "partial_count" in p


@pytest.mark.parametrize("name", ["jn1_first_match", "jn5_comparable", "drf3_kolmogorov_smirnov", "sc2_distinct_scoring", "spl2_stratified_sample", "enc10_vocabulary"])
def test_no_pairwise_join(spark, name):
    p = plan(load()[0][name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_ranks_are_cut_into_segments(spark):
    p = plan(split.folds(table(spark, SF, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5, "o_orderstatus"))
    # the window that ranks rows is partitioned by stratum and hash segment
    assert "row_number()" in p and "__seg" in p.split("row_number()")[1][:400]


def test_first_match_aggregates_before_the_shuffle(spark):
    p = plan(joins.first_match(table(spark, SF, "customer"), table(spark, SF, "orders"), "c_custkey", "o_custkey", ["o_orderkey"], "o_"))
    assert "partial_min_by" in p and "Window" not in p


def test_drift_has_no_row_join(spark):
    t = table(spark, SF, "orders")
    p = plan(drift._two_sided(t, t, ["o_totalprice"], True))
    assert "Join" not in p


def test_sequence_groups_share_one_shuffle(spark):
    out = sequence.sequences(table(spark, SF, "events"), ["user_id"], ["ts", "event_id"], ["value"], "value", 3, 1)
    assert plan(out).count("Exchange hashpartitioning") == 1
