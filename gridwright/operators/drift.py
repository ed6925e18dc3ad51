"""Drift between two tables and their comparison. Distributions are compared on counts of distinct
values; the two sides meet in one aggregate, so there is no join of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import as_number, numeric_columns, present, scalar_columns, string_columns
from gridwright.functions.statistics import ratio
from gridwright.operators import profile
from gridwright.plans.ordered import prefix_sums


def _two_sided(ref: DataFrame, cur: DataFrame, cols: Sequence[str], numeric: bool) -> DataFrame:
    """(column, v, a, b): distinct values with their counts on both sides."""
    def cells(df, side):
        get = (lambda c: as_number(df, c)) if numeric else (lambda c: present(df, c).cast("string"))
        long = df.select(*[get(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "v")
        return long.where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))

    both = cells(ref, 0).unionByName(cells(cur, 1))
    return both.groupBy("column", "v").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b"),
    )


def categorical_shares(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = _two_sided(ref, cur, cols, numeric=False)
    tot = counts.groupBy("column").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return counts.join(tot, "column").select(
        "column", "v", ratio(F.col("a"), F.col("ta")).alias("p"), ratio(F.col("b"), F.col("tb")).alias("q")
    )


def jensen_shannon(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance (square root, natural log) per categorical column."""
    s = categorical_shares(ref, cur, cols)
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    div = F.sum(part("p") + part("q")) / 2
    return s.groupBy("column").agg(F.sqrt(F.greatest(div, F.lit(0.0))).alias("score"))


def half_l1(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    s = categorical_shares(ref, cur, cols)
    return s.groupBy("column").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("score"))


def kolmogorov_smirnov(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two-sample statistic per numeric column: the largest gap of the running shares."""
    counts = _two_sided(ref, cur, cols, numeric=True)
    cum = prefix_sums(
        counts, ["column"], ["v"], {"ca": F.col("a"), "cb": F.col("b")}, totals={"ca": "ta", "cb": "tb"}
    )
    gap = F.abs(ratio(F.col("ca"), F.col("ta")) - ratio(F.col("cb"), F.col("tb")))
    return cum.groupBy("column").agg(F.max(gap).alias("score"))


def mean_shift(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """|mean difference| / (reference std + 1e-8)."""
    a = profile.column_rows(ref, list(cols), {"m": lambda c: F.avg(as_number(ref, c)), "s": lambda c: F.stddev_samp(as_number(ref, c))})
    b = profile.column_rows(cur, list(cols), {"m2": lambda c: F.avg(as_number(cur, c))})
    return a.join(b, "column").select("column", (F.abs(F.col("m") - F.col("m2")) / (F.col("s") + 1e-8)).alias("score"))


def detect_drift(
    ref: DataFrame, cur: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.1
) -> DataFrame:
    """(column, method, score, drifted) for the columns both tables have."""
    cols = [c for c in (cols or scalar_columns(ref)) if c in cur.columns]
    nums = [c for c in cols if c in numeric_columns(ref)]
    cats = [c for c in cols if c in string_columns(ref)]
    parts = []
    if cats:
        parts.append(jensen_shannon(ref, cur, cats).withColumn("method", F.lit("jensen_shannon")))
    if nums:
        parts.append(kolmogorov_smirnov(ref, cur, nums).withColumn("method", F.lit("ks_statistic")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("column", "method", "score", (F.col("score") > threshold).cast("int").alias("drifted"))


def drift_summary(scores: DataFrame) -> DataFrame:
    flagged = F.sum("drifted")
    return scores.agg(
        F.count("*").alias("n_columns"), flagged.alias("n_drifted"), (100.0 * flagged / F.count("*")).alias("drifted_pct"),
        F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted") == 1, F.col("column")))), ",").alias("drifted_columns"),
    )


def compare_tables(a: DataFrame, b: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(item, column, value): shapes, columns of one side only, differences of distinct counts, means
    and stds of common columns, and drift scores."""
    common = [c for c in a.columns if c in b.columns and (cols is None or c in cols)]
    nums = [c for c in common if c in numeric_columns(a) and c in numeric_columns(b)]
    spark = a.sparkSession
    fixed = [("only_in_first", c, 1.0) for c in a.columns if c not in b.columns]
    fixed += [("only_in_second", c, 1.0) for c in b.columns if c not in a.columns]
    fixed += [("n_columns_first", "", float(len(a.columns))), ("n_columns_second", "", float(len(b.columns))), ("n_common", "", float(len(common)))]
    out = spark.createDataFrame(fixed, "item string, column string, value double")
    for name, df in (("n_rows_first", a), ("n_rows_second", b)):
        out = out.unionByName(df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("item"), F.lit("").alias("column"), "value"))
    qa = profile.quality(a, common).select("column", F.col("n_unique").alias("x"))
    qb = profile.quality(b, common).select("column", F.col("n_unique").alias("y"))
    out = out.unionByName(
        qa.join(qb, "column").select(F.lit("unique_difference").alias("item"), "column", (F.col("y") - F.col("x")).cast("double").alias("value"))
    )
    if nums:
        def moments(df, p):
            return profile.column_rows(df, nums, {f"m{p}": lambda c: F.avg(as_number(df, c)), f"s{p}": lambda c: F.stddev_samp(as_number(df, c))})

        d = moments(a, 1).join(moments(b, 2), "column").select(
            "column", (F.col("m2") - F.col("m1")).alias("mean_difference"), (F.col("s2") - F.col("s1")).alias("std_difference")
        )
        out = out.unionByName(d.unpivot(["column"], ["mean_difference", "std_difference"], "item", "value").select("item", "column", "value"))
    scores = detect_drift(a, b, common)
    return out.unionByName(scores.select(F.lit("drift").alias("item"), "column", F.col("score").alias("value")))
