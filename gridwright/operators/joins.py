"""Lookup joins over several tables and counts that replace pair listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.plans.blocks import block_pairs, packed
from gridwright.plans.ordered import prefix_sums


def first_match(
    primary: DataFrame, related: DataFrame, primary_key: str, foreign_key: str,
    order_cols: Sequence[str], prefix: str,
) -> DataFrame:
    """Left join with the first related row (under `order_cols`) of each key.

    The first row is an aggregate (`min_by`), reduced before the shuffle, so a key with very many
    related rows never meets in one task as rows.
    """
    cols = [c for c in related.columns if c != foreign_key]
    first = related.groupBy(F.col(foreign_key).alias("__fk")).agg(
        F.min_by(F.struct(*cols), F.struct(*order_cols)).alias("__r")
    )
    joined = primary.join(first, F.col(primary_key) == F.col("__fk"), "left")
    return joined.select(
        *primary.columns,
        F.col("__fk").isNotNull().cast("int").alias(f"{prefix}found"),
        *[F.col("__r")[c].alias(f"{prefix}{c}") for c in cols],
    )


def multi_table(
    primary: DataFrame, related: dict[str, DataFrame], relationships: dict[str, dict]
) -> DataFrame:
    """Attach the first matching row of every related table. A relationship names foreign_key (in
    the related table), primary_key (in the primary table) and order_cols."""
    out = primary
    for name, r in relationships.items():
        out = first_match(out, related[name], r["primary_key"], r["foreign_key"], r["order_cols"], f"{name}_")
    return out


def align_distributions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two (value, share) tables on the union of values, absent shares as 0."""
    a = left.select("value", F.col("share").alias("p"))
    b = right.select("value", F.col("share").alias("q"))
    return a.join(b, "value", "full_outer").select(
        "value", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")
    )


def domain_pairs(results: DataFrame, domain: str) -> DataFrame:
    """Every ordered pair of two different domains; only the distinct names are paired, block by block."""
    names = results.select(F.col(domain).alias("name")).where(F.col(domain).isNotNull()).distinct()
    blocks, n = packed(names, "name", ["name"])
    pairs = block_pairs(blocks, blocks, n).select(F.explode("a.name").alias("source"), "b")
    return pairs.select("source", F.explode("b.name").alias("target")).where(F.col("source") != F.col("target"))


def comparable_counts(df: DataFrame, key: str, time: str, event: str) -> DataFrame:
    """For each row with an event, the number of rows with a later time.

    The count of later rows per distinct time is a prefix sum, so no pair is ever formed.
    """
    times = df.groupBy(time).agg(F.count("*").alias("__n"))
    later = prefix_sums(times, [], [F.col(time).desc()], {"n_later": F.col("__n")}, inclusive=False)
    later = later.select(F.col(time).alias("__t"), "n_later")
    rows = df.where(F.col(event) == 1)
    return rows.join(later, F.col(time) == F.col("__t")).select(key, time, "n_later")


def combine_target(features: DataFrame, target: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    return features.join(target, list(key_cols))
