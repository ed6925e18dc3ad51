"""Per-query ranking metrics. Ranks survive a query that holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import number_array
from gridwright.plans.ordered import MAX_GROUP_ROWS, order_position


def ranked(df: DataFrame, query: str, score: str, relevance: str, key: str, max_group: int = MAX_GROUP_ROWS) -> DataFrame:
    """Adds the place by score and the place in the ideal order (ties by key)."""
    out = order_position(df, [query], [F.col(score).desc(), F.col(key).asc()], "rank", max_group=max_group)
    return order_position(out, [query], [F.col(relevance).desc(), F.col(key).asc()], "ideal", max_group=max_group)


def ndcg(df: DataFrame, query: str, relevance: str, k: int, score: str | None = None) -> DataFrame:
    """Mean NDCG@k with linear gains; a query without any gain counts 0. `df` has rank and ideal.

    With `score`, rows of one score share their places: each gains the mean of its group at every place the group takes, so no
    order among ties counts. Without it they stand in the order of `rank`.
    """
    gain = lambda place: F.when(F.col(place) <= k, F.col(relevance) / F.log2(F.col(place) + 1.0)).otherwise(0.0)
    best = F.sum(gain("ideal")).alias("best")
    if score is None:
        per = df.groupBy(query).agg(F.sum(gain("rank")).alias("dcg"), best)
    else:
        # discounts of the first places, summed: those of a group are the difference at its ends
        upto = number_array(np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2, k + 2)))]))
        at = lambda place: F.get(upto, F.least(place, F.lit(k)).cast("int"))
        groups = df.groupBy(query, score).agg(F.count("*").alias("c"), F.sum(relevance).alias("r"), F.min("rank").alias("first"), best)
        dcg = F.col("r") / F.col("c") * (at(F.col("first") + F.col("c") - 1) - at(F.col("first") - 1))
        per = groups.groupBy(query).agg(F.sum(dcg).alias("dcg"), F.sum("best").alias("best"))
    value = F.when(F.col("best") > 0, F.col("dcg") / F.when(F.col("best") > 0, F.col("best"))).otherwise(0.0)
    return per.agg(F.avg(value).alias("ndcg")).select(F.lit(k).alias("k"), "ndcg")


def reciprocal_ranks(df: DataFrame, query: str, relevance: str) -> DataFrame:
    """mrr_first: the first relevant item per query; mean_reciprocal_rank_all: every relevant item."""
    hit = F.col(relevance) > 0
    per = df.groupBy(query).agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit, 1.0 / F.col("rank"))).alias("total"), F.count_if(hit).alias("n"),
    )
    return per.agg(
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_first"),
        (F.sum("total") / F.sum("n")).alias("mean_reciprocal_rank_all"),
    )


def precision_recall_at(df: DataFrame, query: str, relevance: str, ks: Sequence[int]) -> DataFrame:
    """Mean precision@k and recall@k (0 for a query without relevant items)."""
    hit = F.col(relevance) > 0
    per = df.groupBy(query).agg(
        *[F.count_if(hit & (F.col("rank") <= k)).alias(f"h{k}") for k in ks], F.count_if(hit).alias("n")
    )
    wide = per.agg(
        *[F.avg(F.col(f"h{k}") / k).alias(f"p{k}") for k in ks],
        *[F.avg(F.when(F.col("n") > 0, F.col(f"h{k}") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)).alias(f"r{k}") for k in ks],
    )
    cells = [F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("precision"), F.col(f"r{k}").alias("recall")) for k in ks]
    return wide.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
