"""Connected components by alternating large and small stars: a logarithmic number of rounds, also on long chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.storage import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each larger neighbour moves to the node's smallest neighbour (itself included). Small: each smaller
    neighbour and the node move to the smallest neighbour. Minima are aggregates; no neighbourhood is collected."""
    if large:
        pairs = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached. Nulls and loops are
    left out; an empty table gives an empty table. ``parts``: files an intermediate table has at most."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", parts)
    mark = None
    while True:
        now = stored(_star(_star(now, True), False), "edges", parts)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stored(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()), "roots", parts)
