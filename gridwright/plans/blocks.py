"""Pairs of rows by pairs of blocks, for work whose result is about all pairs.

Rows are dealt to numbered blocks by a hash of their name. Every block of one side meets every block of the other once, under the
number of the latter, so no key holds more than one block and the number of rows has no limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.plans.storage import written

BLOCK_ROWS = 512


def packed(df: DataFrame, key: str, cols: Sequence[str], size: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(block, items): about ``size`` rows a block as a list of structs of ``cols``; and the number of blocks."""
    rows = written(df.select(*cols), "rows")
    n = max(1, -(-rows.count() // size))
    lists = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct(*cols)).alias("items"))
    return written(lists, "blocks"), n


def block_pairs(left: DataFrame, right: DataFrame, n_right: int) -> DataFrame:
    """(a, b): lists of every pair of a left and a right block, each pair once."""
    copies = left.select(F.col("items").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("block"))
    return copies.join(right.select("block", F.col("items").alias("b")), "block").select("a", "b")
