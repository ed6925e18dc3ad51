"""Position of a value among sorted literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.functions.columns import number_array

#: More edges than these are searched in an array: a tree of so many comparisons is compiled badly.
TREE_EDGES = 64


def passed_in(x: Column, edges: Column, n: int) -> Column:
    """How many entries of a sorted array of at most ``n`` are <= x, by halving; 0 for a missing value."""
    steps = [1 << b for b in reversed(range(max(1, n.bit_length())))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, by: F.when(F.get(edges, at + by - 1) <= x, at + by).otherwise(at))


def edges_passed(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are <= x: a balanced tree of comparisons (stays in generated code), an array search for many edges."""
    if len(edges) > TREE_EDGES:
        return passed_in(x, number_array(edges), len(edges))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= F.lit(edges[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(edges))
