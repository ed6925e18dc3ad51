"""Sums over pairs of columns: every task adds matrix products of its Arrow batches, Spark adds the tasks' sums.

One scan gives all pairs of up to ``TILE`` columns; more columns are done tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import as_number

TILE = 1024


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of doubles; NaN where a value is missing."""
    return np.column_stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in range(batch.num_columns)])


def means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Mean of each column's values, 0 without any; one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = s = 0
        for batch in batches:
            x = _numbers(batch)
            n, s = n + (~np.isnan(x)).sum(axis=0), s + np.nansum(x, axis=0)
        if np.ndim(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(s)], ["i", "n", "s"])

    rows = df.select(*[as_number(df, c).alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(run, "i int, n bigint, s double").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("n")))
    found = {r[0]: r[1] for r in rows.collect()}  # one row a column
    return [found.get(i) if found.get(i) is not None and np.isfinite(found[i]) else 0.0 for i in range(len(cols))]


def _products(left: int, shift: np.ndarray, square: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _numbers(batch) - shift
            m = (~np.isnan(x)).astype(float)
            z = np.where(m > 0, x, 0.0)
            (za, zb), (ma, mb) = ((z, z), (m, m)) if square else ((z[:, :left], z[:, left:]), (m[:, :left], m[:, left:]))
            got = np.stack([ma.T @ mb, za.T @ mb, ma.T @ zb, za.T @ zb, (za * za).T @ mb, ma.T @ (zb * zb)])
            total = got if total is None else total + got
        if total is not None:
            i, j = np.triu_indices(total.shape[1]) if square else (a.ravel() for a in np.indices(total.shape[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]], ["a", "b", *_SUMS])

    return run


_SUMS = ("n", "sa", "sb", "sab", "saa", "sbb")


def pair_sums(df: DataFrame, cols: Sequence[str], shift: Sequence[float] | None = None, tile: int = TILE) -> DataFrame:
    """(a, b, n, sa, sb, sab, saa, sbb) for numbers a <= b of ``cols``: over the rows that have both values, their number and the sums
    of a, b, a b, a a and b b, each value less its column's ``shift``."""
    shift = list(shift or [0.0] * len(cols))
    tiles = [range(at, min(at + tile, len(cols))) for at in range(0, len(cols), tile)]
    parts = []
    for i, left in enumerate(tiles):
        for right in tiles[i:]:
            square = left == right
            here = list(left) if square else [*left, *right]
            rows = df.select(*[as_number(df, cols[c]).alias(f"x{c}") for c in here])
            got = rows.mapInArrow(_products(len(left), np.array([shift[c] for c in here]), square), ", ".join(["a int", "b int", *[f"{s} double" for s in _SUMS]]))
            sums = got.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])
            parts.append(sums.select((F.col("a") + left.start).alias("a"), (F.col("b") + right.start).alias("b"), *_SUMS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
