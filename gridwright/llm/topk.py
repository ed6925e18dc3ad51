"""Exact top-k search by distributed histogram selection.

Vectors become whole numbers, floor(64 * x). Queries and candidates are dealt to groups and packed in the fewest bytes their
numbers need; every group of queries meets every group of candidates once, under a key of its own, and scores are matrix
products of a block of the one and a block of the other. Rounds of histograms then locate each query's k-th best score: a pair
of groups counts its scores into ``BINS`` bins of the query's present range, the counts are summed over all pairs, and the bin
that holds the k-th best becomes the next range, until a bin is one score. The first range begins at the greatest of the
groups' own k-th best scores, as nothing below can be among the best. At last each pair of groups gives the rows above the
k-th score and, at the score itself, as many as can count by the smaller id; a rank over those few is the result.

Only packed groups travel, a few copies of each, by a shuffle: nothing that grows with the vectors is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.storage import stored

QUERY_BLOCK, BLOCK, BINS = 1024, 4096, 1024
#: A group of queries or of candidates has so many bytes at most, and a pair of groups so many scores, unless copies of groups
#: would come to more than ``COPIES`` times the vectors.
GROUP_BYTES, GROUP_SCORES, COPIES = 1 << 25, 1 << 25, 4
_PACK = 1 << 22
_PIECE = "g int, side int, n int, ids binary, data binary"
_QUERIES, _STATE, _CANDIDATES = range(3)
_NONE = -(1 << 63)


def whole(column: str, scale: int = 64) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(column: str) -> Column:
    """Not null, not empty, and all components finite numbers."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & fine


def _grid(q_rows: int, c_rows: int, q_bytes: int, c_bytes: int) -> tuple[int, int]:
    """Numbers of groups of queries and of candidates."""
    pairs = max(1, min(q_rows * c_rows / GROUP_SCORES, (COPIES * (q_bytes + c_bytes) / 2) ** 2 / (q_bytes * c_bytes)))
    nq = min(q_rows, max(1, ceil(q_bytes / GROUP_BYTES), round(sqrt(pairs * q_bytes / c_bytes))))
    return nq, min(c_rows, max(ceil(c_bytes / GROUP_BYTES), ceil(pairs / nq)))


def _kind(least: int, most: int) -> str:
    """The smallest whole numbers that hold both."""
    return next(kind for kind in ("i1", "i2", "i4", "i8") if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max)


def _range(column: str) -> list[Column]:
    return [F.count("*").alias("n"), F.coalesce(F.min(F.array_min(column)), F.lit(0)).alias("least"), F.coalesce(F.max(F.array_max(column)), F.lit(0)).alias("most")]


def _bytes(found, dims: int) -> int:
    return found["n"] * (dims * np.dtype(_kind(found["least"], found["most"])).itemsize + 8)


def _packed(rows: DataFrame, side: int, dims: int, group: Column) -> DataFrame:
    """Pieces of groups, of at most ``BLOCK`` rows: ids and vectors as bytes of the smallest whole numbers that hold a piece."""
    size = BLOCK

    def cut(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])
        g, ids = part("g"), part("id")
        v = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in batches]).reshape(len(ids), dims)
        order = np.argsort(g, kind="stable")
        ends = np.flatnonzero(np.diff(g[order], append=-1)) + 1
        at = [slice(i, min(i + size, e)) for b, e in zip([0, *ends[:-1]], ends, strict=True) for i in range(b, e, size)]
        pieces = [v[order[x]] for x in at]
        data = [x.astype(_kind(int(x.min(initial=0)), int(x.max(initial=0)))).tobytes() for x in pieces]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([g[order[x.start]] for x in at], pa.int32()), pa.array([side] * len(at), pa.int32()), pa.array([len(x) for x in pieces], pa.int32()),
                pa.array([ids[order[x]].tobytes() for x in at], pa.binary()), pa.array(data, pa.binary()),
            ],
            ["g", "side", "n", "ids", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) * dims >= _PACK:
                yield from cut(held)
                held = []
        if held:
            yield from cut(held)

    return rows.select(group.cast("int").alias("g"), "id", "v").mapInArrow(run, _PIECE)


def _met(batches: Iterator[pa.RecordBatch], dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, ids and state of the queries, ids and vectors of the candidates of a pair of groups."""
    length = {_QUERIES: dims, _STATE: 2, _CANDIDATES: dims}
    found: dict[int, list] = {side: [(np.empty(0, np.int64), np.empty((0, length[side]), np.int8))] for side in length}
    for batch in batches:
        sides, ns, ids, data = (batch.column(c) for c in ("side", "n", "ids", "data"))
        for i in range(batch.num_rows):
            side, n, of, packed = sides[i].as_py(), ns[i].as_py(), ids[i].as_buffer(), data[i].as_buffer()
            found[side].append((np.frombuffer(of, np.int64), np.frombuffer(packed, f"i{packed.size // (n * length[side])}").reshape(n, length[side])))
    return [(np.concatenate([x[0] for x in f]), np.concatenate([x[1] for x in f])) for f in found.values()]


def _asked(met: list[tuple[np.ndarray, np.ndarray]]):
    """Ids, vectors, lows and widths of the queries that have a state."""
    (q_ids, q), (ids, state), _ = met
    order = np.argsort(ids)
    place = np.minimum(np.searchsorted(ids[order], q_ids), max(0, len(ids) - 1))
    has = ids[order][place] == q_ids if len(ids) else np.zeros(len(q_ids), bool)
    state = state[order][place[has]].astype(np.int64)
    return q_ids[has], q[has], state[:, 0], state[:, 1]


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All scores of two blocks; exact: in floating point while sums stay whole there, else in 64 bits."""
    most = 1
    for x in (q, c):
        most *= max(int(x.max(initial=0)), -int(x.min(initial=0)))
    for kind, bits in ((np.float32, 24), (np.float64, 53)):
        if most * q.shape[1] < 1 << bits:
            return q.astype(kind) @ c.astype(kind).T
    return q.astype(np.int64) @ c.astype(np.int64).T


def _blocks(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """Of a block of queries and each block of candidates: scores, the places where both have one id, the candidates' ids."""
    order = np.argsort(q_ids)
    for at in range(0, len(c_ids), size):
        ids = c_ids[at : at + size]
        row = order[np.minimum(np.searchsorted(q_ids, ids, sorter=order), len(q_ids) - 1)]
        own = np.flatnonzero(q_ids[row] == ids)
        yield _scores(q, c[at : at + size]), (row[own], own), ids


def _reached(s: np.ndarray, own: tuple[np.ndarray, np.ndarray], low: np.ndarray, above: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of what reaches each row's ``low``. Where ``low`` has no exact form in the scores' type, it is beyond
    all of them, and so is what it is rounded to."""
    bound = low.astype(s.dtype)[:, None]
    reached = s > bound if above else s >= bound
    reached[own] = False
    row, col = np.divmod(np.flatnonzero(reached), s.shape[1])
    return row, col, s[row, col].astype(np.int64)


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, or all."""
    return np.partition(rows, rows.shape[1] - k, axis=1)[:, rows.shape[1] - k :] if rows.shape[1] > k else rows


def _ranges(k: int, dims: int) -> Callable:
    """(query, the k-th best score or the least there is, the best score, how many there are up to k) of each pair of groups."""
    rows, size = QUERY_BLOCK, BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q_ids, q), _, (c_ids, c) = _met(batches, dims)
        for at in range(0, len(q_ids), rows):
            ids = q_ids[at : at + rows]
            best, n = np.empty((len(ids), 0), np.int64), np.zeros(len(ids), np.int64)
            for s, own, _ in _blocks(ids, q[at : at + rows], c_ids, c, size):
                if (n < k).any():
                    s[own] = _NONE
                    n = np.minimum(n + s.shape[1] - np.bincount(own[0], minlength=len(ids)), k)
                    best = _best(np.concatenate([best, _best(s, k).astype(np.int64)], axis=1), k)
                    continue
                row, _, score = _reached(s, own, best.min(axis=1), above=True)
                if len(row):
                    count = np.bincount(row, minlength=len(ids))
                    more = np.full((len(ids), count.max()), _NONE)
                    more[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = score
                    best = _best(np.concatenate([best, more], axis=1), k)
            some = np.flatnonzero(n)
            best = np.sort(best[some], axis=1)
            low, high = (best[np.arange(len(some)), best.shape[1] - x] for x in (n[some], 1)) if len(some) else (n[:0], n[:0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], low, high, n[some])], ["query_id", "low", "high", "n"])

    return run


def _histogram(dims: int) -> Callable:
    """(query, bin, count) of each pair of groups, for queries whose range is open."""
    rows, size, bins = QUERY_BLOCK, BLOCK, BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _met(batches, dims)
        q_ids, q, low, width = _asked(met)
        c_ids, c = met[_CANDIDATES]
        is_open = np.flatnonzero(width > 0)
        for at in range(0, len(is_open), rows):
            asked = is_open[at : at + rows]
            keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, own, _ in _blocks(q_ids[asked], q[asked], c_ids, c, size):
                row, _, score = _reached(s, own, low[asked])
                bin_ = np.minimum((score - low[asked][row]) // width[asked][row], bins)  # above the range: one bin
                key, n = np.unique(row * (bins + 1) + bin_, return_counts=True)
                keys.append(key)
                counts.append(n)
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, place, np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[asked][key // (bins + 1)]), pa.array(key % (bins + 1)), pa.array(n)], ["query_id", "bin", "n"])

    return run


def _pick(k: int, dims: int) -> Callable:
    """Rows that reach the k-th score: all above it, and at it the k smallest ids of a pair of groups."""
    rows, size = QUERY_BLOCK, BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _met(batches, dims)
        q_ids, q, low, _ = _asked(met)
        c_ids, c = met[_CANDIDATES]
        for at in range(0, len(q_ids), rows):
            asked = slice(at, at + rows)
            row, ids, score = (np.empty(0, np.int64) for _ in range(3))
            for s, own, of in _blocks(q_ids[asked], q[asked], c_ids, c, size):
                r, col, value = _reached(s, own, low[asked])
                row, ids, score = (np.concatenate(x) for x in ((row, r), (ids, of[col]), (score, value)))
                order = np.lexsort([ids, ~score, row])
                row = row[order]
                top = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                row, ids, score = row[top], ids[order][top], score[order][top]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[asked][row], ids, score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query, by score, then the smaller id; all, if
    there are fewer. ``vectors`` and ``queries``: (id, v), v a list of whole numbers.

    A candidate with the query's own id does not count; every other row does, also several of one id. Of queries that repeat an id,
    the one with the least vector counts. Null ids take no part, nor, where lengths differ, vectors of another length than the
    most frequent one among the candidates (the greatest of equally frequent ones). An empty side gives an empty table. Scores
    beyond 64 bits wrap around.
    """
    vectors = stored(vectors.where("id is not null").select("id", "v"), "vectors")
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    head = vectors.groupBy(F.size("v").alias("dims")).agg(*_range("v")).orderBy(F.desc("n"), F.desc("dims")).first()
    if head is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = head["dims"]
    vectors = vectors.where(F.size("v") == dims)
    queries = stored(queries.where(F.col("id").isNotNull() & (F.size("v") == dims)).groupBy("id").agg(F.min("v").alias("v")), "queries")
    asked = queries.agg(*_range("v")).first()
    if not asked["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    nq, nc = _grid(asked["n"], head["n"], _bytes(asked, dims), _bytes(head, dims))
    q_group = lambda of: F.pmod(F.xxhash64(of, F.lit("q")), F.lit(nq))
    q = stored(_packed(queries, _QUERIES, dims, q_group("id")), "groups")
    # a row's place in a written table is the same whenever it is read, and many rows of one id or vector spread over all groups
    c = stored(_packed(vectors, _CANDIDATES, dims, F.pmod(F.xxhash64("id", F.lit("c"), F.monotonically_increasing_id()), F.lit(nc))), "groups")

    def met(run: Callable, out: str, known: DataFrame | None = None) -> DataFrame:
        """Each pair of groups once. The copies of a group travel, not pairs of rows; a join could be planned as a broadcast, as the
        planner does not know how many copies there are."""
        left = q if known is None else q.unionAll(_packed(known, _STATE, 2, q_group("id")))
        copies = lambda pieces, n, key: pieces.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(key.alias("pair"), "side", "n", "ids", "data")
        pairs = copies(left, nc, F.col("g") * nc + F.col("o")).unionAll(copies(c, nq, F.col("o") * nc + F.col("g")))
        return pairs.repartition(nq * nc, "pair").groupBy("pair").applyInArrow(run, out)

    def ranges(low: str | Column, width: Column) -> DataFrame:
        return state.select(F.col("query_id").alias("id"), F.array(low, width).alias("v"))

    size = met(_ranges(k, dims), "query_id bigint, low bigint, high bigint, n bigint")
    state = size.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("n") >= k, F.col("low"))), F.min("low")).alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    state = stored(state.select("query_id", "low", "high", F.least(F.col("n"), F.lit(k)).alias("want")), "state")
    while True:
        open_ = state.where("low < high")
        if open_.isEmpty():
            break
        width = F.when(F.col("low") < F.col("high"), F.floor((F.col("high") - F.col("low")) / F.lit(BINS)) + 1).otherwise(0).cast("bigint")
        counts = met(_histogram(dims), "query_id bigint, bin bigint, n bigint", ranges("low", width)).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        total = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # BINS rows a query at most
        cum = counts.withColumn("upto", F.sum("n").over(total)).join(state.withColumn("width", width).hint("merge"), "query_id")
        found = cum.where("upto >= want").groupBy("query_id").agg(F.max_by(F.struct("bin", "low", "width"), "bin").alias("b"))
        moved = found.select("query_id", (F.col("b.low") + F.col("b.bin") * F.col("b.width")).alias("lo"), F.col("b.width").alias("w"))
        state = stored(
            state.join(moved.hint("merge"), "query_id", "left").select(
                "query_id", F.coalesce("lo", "low").alias("low"), F.coalesce(F.least(F.col("lo") + F.col("w") - 1, F.col("high")), F.col("high")).alias("high"), "want",
            ),
            "state",
        )
    best = met(_pick(k, dims), "query_id bigint, vec_id bigint, score bigint", ranges("low", F.lit(0).cast("bigint")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
