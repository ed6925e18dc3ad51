"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ by ``k = floor(RATE * n)`` edits. Cut into k + 1 pieces, any text within that
distance of it holds one piece unchanged (pigeonhole). Every text is searched for all pieces at every place: a piece
stands in the index by the hash of its first bytes, a text's hashes come from running sums. Each hit fixes where the item
would lie; Myers' bit-parallel algorithm then finds the least edit distance of the item to any part of that window.

Both sides are compared lower-cased (A-Z), each run of white space as one space. Items are searched in blocks of
``ITEM_BLOCK``, one pass over the documents each, so what a task holds does not grow with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.storage import stored
from gridwright.llm.textblocks import _SPACE, U, blocks, lowered, prefix_sums, span_hash

RATE = 0.05
ITEM_BLOCK = 20_000
ITEM_BLOCK_CHARS = 20_000_000
#: Items shorter than this are only looked for unchanged, as whole words.
LEAST_CHARS = 24
_TABLE = 20


_PLAIN = bytes(32 if _SPACE[i] else int(c) for i, c in enumerate(lowered(np.arange(256, dtype=np.uint8))))


def normal(text: str | None) -> str:
    """White space as single spaces, none at the ends, A-Z in lower case."""
    return " ".join(part for part in (text or "").encode().translate(_PLAIN).decode().split(" ") if part)


def budget(item: str) -> int:
    """Edits an item may have."""
    return int(RATE * len(item)) if len(item) >= LEAST_CHARS else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """(place, piece): ``budget + 1`` pieces of nearly equal length that cover the item."""
    n, k = len(item), budget(item) + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of ``pattern`` to a part of ``text``, and where the first such part ends.
    Myers' algorithm: one column of the distance matrix is two bit vectors, one step a character."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        match = masks.get(c, 0)
        x = match | down
        carry = ((match & up) + up) ^ up | match
        plus = down | ~(carry | up) & full
        minus = up & carry
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | ~(x | plus) & full
        down = plus & x
        if distance < best:
            best, end = distance, j + 1
    return best, end


class PieceIndex:
    """The pieces of a block of items, by the hash of their first bytes."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if t]
        by_length: dict[int, list[tuple[bytes, int, int]]] = defaultdict(list)
        found = [(p.encode(), place, at) for at, (_, t) in enumerate(self.items) for place, p in pieces(t)]
        # few different lengths: each piece is indexed by its longest prefix of a length in this list
        for piece, place, at in found:
            size = len(piece)
            for step in (8, 4, 1):
                if size >= step:
                    size = min(size // step * step, 64)
                    break
            by_length[size].append((piece, place, at))
        self.levels = []
        for size, group in sorted(by_length.items()):
            data = np.frombuffer(b"".join(p[:size] for p, _, _ in group), np.uint8)
            starts = np.arange(len(group)) * size
            hashes = span_hash(prefix_sums(data), starts, starts + size)
            order = np.argsort(hashes, kind="stable")
            filter_ = np.zeros(1 << _TABLE, bool)
            filter_[(hashes >> U(64 - _TABLE)).astype(np.int64)] = True
            self.levels.append((size, hashes[order], [group[i] for i in order], filter_))

    def hits(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(byte in ``data``, place in the item, item) of every piece found."""
        sums = prefix_sums(data)
        raw = data.tobytes()
        for size, hashes, group, filter_ in self.levels:
            if len(data) < size:
                continue
            starts = np.arange(len(data) - size + 1)
            h = span_hash(sums, starts, starts + size)
            at = np.flatnonzero(filter_[(h >> U(64 - _TABLE)).astype(np.int64)])
            if not len(at):
                continue
            left, right = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            for i in np.flatnonzero(right > left):
                begin = int(at[i])
                for j in range(left[i], right[i]):
                    piece, place, item = group[j]
                    if raw.startswith(piece, begin):
                        yield begin, place, item


def _squeezed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block in normal form (a leading or trailing space may stay), one NUL after each text."""
    low = lowered(data)
    space = _SPACE[low]
    low = np.where(space, np.uint8(32), low)
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    cuts = offs[1:-1]
    keep[cuts[cuts < len(low)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offs]
    n = len(offs) - 1
    out = np.zeros(int(at[-1]) + n, np.uint8)
    where = np.flatnonzero(keep)
    out[np.arange(len(where)) + np.searchsorted(offs, where, "right") - 1] = low[where]
    return out, at + np.arange(n + 1)


def _matches(index: PieceIndex, data: np.ndarray, offs: np.ndarray) -> list[dict[int, int]]:
    """Of each text: item and least distance, for the items within their budget."""
    text, at = _squeezed(data, offs)
    out: list[dict[int, int]] = [{} for _ in range(len(offs) - 1)]
    tried: set[tuple[int, int, int]] = set()
    hits = sorted(index.hits(text)) if len(text) else []
    if not hits:
        return out
    rows = np.searchsorted(at, [b for b, _, _ in hits], "right") - 1
    memory: dict[int, tuple[str, np.ndarray]] = {}
    for (begin, place, item), row in zip(hits, rows.tolist(), strict=True):
        name, pattern = index.items[item]
        k = budget(pattern)
        if out[row].get(name) == 0:
            continue
        if row not in memory:
            memory = {row: (text[at[row] : at[row + 1] - 1].tobytes().decode(), np.cumsum((text[at[row] : at[row + 1]] & 0xC0) != 0x80))}
        whole, points = memory[row]
        where = int(points[begin - at[row]]) - 1 - place  # where the item would begin, in characters
        if (row, item, where) in tried:
            continue
        tried.add((row, item, where))
        low, high = max(0, where - k), where + len(pattern) + k
        window = whole[low:high]
        if k == 0:
            edge = lambda c: c in ("", " ")
            good = window == pattern and (len(pattern) >= LEAST_CHARS or edge(whole[low - 1 : low] if low else "") and edge(whole[high : high + 1]))
            distance = 0 if good else 1
        else:
            distance = 0 if pattern in window else least_distance(pattern, window)[0]
        if distance <= k:
            out[row][name] = min(distance, out[row].get(name, distance))
    return out


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs' doc_id, k1, k2 and found (item_id, distance), one row for each row of (doc_id, text, k1, k2) that matches."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, -(-size[0] // ITEM_BLOCK), -(-(size[1] or 0) // ITEM_BLOCK_CHARS))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    passes = []
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().collect()
        block = [(r.item_id, normal(r.text)) for r in mine]

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(block)
            for batch in batches:
                for lo, hi, data, offs in blocks(batch.column("text")):
                    got = _matches(index, data, offs)
                    some = np.flatnonzero([bool(g) for g in got])
                    if len(some):
                        found = pa.array([[{"item_id": i, "distance": d} for i, d in sorted(got[s].items(), key=lambda x: (x[0] is None, x[0] or 0))] for s in some], kind)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo).take(pa.array(some)) for c in ("doc_id", "k1", "k2")), found], ["doc_id", "k1", "k2", "found"])

        passes.append(docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, found array<struct<item_id:bigint,distance:int>>"))
    return reduce(DataFrame.unionAll, passes)


def keyed(docs: DataFrame) -> DataFrame:
    """With two hashes of id and text, which name a row or its exact repeats."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", F.lit(1)))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (item_id, distance), item_ids for every row of (doc_id, text).

    A row is contaminated by an item if some part of its text is within ``floor(0.05 * characters)`` edits of the item.
    Items of fewer than 24 characters must occur unchanged as whole words; null and empty items match nothing; null and
    empty texts match nothing. Repeated rows and repeated items give repeated and equal results.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    hit = stored(matches(rows, items), "leaks")
    hit = hit.select("k1", "k2", F.explode("found").alias("f")).distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_set("f")).alias("items"))
    out = rows.drop("text").join(hit, ["k1", "k2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<item_id:bigint,distance:int>>")))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", F.col("items.item_id").alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = keyed(rows)
    bad = stored(matches(rows, items).select("k1", "k2").distinct(), "leaks")
    return rows.join(bad, ["k1", "k2"], "left_anti").select("row.*")
