"""Repeated runs of lines, by winnowing over line hashes.

A line ends at a line break or, so that passages set inside a paragraph are found, at a single full stop, question or
exclamation mark before white space. Lines are compared lower-cased (A-Z) without white space at the ends; lines without text are part
of the line before them.

Fingerprints are grams of ``GRAM`` lines; of every ``WINDOW`` successive grams the least by (fewer words last, hash) is
selected, so any run of ``GRAM + WINDOW - 1`` lines that two places share has a selected gram in common. A line of
``MIN_WORDS`` words or more is a fingerprint by itself. Each fingerprint is joined with its first place in the corpus (by
doc_id, nulls last, then position); the match is extended both ways as far as the lines agree, and the later run goes if it
has ``MIN_WORDS`` words. Only places join with the first one: no pairs within a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.storage import stored
from gridwright.llm.textblocks import _SPACE, U, blocks, lowered, prefix_sums, span_hash, words

GRAM, WINDOW, MIN_WORDS = 2, 2, 20

_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F]] = True


def lines(data: np.ndarray, offs: np.ndarray):
    """First byte, row, hash and words of each line. The lines of a text follow each other without gaps; its first line
    begins at its first byte. A text without words has no lines."""
    low = lowered(data)
    starts, ends, rows = words(low, offs)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), none
    # a word begins a line if a line break or the end of a sentence (one mark, not several) comes before it
    breaks = np.concatenate([[0], np.cumsum(low == 10)])
    end = ends[:-1] - 1
    sentence = _STOP[low[end]] & ~(_STOP[low[np.maximum(end - 1, 0)]] & (end > starts[:-1]))
    first = np.ones(len(starts), bool)
    same = rows[1:] == rows[:-1]
    first[1:] = ~same | (breaks[starts[1:]] > breaks[ends[:-1]]) | sentence
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(starts)) - 1
    hashes = span_hash(prefix_sums(low), starts[at], ends[last])
    begin = starts[at].copy()
    head = np.ones(len(at), bool)
    head[1:] = rows[at[1:]] != rows[at[:-1]]
    begin[head] = offs[rows[at[head]]]
    return begin, rows[at], hashes, last - at + 1


def selected(hashes: np.ndarray, rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line at which each fingerprint begins, and its number of lines (GRAM, or 1 for a long line)."""
    n = len(hashes)
    long_ = np.flatnonzero(count >= MIN_WORDS)
    at = np.flatnonzero(rows[GRAM - 1 :] == rows[: n - GRAM + 1]) if n >= GRAM else np.zeros(0, np.int64)
    gram, size = np.zeros(len(at), U), np.zeros(len(at), np.int64)
    for j in range(GRAM):
        gram = gram * U(0xA24BAED4963EE407) + hashes[at + j]
        size += count[at + j]
    rank = ((U(255) - np.minimum(size, 255).astype(U)) << U(56)) | (gram >> U(8))
    keep = np.zeros(len(at), bool)
    if len(at):
        row = rows[at]
        alone = np.bincount(row)[row] < WINDOW  # a text of fewer grams than a window: its least
        order = np.lexsort([rank, row])
        head = np.flatnonzero(np.diff(row[order], prepend=-1))
        keep[order[head][alone[order[head]]]] = True
        if len(at) >= WINDOW:
            whole = np.flatnonzero(row[WINDOW - 1 :] == row[: len(at) - WINDOW + 1])
            best = whole.copy()
            for j in range(1, WINDOW):
                best = np.where(rank[whole + j] < rank[best], whole + j, best)
            keep[best] = True
    places = np.concatenate([at[keep], long_])
    return places, np.concatenate([np.full(int(keep.sum()), GRAM), np.ones(len(long_), np.int64)])


def _lists(rows: np.ndarray, n: int, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in blocks(batch.column("text")):
            n = hi - lo
            begin, rows, hashes, count = lines(data, offs)
            places, sizes = selected(hashes, rows, count)
            order = np.argsort(places, kind="stable")
            places, sizes = places[order], sizes[order]
            head = np.searchsorted(rows, np.arange(n))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            until = np.append(begin[1:], 0)
            tail = np.flatnonzero(np.diff(rows, append=-1))
            until[tail] = offs[rows[tail] + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, n), batch.column("k").slice(lo, n),
                    _lists(rows, n, hashes.view(np.int64), pa.int64()), _lists(rows, n, np.minimum(count, 32767), pa.int16()),
                    _lists(rows, n, points[until] - points[begin], pa.int32()),
                    _lists(rows[places], n, places - head[rows[places]], pa.int32()), _lists(rows[places], n, sizes, pa.int8()),
                ],
                ["doc_id", "k", "hashes", "words", "lengths", "places", "sizes"],
            )


def repeated_runs(hashes: np.ndarray, first: np.ndarray, shift: int, places: np.ndarray, own: bool) -> list[tuple[int, int]]:
    """Runs [a, b) of ``hashes`` that agree with ``first`` moved by ``shift`` and hold one of ``places``."""
    low, high = max(0, shift), min(len(hashes), len(first) + shift)
    if own and shift <= 0 or high <= low:
        return []
    same = np.zeros(high - low + 2, np.int8)
    same[1:-1] = hashes[low:high] == first[low - shift : high - shift]
    edge = np.diff(same)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.searchsorted(starts, places - low, "right") - 1
    hit = np.unique(at[(at >= 0) & (places - low < ends[at])]) if len(starts) else []
    return [(int(starts[i]) + low, int(ends[i]) + low) for i in hit]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of documents: the runs that go from the later one, in code points."""
    for batch in batches:
        doc, key, own = (batch.column(c).to_pylist() for c in ("doc_id", "k", "own"))
        array = lambda c, i: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
        out = []
        for i in range(batch.num_rows):
            count, ends = np.cumsum(np.append(0, array("words", i).astype(np.int64))), np.cumsum(np.append(0, array("lengths", i).astype(np.int64)))
            hashes, first, found = array("hashes", i), array("first", i), set()
            places = np.array([(x["shift"], x["at"]) for x in batch.column("at")[i].as_py()])
            places = places[np.lexsort(places.T[::-1])]
            for part in np.split(places, np.flatnonzero(np.diff(places[:, 0])) + 1):
                found.update(repeated_runs(hashes, first, int(part[0, 0]), part[:, 1], own[i]))
            spans = [{"s": int(ends[a]), "e": int(ends[b])} for a, b in sorted(found) if count[b] - count[a] >= MIN_WORDS]
            if spans:
                out.append((doc[i], key[i], spans))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "k", "spans"])


_MERGE = """aggregate(array_sort(spans), cast(array() as array<struct<s:int,e:int>>), (acc, x) ->
  if(size(acc) > 0 and x.s <= element_at(acc, -1).e,
     concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e)))),
     concat(acc, array(x))))"""
_CUT = """array_join(transform(sequence(0, size(spans)), i -> substring(text, if(i = 0, 0, spans[i - 1].e) + 1,
  if(i = size(spans), length(text), spans[i].s) - if(i = 0, 0, spans[i - 1].e))), '')"""


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, k, spans): the code points [s, e) that later repeats cover, for each text that has some. k: 64-bit hash of the
    text, which names the texts of one id (null ids share one)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    table = stored(
        rows.mapInArrow(_lines, "doc_id bigint, k bigint, hashes array<bigint>, words array<smallint>, lengths array<int>, places array<int>, sizes array<tinyint>"),
        "lines",
    )
    marks = table.select("doc_id", "k", "hashes", "words", F.explode(F.arrays_zip("places", "sizes")).alias("m"))
    beside = lambda i: F.expr(f"shiftright(get(hashes, {i}), 33)").cast("int")
    marks = marks.select(
        "doc_id", "k", F.col("m.places").alias("at"),
        F.when(F.col("m.sizes") == 1, F.xxhash64(F.expr("hashes[m.places]"), F.lit(1))).otherwise(F.xxhash64(*[F.expr(f"hashes[m.places + {j}]") for j in range(GRAM)])).alias("h"),
        F.expr(f"aggregate(slice(words, m.places + 1, m.sizes), 0, (a, x) -> a + x) >= {MIN_WORDS}").alias("enough"),
        beside("m.places - 1").alias("prev"), beside("m.places + m.sizes").alias("next"),
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k", "at", "prev", "next")
    heads = marks.groupBy("h").agg(F.min(order).alias("f"), F.count("*").alias("c")).where("c > 1").select("h", "f")
    # a short match that grows on neither side is dropped at once: it has not enough words
    pairs = marks.join(heads.hint("merge"), "h").where("enough or prev = f.prev or next = f.next")
    pairs = pairs.select("doc_id", "k", "at", F.col("f.doc_id").alias("d0"), F.col("f.k").alias("k0"), (F.col("at") - F.col("f.at")).alias("shift"))
    own = F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("k") == F.col("k0"))
    pairs = pairs.withColumn("own", own).where("not own or shift > 0")
    # a list is as long as the later document has fingerprints, at most
    pairs = stored(pairs.groupBy("doc_id", "k", "d0", "k0", "own").agg(F.collect_set(F.struct("shift", "at")).alias("at")), "matches")
    need = pairs.select("doc_id", "k").unionAll(pairs.select(F.col("d0").alias("doc_id"), F.col("k0").alias("k"))).distinct()
    arrays = table.select("doc_id", "k", "hashes", "words", "lengths").alias("t").join(need.hint("merge").alias("n"), F.expr("t.doc_id <=> n.doc_id and t.k = n.k"), "left_semi").dropDuplicates(["doc_id", "k"])
    arrays = stored(arrays, "arrays")
    first = arrays.select(F.col("doc_id").alias("d1"), F.col("k").alias("k1"), F.col("hashes").alias("first"))
    both = pairs.join(first.hint("merge"), F.expr("d0 <=> d1 and k0 = k1")).drop("d0", "k0", "d1", "k1")
    later = arrays.select(F.col("doc_id").alias("d1"), F.col("k").alias("k1"), "hashes", "words", "lengths")
    both = both.join(later.hint("merge"), F.expr("doc_id <=> d1 and k = k1")).drop("d1", "k1")
    runs = both.mapInArrow(_extend, "doc_id bigint, k bigint, spans array<struct<s:int,e:int>>")
    spans = runs.groupBy("doc_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return stored(spans.select("doc_id", "k", F.expr(_MERGE).alias("spans")), "spans")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` without the runs that repeat earlier ones, and two columns
    more: ``_removed`` (array of [s, e) in code points of the text as it was) and ``_emptied`` (nothing but white space is
    left of a text that lost a run).

    A null text stays null, an empty one empty. Repeated rows of one id and text are one document and are treated alike;
    rows of one id with different texts are different documents. An empty table gives an empty table.
    """
    names = docs.columns
    spans = repeated_spans(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("h"))
    spans = spans.select(F.col("doc_id").alias("d0"), F.col("k").alias("h0"), "spans")
    joined = rows.join(spans.hint("merge"), F.expr("d <=> d0 and h = h0"), "left")
    joined = joined.withColumn("cut", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(_CUT)))
    kept = [F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    emptied = F.col("spans").isNotNull() & ~F.col("cut").rlike("[^ \\t-\\r]")
    empty = F.array().cast("array<struct<s:int,e:int>>")
    return joined.select(*kept, F.coalesce("spans", empty).alias("_removed"), emptied.alias("_emptied"))
