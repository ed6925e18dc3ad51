"""Language-model scores by a weighted backoff automaton.

Words, pairs and triples are counted over all training texts, and every one that occurs ``LEAST`` times becomes an arc, at
any size of the corpus: the counts are tables in Spark, dealt by a hash, that grow with the corpus.

States are histories of one or two words. An arc carries the discounted log-probability of its word and leads to the
longest history that is a state; the failure arc of a state carries its backoff weight and leads to the history without
its first word. The root gives every word ``(c + 1) / (N + V + 1)``.

The automaton's score of a text is a sum over the words, pairs and triples that stand in it, each with a weight of its
own: a word that of the root and of its failure arc; a pair what its arc gives beyond the failure and the root, and its
own failure arc; a triple what its arc gives beyond the failure and the pair's arc. An n-gram without an arc weighs
nothing. So texts are scored by meeting the tables of weights; no state is followed. Frequent words and n-grams are
held in memory only to spare what travels. Batches of texts ask the buckets of a hash for the rest, in one packed array a
bucket, and each bucket answers with one sum a text; a bitmap a bucket (of bounded size, exact or not) leaves out most
n-grams that occur once.
"""

from __future__ import annotations

import gc
import hashlib
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.storage import discard, stored
from gridwright.llm.textblocks import U, blocks, held_out_ids, lowered, mix, prefix_sums, span_hash, text_hash, words

#: Occurrences from which on an n-gram has an arc.
LEAST = 2
#: Least share of all tokens of an n-gram, and of a word, whose weight is held in memory; scores do not depend on it.
SHARE, WORD_SHARE = 1e-6, 1e-7
#: Tokens for each bucket of n-grams; bits of a bucket's bitmap, and of all bitmaps of an order, at most.
BUCKET, BITS, ALL_BITS = 1 << 20, 1 << 20, 1 << 29
#: Tokens for each bucket of weights that texts ask; a task holds the weights of one.
ASKED = 1 << 22
#: All texts are scored in rounds, a share of them in each, so that less of what they ask lies on disk at once.
ROUNDS = 2
DISCOUNT = 0.75
END, BEGIN = text_hash(" end of text "), text_hash(" begin of text ")
_BITS = 20
_HELD, _HELD_GRAMS = 2_000_000, 1_500_000  # counts a task gathers before it passes them on


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: per text a begin mark, the words, the end mark."""
    low = lowered(data)
    starts, ends, rows = words(low, offs)
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    row = np.repeat(np.arange(n), count + 2)
    first = np.cumsum(count + 2) - (count + 2)
    out = np.zeros(len(row), U)
    inner = np.ones(len(row), bool)
    inner[first] = inner[first + count + 1] = False
    out[inner] = span_hash(prefix_sums(low), starts, ends)
    out[first], out[first + count + 1] = U(BEGIN), U(END)
    return out, row


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Places:
    """``_lookup`` by the leading bits of the keys, for many keys of a hash: few steps through the table."""

    def __init__(self, table: np.ndarray):
        bits = min(24, max(1, len(table).bit_length()))
        self.shift = U(64 - bits)
        self.starts = np.searchsorted(table, np.arange(1 << bits, dtype=U) << self.shift)
        self.table = np.append(table, U(0xFFFFFFFFFFFFFFFF))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.starts[(keys >> self.shift).astype(np.int64)]
        got = self.table[at]
        out = np.where(got == keys, at, -1)
        left = np.flatnonzero(got < keys)
        at, keys = at[left], keys[left]
        while len(left):
            at += 1
            got = self.table[at]
            hit, more = got == keys, got < keys
            out[left[hit]] = at[hit]
            left, at, keys = left[more], at[more], keys[more]
        out[out == len(self.table) - 1] = -1
        return out


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), counts
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], order[head], np.add.reduceat(counts[order], head, dtype=counts.dtype)


def _counted(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of all blocks of a task, summed before they are passed on."""

    def summed(parts):
        keys, _, counts = _grouped(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return keys, counts

    def batch_of(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["k", "n"])

    parts, held = [], 0
    for batch in batches:
        for _, _, data, offs in blocks(batch.column("text")):
            parts.append(np.unique(keys_of(data, offs), return_counts=True))
            held += len(parts[-1][0])
            if held > _HELD:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held > _HELD // 2:
                    yield batch_of(*parts[0])
                    parts, held = [], 0
    if parts:
        yield batch_of(*summed(parts))


def _counts(texts: DataFrame, keys_of) -> DataFrame:
    return texts.mapInArrow(lambda it: _counted(it, keys_of), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys with ``least`` occurrences, sorted, and their counts; bounded by one over the share that ``least`` stands for."""
    got = counts.where(F.col("n") >= least).toPandas()
    keys, n = got["k"].to_numpy(np.int64).view(U), got["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


@dataclass(frozen=True)
class Automaton:
    """The plain form with states and failure arcs, all in memory, for small tables; ``language_scores`` does without.

    States 0 (root), 1.. (one word), then two words. Arrays are sorted by key.
    """

    total: int  # training tokens
    types: int
    held: np.ndarray  # hashes of the words held in memory
    root: np.ndarray  # their log-probability at the root
    names: np.ndarray  # hashes of the words that occur in n-grams: their place is their number
    word_state: np.ndarray  # state of each of these words, 0 if none
    pair_keys: np.ndarray  # histories of two words that are states
    pair_first: int  # state of the first of them
    arc_keys: np.ndarray  # state << 20 | word
    arc_logs: np.ndarray
    fail_state: np.ndarray
    fail_log: np.ndarray


def _arc_states(keys: np.ndarray, counts: np.ndarray, history: np.ndarray, history_counts: np.ndarray, lower: np.ndarray):
    """Log-probabilities of the arcs (sorted by history) and the backoff weight of each history that has arcs."""
    p = (counts - DISCOUNT) / history_counts
    some, begin = np.unique(history, return_index=True)
    mass = 1 - np.add.reduceat(p, begin) if len(p) else np.zeros(0)
    rest = 1 - np.add.reduceat(10.0**lower, begin) if len(p) else np.zeros(0)
    return np.log10(p), some, np.log10(np.maximum(mass, 1e-12) / np.maximum(rest, 1e-12))


def fit_automaton(texts: DataFrame) -> tuple[Automaton, DataFrame]:
    """The automaton of a small table's column ``text`` and the table (k, n) of all word counts. Null texts count as empty; an
    empty table gives the root alone."""
    texts = texts.select("text")

    def word_keys(data, offs):
        token, _ = _tokens(data, offs)
        return token

    counts = stored(_counts(texts, word_keys), "words")
    begin = np.int64(np.array(BEGIN, U).view(np.int64))
    texts_n = counts.where(F.col("k") == F.lit(int(begin))).agg(F.sum("n")).first()[0] or 0
    counts = counts.where(F.col("k") != F.lit(int(begin)))
    total, types = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    base = math.log10(total + types + 1)
    held, held_n = _frequent(counts, max(2, math.ceil(WORD_SHARE * total)))
    root = np.log10(held_n + 1.0) - base
    least = max(2, math.ceil(SHARE * total))
    often = held_n >= least
    names, name_n = held[often], held_n[often]
    if total:
        place = int(np.searchsorted(names, U(BEGIN)))  # the begin mark is a history only
        names, name_n = np.insert(names, place, U(BEGIN)), np.insert(name_n, place, texts_n)

    def pair_of(data, offs):
        token, row = _tokens(data, offs)
        name = _lookup(names, token)
        ok = (name[:-1] >= 0) & (name[1:] >= 0) & (row[1:] == row[:-1])
        return name, ok, (name[:-1].astype(U) << U(_BITS)) | np.maximum(name[1:], 0).astype(U)

    def pair_keys(data, offs):
        _, ok, pair = pair_of(data, offs)
        return pair[ok]

    low = U((1 << _BITS) - 1)
    pairs, pair_n = _frequent(_counts(texts, pair_keys), least)
    names_log = root[np.maximum(_lookup(held, names), 0)]
    first, second = (pairs >> U(_BITS)).astype(np.int64), (pairs & low).astype(np.int64)
    pair_log, heads, head_fail = _arc_states(pairs, pair_n, first, name_n[first], names_log[second])

    def triple_keys(data, offs):
        name, ok, pair = pair_of(data, offs)
        known = ok & (_lookup(pairs, pair) >= 0)
        both = known[:-1] & known[1:]
        return (pair[:-1][both] << U(_BITS)) | name[2:][both].astype(U)

    triples, triple_n = _frequent(_counts(texts, triple_keys), least)
    history = _lookup(pairs, triples >> U(_BITS))
    suffix = _lookup(pairs, triples & U((1 << 2 * _BITS) - 1))
    triple_log, tails, tail_fail = _arc_states(triples, triple_n, history, pair_n[history], pair_log[suffix])

    word_state = np.zeros(len(names), np.int64)
    word_state[heads] = np.arange(1, len(heads) + 1)
    pair_first = len(heads) + 1
    pair_state = np.full(len(pairs), -1)
    pair_state[tails] = np.arange(pair_first, pair_first + len(tails))
    keys = np.concatenate([(word_state[first].astype(U) << U(_BITS)) | second.astype(U), (pair_state[history].astype(U) << U(_BITS)) | (triples & low)])
    logs = np.concatenate([pair_log, triple_log])
    order = np.argsort(keys)
    return Automaton(
        total, types, held, root, names, word_state, pairs[tails], pair_first, keys[order], logs[order],
        np.concatenate([np.zeros(pair_first, np.int64), word_state[second[tails]]]), np.concatenate([[0.0], head_fail, tail_fail]),
    ), counts


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * U(0xA24BAED4963EE407) + b)


def _grams(token: np.ndarray, row: np.ndarray, orders: tuple[int, ...] = (2, 3)):
    """Per order of the n-grams of a block: key, first part, second part, row. A triple's parts are its pairs."""
    pair = _joined(token[:-1], token[1:])
    same = row[1:] == row[:-1]
    for order in orders:
        if order == 2:
            yield pair[same], token[:-1][same], token[1:][same], row[1:][same]
        else:
            both = same[1:] & same[:-1]
            first, second = pair[:-1][both], pair[1:][both]
            yield _joined(first, second), first, second, row[2:][both]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) % U(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Bitmaps:
    """May a key be one of a table's? Never a wrong no."""

    bits: int  # a bucket
    table: np.ndarray  # bytes by bucket

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & U(self.bits - 1)
        return (self.table[_bucket(keys, len(self.table)), (slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 > 0


def _bitmaps(table: DataFrame, buckets: int) -> Bitmaps:
    """Of the column k of a table whose files hold few buckets each."""
    bits = min(BITS, 1 << max(6, int(math.log2(ALL_BITS / buckets))))

    def run(batches):
        held = {}
        for batch in batches:
            keys = batch.column("k").to_numpy().view(U)
            where = _bucket(keys, buckets)
            for b in np.unique(where).tolist():
                bit = held.setdefault(b, np.zeros(bits, bool))
                bit[(keys[where == b] & U(bits - 1)).astype(np.int64)] = True
                if len(held) > 64:
                    yield from out(held)
                    held = {}
        yield from out(held)

    def out(held):
        for b, bit in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bit, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    found = np.zeros((buckets, bits // 8), np.uint8)
    for r in table.select("k").mapInArrow(run, "bucket int, bits binary").toLocalIterator():
        found[r.bucket] |= np.frombuffer(r.bits, np.uint8)
    return Bitmaps(bits, found)


def _dealt(keys: np.ndarray, buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, columns of its keys) for each bucket that has some; the order within it stays."""
    if not len(keys):
        return
    where = _bucket(keys, buckets).astype(np.min_scalar_type(buckets))  # short numbers are sorted by digits
    order = np.argsort(where, kind="stable")
    some, begin = np.unique(where[order], return_index=True)
    ends = np.append(begin[1:], len(order))
    columns = [c[order] for c in columns]
    for b, lo, hi in zip(some.tolist(), begin.tolist(), ends.tolist(), strict=True):
        yield b, [c[lo:hi] for c in columns]


def _packed(rows: list[tuple[int, list[np.ndarray]]], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([b for b, _ in rows], pa.int32())]
    columns += [pa.array([np.ascontiguousarray(x[i]).tobytes() for _, x in rows], pa.binary()) for i in range(len(names))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", *names])


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``stored``; the shuffle files of steps before go, which else stay until the driver happens to collect its garbage.
    The driver's Python tells the JVM what it has dropped only after the first round."""
    df = stored(df, name)
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return df


def _repeated(texts: DataFrame, order: int, buckets: int, parts) -> DataFrame:
    """(k, a, b, n): the n-grams that occur ``LEAST`` times. ``parts``: bitmaps their parts must pass, or None."""

    def count(batches):
        def summed(held):
            k, a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            some, first, n = _grouped(k, n)
            return some, a[first], b[first], n

        def rows(k, a, b, n):
            return _packed(list(_dealt(k, buckets, [a, b, n])), ["a", "b", "n"])

        held, size = [], 0
        for batch in batches:
            for _, _, data, offs in blocks(batch.column("text")):
                k, a, b, _ = next(_grams(*_tokens(data, offs), (order,)))
                if parts is not None:
                    ok = parts.value.has(a) & parts.value.has(b)
                    k, a, b = k[ok], a[ok], b[ok]
                held.append((k, a, b, np.ones(len(k), np.uint32)))
                size += len(k)
                if size > _HELD_GRAMS:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > _HELD_GRAMS // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if size:
            yield rows(*summed(held))

    def total(table: pa.Table) -> pa.Table:
        a, b, n = (_column(table, c, kind) for c, kind in (("a", U), ("b", U), ("n", np.uint32)))
        some, first, n = _grouped(_joined(a, b), n.astype(np.int64))
        often = n >= LEAST
        return pa.table({"k": some[often].view(np.int64), "a": a[first[often]].view(np.int64), "b": b[first[often]].view(np.int64), "n": n[often]})

    dealt = texts.mapInArrow(count, "bucket int, a binary, b binary, n binary")
    return _kept(dealt.groupBy("bucket").applyInArrow(total, "k bigint, a bigint, b bigint, n bigint"), f"grams{order}")


def _rest(up: str, down: str):
    """The logarithm of a failure arc: mass left by the arcs over mass left below."""
    return F.log10(F.greatest(1 - F.sum(up), F.lit(1e-12)) / F.greatest(1 - F.sum(down), F.lit(1e-12)))


def _hot(table: DataFrame, least: int, *names: str) -> list[np.ndarray]:
    got = table.where(F.col("n") >= least).select("k", *names).toArrow()
    k, *rest = (got.column(c).to_numpy() for c in ("k", *names))
    order = np.argsort(k.view(U))
    return [k.view(U)[order], *(x[order] for x in rest)]


@dataclass(frozen=True)
class Weights:
    """What a task holds of the weights: all frequent ones, and bitmaps of the others."""

    asked: int  # buckets of the other weights, which texts ask
    words: list  # keys, logarithms at the root, failure arcs
    hot: list  # by order: keys, weights
    maps: list  # by order


def fit_weights(texts: DataFrame):
    """The weights: (total, types, what tasks hold, words (k, n, fail), n-grams (k, e) that are not held)."""
    texts = texts.select("text")
    every = _kept(_counts(texts, lambda data, offs: _tokens(data, offs)[0]), "words")
    begin = F.lit(int(np.array(BEGIN, U).view(np.int64)))
    total, types = every.where(F.col("k") != begin).agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    spark, bottom, buckets = texts.sparkSession, float(total + types + 1), 1 + total // BUCKET
    pairs = _repeated(texts, 2, buckets, None)
    maps = [_bitmaps(pairs, buckets)]
    triples = _repeated(texts, 3, buckets, spark.sparkContext.broadcast(maps[0]))
    maps.append(_bitmaps(triples, buckets))
    # pairs: probability of the arc and of its word at the root; the side that has a key once is hashed, so nothing is sorted
    once = lambda df: df.hint("shuffle_hash")
    heads = every.select(F.col("k").alias("a"), F.col("n").alias("c"))
    tails = every.select(F.col("k").alias("b"), ((F.col("n") + 1) / F.lit(bottom)).alias("low"))
    found = pairs
    pairs = found.join(once(heads), "a").join(once(tails), "b").select("k", "a", "n", ((F.col("n") - DISCOUNT) / F.col("c")).alias("p"), "low")
    pairs = _kept(pairs, "pairs")
    discard(found)
    fail1 = _kept(pairs.groupBy("a").agg(_rest("p", "low").alias("fail")), "fail1")
    words = _kept(every.join(once(fail1.select(F.col("a").alias("k"), "fail")), "k", "left").select("k", "n", F.coalesce("fail", F.lit(0.0)).alias("fail")), "fails")
    discard(every)
    heads = pairs.select(F.col("k").alias("a"), F.col("n").alias("c"))
    tails = pairs.select(F.col("k").alias("b"), F.col("p").alias("low"))
    found = triples
    triples = found.join(once(heads), "a").join(once(tails), "b").select("k", "a", "n", ((F.col("n") - DISCOUNT) / F.col("c")).alias("p"), "low")
    triples = _kept(triples, "triples")
    discard(found)
    fail2 = _kept(triples.groupBy("a").agg(_rest("p", "low").alias("fail")), "fail2")
    beyond = F.log10("p") - F.log10("low") - F.col("fail")
    three = _kept(triples.join(once(fail2), "a").select("k", "n", beyond.alias("e")), "three")
    discard(triples)
    two = pairs.join(once(fail1), "a").select("k", "n", beyond.alias("e")).join(once(fail2.select(F.col("a").alias("k"), "fail")), "k", "left")
    two = _kept(two.select("k", "n", (F.col("e") + F.coalesce("fail", F.lit(0.0))).alias("e")), "two")
    discard(pairs, fail1, fail2)
    least = max(LEAST, math.ceil(SHARE * total))
    # the begin mark is a history only: it has a failure arc and no place at the root
    root = F.when(F.col("k") == begin, 0.0).otherwise(F.log10(F.col("n") + 1.0) - F.lit(math.log10(bottom))).alias("root")
    held = _hot(words.select("k", "n", root, "fail").where((F.col("n") >= _word_least(total)) | (F.col("k") == begin)), 0, "root", "fail")
    hot = [_hot(x, least, "e") for x in (two, three)]
    rest = two.where(F.col("n") < least).select("k", "e").unionAll(three.where(F.col("n") < least).select("k", "e"))
    return total, types, Weights(1 + total // ASKED, held, hot, maps), words.where(F.col("k") != begin), rest


def _word_least(total: int) -> int:
    return max(2, math.ceil(WORD_SHARE * total))


#: Rows that travel: the weights of a bucket's n-grams and words, what a batch of texts asks of a bucket, the batch itself.
_WEIGHTS, _WORDS, _ASK, _ASK_WORDS, _TEXTS = range(5)
_ROW = "bucket int, kind int, batch bigint, a binary, b binary, c binary, d binary"
_TEXT = np.dtype([("doc_id", "<i8"), ("no_id", "?"), ("held_out", "i1"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(bucket, kind, batch, up to four arrays) as rows of ``_ROW``."""
    head = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
    packed = [pa.array([np.ascontiguousarray(r[i]).tobytes() if i < len(r) else b"" for r in rows], pa.binary()) for i in range(3, 7)]
    return pa.RecordBatch.from_arrays([*head, *packed], ["bucket", "kind", "batch", "a", "b", "c", "d"])


def _steps(place: np.ndarray) -> np.ndarray:
    """Rising places as steps of as few bytes as they need."""
    steps = np.diff(place, prepend=0)
    return steps.astype(np.min_scalar_type(int(steps.max(initial=0))))


def _places(steps: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, f"u{max(1, len(steps) // max(1, n))}"), dtype=np.int64)


def _weight_rows(table: DataFrame, kind: int, buckets: int) -> DataFrame:
    """The columns of a table, its key first, packed by buckets."""

    def pack(batches):
        def rows(held):
            k, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            return _rows([(b, kind, 0, *columns) for b, columns in _dealt(k, buckets, [k, *rest])])

        held, size = [], 0
        for batch in batches:
            k, *rest = (c.to_numpy() for c in batch.columns)
            held.append((k.view(U), *rest))
            size += len(k)
            if size > _HELD // 4:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return table.mapInArrow(pack, _ROW)


def _asked(docs: DataFrame, cast, bottom: float) -> DataFrame:
    """Batches of texts: what the weights held in memory give them, and the n-grams and words each asks of the buckets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = cast.value
        held, root, fail = weights.words
        word_at, gram_at = Places(held), [Places(top) for top, _ in weights.hot]
        task, done = TaskContext.get().partitionId(), 0

        def rows(texts, grams, rare):
            texts = np.concatenate(texts)
            # named after its content and place, so that answers to other batches of a repeated task are noticed
            name = hashlib.blake2b(texts.tobytes() + f"{task} {done}".encode(), digest_size=8).digest()
            name = int.from_bytes(name, "little", signed=True)
            out = []
            for kind, parts in ((_ASK, grams), (_ASK_WORDS, rare)):
                keys, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(place, kind="stable")
                for b, (k, at) in _dealt(keys[order], weights.asked, [keys[order], place[order]]):
                    out.append((b, kind, name, k, _steps(at)))
            out.append((name % weights.asked, _TEXTS, name, texts, np.array([len(out)])))
            return _rows(out)

        texts, grams, rare, size, first = [], [], [], 0, 0
        for batch in batches:
            ids, held_out = batch.column("doc_id"), batch.column("held_out")
            no_id, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            held_out = pc.fill_null(pc.cast(held_out, pa.int8()), -1).to_numpy()
            for lo, hi, data, offs in blocks(batch.column("text")):
                token, row = _tokens(data, offs)
                mark, at = token == U(BEGIN), word_at(token)
                known = at >= 0
                new = np.zeros(hi - lo, _TEXT)
                new["doc_id"], new["no_id"], new["held_out"] = ids[lo:hi], no_id[lo:hi], held_out[lo:hi]
                new["n"] = np.bincount(row[~mark], minlength=hi - lo)
                new["known"] = np.bincount(row[known & ~mark], minlength=hi - lo)
                # words that are not held count as unknown, until their bucket answers
                lost = (new["n"] - new["known"]) * bottom
                new["base"] = np.bincount(row[known], root[at[known]], hi - lo) - lost
                new["score"] = np.bincount(row[known], (root + fail)[at[known]], hi - lo) - lost
                other = ~known & ~mark
                rare.append((token[other], (row[other] + first).astype(np.uint32)))
                size += len(rare[-1][0])
                for (k, _, _, where), find, (_, e), may in zip(_grams(token, row), gram_at, weights.hot, weights.maps, strict=True):
                    k, where = k[ok := may.has(k)], where[ok]
                    at = find(k)
                    there = at >= 0
                    new["score"] += np.bincount(where[there], e[at[there]], hi - lo)
                    grams.append((k[~there], (where[~there] + first).astype(np.uint32)))
                    size += len(grams[-1][0])
                texts.append(new)
                size += hi - lo
                first += hi - lo
                if size > _HELD // 2:
                    yield rows(texts, grams, rare)
                    texts, grams, rare, size, first, done = [], [], [], 0, 0, done + 1
        if texts:
            yield rows(texts, grams, rare)

    return docs.mapInArrow(ask, _ROW)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, weights first. Of what a batch asks, the sums by text of the weights there are; the batch goes on."""

    class Table:
        def __init__(self):
            self.parts, self.places, self.columns = [], None, []

        def add(self, *columns):
            self.parts.append([np.frombuffer(c, kind) for c, kind in zip(columns, (U, np.float64, np.float64), strict=False)])

        def find(self, keys):
            """Which keys there are, and the columns of those."""
            if self.places is None:
                k, *rest = [np.concatenate(x) for x in zip(*self.parts, strict=True)] or [np.zeros(0, U)]
                order = np.argsort(k)
                self.places, self.columns, self.parts = Places(k[order]), [c[order] for c in rest], []
            at = self.places(keys)
            ok = at >= 0
            return ok, [c[at[ok]] for c in self.columns]

    now, grams, rare = None, Table(), Table()
    for batch in batches:
        out = []
        for bucket, kind, name, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if bucket != now:
                now, grams, rare = bucket, Table(), Table()
            if kind == _WEIGHTS:
                grams.add(a, b)
            elif kind == _WORDS:
                rare.add(a, b, c)
            elif kind == _TEXTS:
                out.append((bucket, kind, name, np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)))
            else:
                keys = np.frombuffer(a, U)
                ok, columns = (grams if kind == _ASK else rare).find(keys)
                place = _places(b, len(keys))[ok]
                head = np.flatnonzero(np.diff(place, prepend=-1))  # places rise
                sums = [np.add.reduceat(x, head) if len(head) else x for x in columns]
                hits = [np.diff(head, append=len(place)).astype(np.uint32)] if kind == _ASK_WORDS else []
                out.append((bucket, kind, name, _steps(place[head]), *sums, *hits) if len(head) else (bucket, kind, name))
        if out:
            yield _rows(out)


def _finished(total: int):
    def finish(table: pa.Table) -> pa.Table:
        """The texts of a batch with all answers, added in the order of the buckets: equal texts get equal sums."""
        bucket, kind, _, a, b, c, d = (table.column(i).to_pylist() for i in range(7))
        mine = [i for i, k in enumerate(kind) if k == _TEXTS]
        asks = sorted((i for i, k in enumerate(kind) if k != _TEXTS), key=lambda i: (kind[i], bucket[i]))
        if len(mine) != 1 or int(np.frombuffer(b[mine[0]], np.int64)[0]) != len(asks):
            raise RuntimeError("a repeated task read its texts in another order: write the texts to files and score those")
        text = np.frombuffer(a[mine[0]], _TEXT).copy()
        for i in asks:
            sums = np.frombuffer(b[i], np.float64)
            at = _places(a[i], len(sums))
            text["score"][at] += sums
            if kind[i] == _ASK_WORDS:
                text["base"][at] += sums
                text["score"][at] += np.frombuffer(c[i], np.float64)
                text["known"][at] += np.frombuffer(d[i], np.uint32)
        return pa.table({
            "doc_id": pa.array(text["doc_id"], mask=text["no_id"]), "held_out": pa.array(text["held_out"] > 0, mask=text["held_out"] < 0),
            "n_tokens": text["n"], "n_known": text["known"], "train_tokens": np.full(len(text), total), "base_score": text["base"], "score": text["score"],
        })

    return finish


def language_scores(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text), learned from
    the rows where the column ``held_out`` is false.

    A null or empty text has the end mark as its only token. Repeated rows get equal scores. Without training rows every
    word is unknown and has the probability 1 of the one type there is.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held_out"))
    total, types, weights, counts, rest = fit_weights(docs.where(~F.col("held_out")))
    cast = docs.sparkSession.sparkContext.broadcast(weights)  # bounded: see SHARE, WORD_SHARE and ALL_BITS
    rare = counts.where(F.col("n") < _word_least(total)).select("k", F.log10(F.col("n") + F.lit(1.0)).alias("log"), "fail")
    packed = _kept(_weight_rows(rest, _WEIGHTS, weights.asked).unionAll(_weight_rows(rare, _WORDS, weights.asked)), "packed")
    discard(rest, counts)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scores = []
    for i in range(ROUNDS):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == i)
        rows = _asked(some, cast, math.log10(total + types + 1)).unionAll(packed)
        answers = rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answered, _ROW)
        scores.append(_kept(answers.groupBy("batch").applyInArrow(_finished(total), schema), "scores"))
    discard(packed)
    cast.destroy()
    return reduce(DataFrame.unionAll, scores)


def language_model(docs: DataFrame) -> DataFrame:
    """``language_scores`` with the documents held out whose id's crc32 leaves 2 modulo 7."""
    return language_scores(docs, held_out_ids("doc_id", 7, 2))
