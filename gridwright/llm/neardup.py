"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is ``chunks * chunk`` values of 16 bits, the minima of as many hash functions over its word
shingles; the distance of two signatures is the number of places at which they differ. Cut into ``chunks`` chunks, two
signatures at distance ``2 * chunks - 1`` or less have a chunk with at most one error (pigeonhole). Every allowed error
is enumerated: a chunk gives one key for each of its places, made of the other places, so all such pairs share a key.
The chunks are set by the least similarity (``layout``), so that a pair at it misses every key with probability 4e-5
or less: 8 chunks of 7 at 0.85, 10 chunks of 6 at 0.80.

Documents with the same set form one class; only classes are compared. Within a key, candidates are compared with a
few leaders first. Members of keys that then still hold several components are paired if they share a shingle of their sets'
prefixes (rarest first; two sets that are similar enough always do), but never two members of one component. Candidates
must also be within a bound of the signature distance. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.graph import components
from gridwright.llm.storage import stored
from gridwright.llm.textblocks import U, blocks, grams, lowered, mix, prefix_sums, span_hash, words

SHINGLE = 5
CHUNKS, CHUNK = 8, 7
#: Signature distance up to which candidates are confirmed; at similarity 0.85 the mean is 8, the deviation 2.6.
MAX_DISTANCE = 21
#: Probability with which a pair at the least similarity may miss every key, and deviations of its signature distance.
MISS, DEVIATIONS = 4.5e-5, 5
#: Shingles before its own that a posting of a left-over set carries.
BEFORE = 16
_NIBBLES = 15  # of a number of a signature's low bits, four of each value


@dataclass(frozen=True)
class Layout:
    """How signatures are cut into chunks, and the distance up to which candidates are confirmed."""

    chunks: int = CHUNKS
    chunk: int = CHUNK
    most: int = MAX_DISTANCE

    @property
    def values(self) -> int:
        return self.chunks * self.chunk

    @property
    def numbers(self) -> int:
        return -(-self.values // _NIBBLES)


def layout(percent: int) -> Layout:
    """For links of this similarity: chunks are shorter where errors are more, and as many as ``MISS`` asks for."""
    s = min(max(percent, 1), 99) / 100
    chunk = CHUNK if percent >= 85 else CHUNK - 1 if percent >= 75 else CHUNK - 3
    shares = s**chunk + chunk * s ** (chunk - 1) * (1 - s)
    chunks = max(CHUNKS, math.ceil(math.log(MISS) / math.log1p(-shares)))
    n = chunks * chunk
    return Layout(chunks, chunk, max(MAX_DISTANCE, math.floor(n * (1 - s) + DEVIATIONS * math.sqrt(n * s * (1 - s)))))


_DEFAULT = Layout()
_VALUES = _DEFAULT.values


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle ids (50 bits) of each text, in order of row and id, and their rows."""
    low = lowered(data)
    starts, ends, rows = words(low, offs)
    hashes = span_hash(prefix_sums(low), starts, ends)
    ids, at = grams(hashes, rows, size)
    row = rows[at]
    count = np.bincount(rows, minlength=len(offs) - 1)
    for n in range(1, size):  # a text of fewer words is one shingle
        short = np.flatnonzero(count[rows] == n) if (count == n).any() else []
        if len(short):
            more, place = grams(hashes[short], rows[short], n)
            ids, row = np.concatenate([ids, more]), np.concatenate([row, rows[short][place]])
    both = np.unique((row.astype(U) << U(50)) | (ids >> U(14)))
    return both & U((1 << 50) - 1), (both >> U(50)).astype(np.int64)


def _by_row(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that occur, and where each begins."""
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[begin], begin


def _signatures(ids: np.ndarray, begin: np.ndarray, cut: Layout = _DEFAULT) -> np.ndarray:
    seeds = mix(np.arange(1, cut.values + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    scales = mix(seeds + U(7)) | U(1)
    out = np.empty((len(begin), cut.values), U)
    for k in range(cut.values):
        h = (ids ^ seeds[k]) * scales[k]
        h ^= h >> U(29)
        out[:, k] = np.minimum.reduceat(h, begin) if len(begin) else 0
    return mix(out) & U(0xFFFF)


def _keys(sig: np.ndarray, cut: Layout = _DEFAULT) -> np.ndarray:
    """One key for each chunk and place left out."""
    out = np.empty((len(sig), cut.values), U)
    for c in range(cut.chunks):
        for p in range(cut.chunk):
            h = np.full(len(sig), c * cut.chunk + p + 1, U)
            for j in range(cut.chunk):
                if j != p:
                    h = h * U(0xA24BAED4963EE407) + sig[:, c * cut.chunk + j] + U(1)
            out[:, c * cut.chunk + p] = mix(h)
    return out


def _nibbles(sig: np.ndarray, cut: Layout = _DEFAULT) -> np.ndarray:
    """Four bits of each value, as a few numbers."""
    shift = (np.arange(_NIBBLES, dtype=U) * U(4))[None, :]
    parts = [sig[:, i * _NIBBLES : (i + 1) * _NIBBLES] & U(15) for i in range(cut.numbers)]
    return np.stack([(x << shift[:, : x.shape[1]]).sum(axis=1, dtype=U) for x in parts], axis=1)


def _digests(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """16 bytes that name a set."""
    parts = [np.add.reduceat(mix(ids ^ U(s)), begin) if len(begin) else np.zeros(0, U) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return mix(np.stack(parts, axis=1))


def _sketch(batches: Iterator[pa.RecordBatch], cut: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in blocks(batch.column("text")):
            ids, rows = shingle_sets(data, offs)
            has, begin = _by_row(rows)
            sig, digest = _signatures(ids, begin, cut).astype(np.uint16), _digests(ids, begin)
            n = hi - lo
            names, signatures, ids64 = [None] * n, [None] * n, [None] * n
            for i, row in enumerate(has.tolist()):
                names[row], signatures[row], ids64[row] = digest[i].tobytes(), sig[i].tobytes(), int(digest[i, 0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, n), batch.column("k").slice(lo, n), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(names, pa.binary()), pa.array(ids64, pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "k", "n_shingles", "cls", "id", "sig"],
            )


def _values(batch: pa.RecordBatch, cut: Layout) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, cut.values).astype(U)


def _postings(batches: Iterator[pa.RecordBatch], cut: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.repeat(batch.column("id").to_numpy(), cut.values)
        yield pa.RecordBatch.from_arrays([pa.array(_keys(_values(batch, cut), cut).ravel().view(np.int64)), pa.array(ids)], ["key", "id"])


def _near(batches: Iterator[pa.RecordBatch], cut: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = _nibbles(_values(batch, cut), cut)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *(pa.array(near[:, i].view(np.int64)) for i in range(cut.numbers))], ["id", "n", *(f"s{i}" for i in range(cut.numbers))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in blocks(batch.column("text")):
            ids, rows = shingle_sets(data, offs)
            has, begin = _by_row(rows)
            ends = np.append(begin, len(ids)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_digests(ids, begin)[:, 0].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int64)))],
                ["id", "ids"],
            )


def _distance(a: str, b: str, cut: Layout) -> str:
    """SQL: places at which two signatures differ, as far as four bits a value show it."""
    parts = []
    for s in (f"s{i}" for i in range(cut.numbers)):
        x = f"({a}.{s} ^ {b}.{s})"
        parts.append(f"bit_count(({x} | shiftright({x}, 1) | shiftright({x}, 2) | shiftright({x}, 3)) & {0x111111111111111})")
    return " + ".join(parts)


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """(id, ids): the full shingle set of each class named by ``ids``, from the text of its first document."""
    reps = stored(classes.join(ids, "id").select(F.col("first").alias("rep")).distinct(), "reps", parts)
    texts = docs.join(reps, docs.doc_id.eqNullSafe(reps.rep), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "id bigint, ids array<bigint>").join(ids, "id", "left_semi")
    return stored(sets.groupBy("id").agg(F.first("ids").alias("ids")), "sets", parts)


def _confirmed(sets: DataFrame, pairs: DataFrame, parts: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("ids").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("ids").alias("y")), "b")
        .select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("all"))
    )
    return stored(both.where(F.col("same") * 100 >= percent * (F.col("all") - F.col("same"))).select("a", "b"), "links", parts)


def _rare_members(sets: DataFrame, percent: int) -> DataFrame:
    """(id, shingle, place, before): of each set the shingles of its prefix, rarest first, that another set has too, with
    its place in this order and a few before it. Two sets that are similar enough share a shingle of their prefixes, for an
    order common to all; so no link is lost."""
    rows = sets.select("id", F.size("ids").alias("n"), F.explode("ids").alias("shingle"))
    many = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(many, "shingle").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("v"))
    # the shingles of this set alone come first and match nothing
    length = F.expr(f"n - cast(ceil(n * {percent} / 100D) as int) + 1 - (n - size(v))")
    own = own.withColumn("length", length).where("length > 0")
    each = own.select("id", "n", "v", F.posexplode(F.expr("slice(v, 1, length)")).alias("i", "s"))
    before = F.expr(f"transform(slice(v, greatest(1, i - {BEFORE - 1}), least(i, {BEFORE})), x -> x.shingle)")
    return each.select("id", F.col("s.shingle").alias("shingle"), F.expr("n - size(v) + i").alias("place"), before.alias("before"))


def _left_pairs(members: DataFrame, close: str, percent: int) -> DataFrame:
    """Pairs of members of one shingle with different roots. Of each shingle, the members of its largest root stand on one
    side only, so a large connected group is never paired with itself. If the shingle is the first two sets share, no more
    than what follows it can be common to both: a pair for which that is too little is none. A pair that shares one of the
    shingles just before was met there."""
    roots = members.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    main = roots.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("r")).where("r > 1").select("shingle", "main")
    both = members.join(main, "shingle")
    few = both.where("root <> main").alias("p")
    on = f"p.shingle = q.shingle and p.root <> q.root and (q.root = q.main or p.id < q.id) and {close}"
    on += f" and {100 + percent} * least(p.n - p.place, q.n - q.place) >= {percent} * (p.n + q.n) and not arrays_overlap(p.before, q.before)"
    return few.join(both.alias("q"), F.expr(on))


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, sets: DataFrame | None, percent: int, links: DataFrame | None = None):
    """The confirmed pairs and, with the ``links`` known before, the root of each linked class; None twice if there are no
    pairs."""
    many = pairs.count()
    if not many:
        return None, None
    parts = 8 + many // 20_000
    if sets is None:
        need = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        sets = _sets_of(docs, classes, need, parts)
    found = _confirmed(sets, pairs, parts, percent)
    return found, components(found if links is None else found.unionAll(links), parts).withColumnRenamed("node", "id")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored); also k,
    a 64-bit hash of the text, which names the texts of one id (null ids share one).

    Rows link if ``100 * intersection >= percent * union`` of their sets of distinct word shingles (five words; a text of
    fewer words is one shingle). A null or empty text has an empty set and no links: its component is its own id. Repeated
    rows share their class. A null id counts as larger than any other; a component of null ids alone is null. kept:
    doc_id is component_id. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("k"))
    cut = layout(percent)
    sketch = stored(docs.mapInArrow(lambda it: _sketch(it, cut), "doc_id bigint, k bigint, n_shingles bigint, cls binary, id bigint, sig binary"), "sketch")
    classes = sketch.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("id").alias("id"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes")  # id: the first half of the digest
    found = classes.select("id", "sig").mapInArrow(lambda it: _postings(it, cut), "key bigint, id bigint")
    shared = found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    postings = stored(found.join(shared, "key").distinct(), "postings")
    info = classes.join(postings.select("id").distinct(), "id", "left_semi").select("id", "n", "sig")
    info = stored(info.mapInArrow(lambda it: _near(it, cut), f"id bigint, n bigint, {', '.join(f's{i} bigint' for i in range(cut.numbers))}"), "info")
    close = f"least(p.n, q.n) * 100 >= {percent} * greatest(p.n, q.n) and {_distance('p', 'q', cut)} <= {cut.most}"
    pair = [F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")]
    # first each member of a key with the leaders of the key: the member that meets most others in all its keys, and two
    # by a hash
    met = postings.join(postings.groupBy("key").agg(F.count("*").alias("c")), "key").groupBy("id").agg(F.sum("c").alias("met"))
    info = stored(info.join(met, "id"), "info")
    full = postings.join(info, "id")
    member = [F.col(c) for c in info.columns]
    heads = [F.max(F.struct("met", F.xxhash64("id").alias("h"), F.struct(*member).alias("m"))).alias("l0")]
    heads += [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), F.struct(*member).alias("m"))).alias(f"l{i}") for i in (1, 2)]
    lead = full.groupBy("key").agg(*heads).select("key", F.explode(F.array_distinct(F.array("l0.m", "l1.m", "l2.m"))).alias("m")).select("key", "m.*")
    pairs = stored(full.alias("p").join(lead.alias("q"), F.expr(f"p.key = q.key and p.id <> q.id and {close}")).select(*pair).distinct(), "pairs")
    links, root = _linked(docs, classes, pairs, None, percent)
    # then what is left: members of keys that hold more than one component
    here = postings.withColumn("root", F.col("id")) if root is None else postings.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    alive = here.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    left = stored(here.join(alive, "key", "left_semi").select("id", "root").distinct(), "left")
    count = left.count()
    if count:
        sets = _sets_of(docs, classes, left.select("id"), 8 + count // 20_000)
        members = stored(_rare_members(sets, percent).join(left, "id").join(info, "id"), "members")
        pairs = stored(_left_pairs(members, close, percent).select(*pair).distinct(), "pairs")
        more, last = _linked(docs, classes, pairs, sets, percent, links)
        root = last if more is not None else root
    if root is None:
        named = classes.select("cls", F.col("first").alias("component_id"))
    else:
        named = classes.join(root, "id", "left").select("cls", "first", F.coalesce("root", "id").alias("root"))
        lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named = named.join(lowest, "root").select("cls", "component_id")
    ids = sketch.select("doc_id", "k", "n_shingles", "cls")
    linked = ids.join(named, "cls", "left").select("doc_id", "k", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one is left in each component: the one of the smallest id.
    Of rows that repeat an id and text, one is left; rows with a null id fall to any row with an id, else they stay."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("h"))
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id", "k").distinct()
    gone = stored(gone, "gone")
    again = stored(rows.groupBy("d", "h").count().where("count > 1").select(F.col("d").alias("doc_id"), F.col("h").alias("k")), "again")
    left = rows.join(gone, F.expr("d <=> doc_id and h = k"), "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    one = left.join(again, F.expr("d <=> doc_id and h = k"), "left_semi").dropDuplicates(["d", "h"])
    return left.join(again, F.expr("d <=> doc_id and h = k"), "left_anti").unionAll(one).select("row.*")
