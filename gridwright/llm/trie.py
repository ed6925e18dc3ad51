"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A prefix of a conversation is known by the exclusive-or of two 64-bit hashes of its turns, each salted with its place, so all
prefixes come from one running exclusive-or and the prefix before from taking the last turn out again. A node is named by its
smallest member and its depth.

Subtree totals need no walk along the tree. Rounds of joins alternate: compress takes an independent set of nodes with one
child out of their chains and hangs the child, which carries their sums on, on the parent; rake adds all leaves to their parents
and takes them out. A tree of n nodes is gone after about log n rounds, also if it is one chain. A raked leaf's sum is its total
then. Compressed nodes are expanded at the end: each owes its own sum and its child's total, and doubling the pointers to the
children leads every one of them to a raked node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.storage import stored
from gridwright.plans.ordered import MAX_GROUP_ROWS, order_position, prefix_sums

#: A rebuilt conversation shares its first turns, fewer than ``HEADS``, with the first of ``FAMILY`` neighbours.
FAMILY, HEADS = 5, 9
#: Ids a packed piece of a list holds.
PIECE = 500


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, n, a, b, bytes): each turn's place from 1, how many there are, two hashes of role and text, bytes of the text.
    Turns are in order of ``turn``, null first, those of one turn by a digest. Rows without a conversation are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")
    )
    placed = order_position(rows, ["conv"], ["turn", "digest"], "pos", total="n", max_group=MAX_GROUP_ROWS)
    a, b = F.xxhash64("digest"), F.xxhash64(F.lit(1), F.col("digest"))
    return stored(placed.select("conv", F.col("pos").cast("bigint").alias("pos"), F.col("n").cast("bigint").alias("n"), a.alias("a"), b.alias("b"), "bytes"), "turns")


def rebuilt_turns(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each conversation c the first h turns of c - c % 5, then its own after its first h; h is crc32(c) % 9.
    Returns (conv, pos, a, b, bytes) and (conv, len), the latter also of conversations that are left without a turn."""
    convs = stored(own.groupBy("conv").agg(F.max("n").alias("n")), "convs")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), h.alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plans = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    plans = stored(plans.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "plans")
    heads = own.where(F.col("pos") < HEADS).select(F.col("conv").alias("base"), "pos", "a", "b", "bytes")
    heads = plans.join(heads, "base").where("pos <= h").select("conv", "pos", "a", "b", "bytes")
    tails = own.join(plans.select("conv", "h", "m"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "a", "b", "bytes")
    return heads.unionAll(tails), plans.select("conv", "len")


def prefixes(turns: DataFrame, longest: int, max_group: int = MAX_GROUP_ROWS) -> DataFrame:
    """(conv, depth, pa, pb, qa, qb, bytes): hashes of the prefix that ends with the turn, and of the one before it."""
    salted = turns.select("conv", F.col("pos").alias("depth"), F.xxhash64("pos", "a").alias("ha"), F.xxhash64("b", "pos").alias("hb"), "bytes")
    if longest <= max_group:
        upto = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
        run = salted.withColumn("pa", F.bit_xor("ha").over(upto)).withColumn("pb", F.bit_xor("hb").over(upto))
    else:
        run = prefix_sums(salted, ["conv"], ["depth"], {"pa": F.col("ha"), "pb": F.col("hb")}, how="xor")
    before = [F.col("pa").bitwiseXOR(F.col("ha")).alias("qa"), F.col("pb").bitwiseXOR(F.col("hb")).alias("qb")]
    return run.select("conv", "depth", "pa", "pb", *before, "bytes")


def _taken(r: int, bits: int) -> Column:
    """Whether compress takes a node with one child, (oc, od), in round r; never two neighbours. Chains of whole trees are halved
    by the bits of the depth; later, what rakes leave joins by draws: the greatest of three neighbours is taken."""
    if r < bits:
        at = lambda d: F.shiftright(F.col(d), r).bitwiseAND(F.lit(1))
        return (at("d") == 1) & (at("od") == 0)
    draw = lambda c, d: F.xxhash64(F.col(c), F.col(d), F.lit(r))
    return (draw("c", "d") > draw("oc", "od")) & (draw("c", "d") > draw("pc", "pd"))


def subtree_totals(tree: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(c, d, *values): sums over each node's subtree, itself included. ``tree``: (c, d, pc, pd, *values), one row a node, the
    root's parent null; nodes are named (c, d), ``d`` growing towards the leaves."""
    s, e, add = [f"s_{v}" for v in values], [f"e_{v}" for v in values], [f"a_{v}" for v in values]
    kids = tree.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(F.count("*").alias("n"), F.max(F.struct("c", "d")).alias("only"))
    state = tree.join(kids, ["c", "d"], "left").select(
        "c", "d", "pc", "pd", *[F.col(v).cast("bigint").alias(x) for v, x in zip(values, s, strict=True)], *[F.lit(0).cast("bigint").alias(x) for x in e],
        F.coalesce("n", F.lit(0)).alias("n"), F.col("only.c").alias("oc"), F.col("only.d").alias("od"),
    )
    state, bits, rounds = stored(state, "tree"), max(1, int(deepest).bit_length()), []
    while state.where("pc is not null").limit(1).count():
        taken = (F.col("n") == 1) & F.col("pc").isNotNull() & _taken(len(rounds), bits)
        state = state.withColumn("taken", F.coalesce(taken, F.lit(False)))
        link = state.where("taken").select(
            F.col("oc").alias("c"), F.col("od").alias("d"), F.col("c").alias("vc"), F.col("d").alias("vd"), F.col("pc").alias("npc"), F.col("pd").alias("npd"),
            *[F.col(x).alias(f"v{x}") for x in s], *[(F.col(x) + F.col(y)).alias(z) for x, y, z in zip(s, e, add, strict=True)],
        )
        held = state.where("not taken").drop("taken").join(link, ["c", "d"], "left").select(
            "c", "d", F.coalesce("npc", "pc").alias("pc"), F.coalesce("npd", "pd").alias("pd"), *s, "n", "vc", "vd",
            *[(F.col(x) + F.coalesce(z, F.lit(0))).alias(x) for x, z in zip(e, add, strict=True)],
            *[(F.col(f"v{x}") + F.col(y)).alias(f"w_{x}") for x, y in zip(s, e, strict=True)],
        )
        held = stored(held, "held")
        rounds.append(held)
        leaf = F.col("n") == 0
        got = held.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
            *[F.sum(F.when(leaf, F.col(x) + F.col(y)).otherwise(0)).alias(z) for x, y, z in zip(s, e, add, strict=True)],
            F.count(F.when(~leaf, 1)).alias("left"), F.max(F.when(~leaf, F.struct("c", "d"))).alias("only"),
        )
        inner = held.where((F.col("n") > 0) | F.col("pc").isNull()).join(got, ["c", "d"], "left")
        state = stored(inner.select(
            "c", "d", "pc", "pd", *[(F.col(x) + F.coalesce(z, F.lit(0))).alias(x) for x, z in zip(s, add, strict=True)], *e,
            F.coalesce("left", F.lit(0)).alias("n"), F.col("only.c").alias("oc"), F.col("only.d").alias("od"),
        ), "tree")
    final = state.select("c", "d", *s)  # the root
    for held in rounds:
        final = final.unionAll(held.where("n = 0 and pc is not null").select("c", "d", *s))
    if rounds:
        final = final.unionAll(_expanded(rounds, final, s))
    return final.select("c", "d", *[F.col(x).alias(v) for v, x in zip(values, s, strict=True)])


def _expanded(rounds: list[DataFrame], final: DataFrame, s: list[str]) -> DataFrame:
    """Totals of the compressed nodes. A child was taken out after its parent, so chains of pointers have at most as many links as
    there were rounds."""
    w = [f"w_{x}" for x in s]
    owed = None
    for held in rounds:
        part = held.where("vc is not null").select(F.col("vc").alias("c"), F.col("vd").alias("d"), F.col("c").alias("nc"), F.col("d").alias("nd"), *w)
        owed = part if owed is None else owed.unionAll(part)
    owed = stored(owed, "owed")
    for _ in range(max(1, (len(rounds) - 1).bit_length())):
        ahead = owed.select(F.col("c").alias("nc"), F.col("d").alias("nd"), F.col("nc").alias("nnc"), F.col("nd").alias("nnd"), *[F.col(x).alias(f"n{x}") for x in w])
        owed = stored(owed.join(ahead, ["nc", "nd"], "left").select(
            "c", "d", F.coalesce("nnc", "nc").alias("nc"), F.coalesce("nnd", "nd").alias("nd"), *[(F.col(x) + F.coalesce(f"n{x}", F.lit(0))).alias(x) for x in w]
        ), "owed")
    known = final.select(F.col("c").alias("nc"), F.col("d").alias("nd"), *s)
    return owed.join(known, ["nc", "nd"]).select("c", "d", *[(F.col(x) + F.col(f"w_{x}")).alias(x) for x in s])


_KEY = ("depth", "pa", "pb")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node as pieces of comma-joined text."""
    key, ids, out = None, [], []

    def flush():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_KEY, "conv")]
        for row in zip(*columns, strict=True):
            if row[:3] != key or len(ids) >= PIECE:
                flush()
                key = row[:3]
            ids.append(row[3])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*_KEY, "first", "piece"])
            out = []
    flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*_KEY, "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node in turn; only the state of one hash is held."""
    key, state, out = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_KEY, "piece")]
        for row in zip(*columns, strict=True):
            if row[:3] != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = row[:3], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row[3].encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*_KEY, "ends_sha256"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*_KEY, "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, pa, pb, ends_sha256) of the conversations (depth, pa, pb, conv) that end at a node. A node's ids are sorted and packed
    by all tasks; one hash is one pass by its nature, over the packed pieces only and in constant memory."""
    key = "depth bigint, pa bigint, pb bigint"
    pieces = ends.repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(_packed, f"{key}, first bigint, piece string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; rows with a null conv_id are left out; turns of one number (null is one) are in order of the
    md5 of role and text, so equal rows count as often as they stand there. Without conversations there is no node. Only
    ``conv_id``, ``turn``, ``role`` and ``text`` are read. Prefixes are told apart by 128 bits.
    """
    own = own_turns(conversations)
    turns, lengths = rebuilt_turns(own)
    total, root, deepest = lengths.agg(F.count("*"), F.min("conv"), F.max("len")).first()
    schema = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not total:
        return conversations.sparkSession.createDataFrame([], schema)
    paths = stored(prefixes(turns, deepest), "prefixes")
    nodes = stored(paths.groupBy(*_KEY).agg(
        F.min("conv").alias("c"), F.count("*").alias("n_convs"), F.max("qa").alias("qa"), F.max("qb").alias("qb"), F.max("bytes").alias("bytes")
    ), "nodes")
    # The root is the parent of all first turns; the others find theirs.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("c").alias("pc"))
    later = nodes.where("depth > 1").join(parents, ["depth", "qa", "qb"]).select(*_KEY, "c", "pc", "n_convs", "bytes")
    first = nodes.where("depth = 1").select(*_KEY, "c", F.lit(root).cast("bigint").alias("pc"), "n_convs", "bytes")
    top = conversations.sparkSession.range(1).select(*[F.lit(0).cast("bigint").alias(x) for x in _KEY], F.lit(root).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("pc"), F.lit(total).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("bytes"))
    nodes = top.unionAll(first).unionAll(later).withColumn("pd", F.when(F.col("pc").isNotNull(), F.col("depth") - 1))
    kids = nodes.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["c", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "linked")
    totals = subtree_totals(nodes.select("c", F.col("depth").alias("d"), "pc", "pd", "leaf", "saved"), ["leaf", "saved"], deepest)
    totals = totals.select("c", F.col("d").alias("depth"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    lasts = paths.join(lengths, (paths["conv"] == lengths["conv"]) & (paths["depth"] == lengths["len"])).select(*_KEY, paths["conv"])
    none = lengths.where("len = 0").select(*[F.lit(0).cast("bigint").alias(x) for x in _KEY], "conv")
    ends = ends_hashes(lasts.unionAll(none))
    out = nodes.drop("leaf", "saved").join(totals, ["c", "depth"]).join(ends, list(_KEY), "left")
    return out.select(
        F.col("c").alias("conv_id"), "depth", F.col("pc").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
