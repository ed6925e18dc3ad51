"""The prefix trie against plain dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from fixtures import LONG, rng
from pyspark.sql import functions as F

from gridwright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, c string, pa int, n int"


def frame(spark, rows):
    """With extra columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        members[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in members.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items()),
        key=lambda r: r[:2],
    )


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for _, t in df.dtypes[:-1])
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def forest(r):
    rows = []
    for c in range(120):
        texts = [r.choice("abc") * r.randint(0, 2) + r.choice(["", "é"]) for _ in range(r.randint(1, 12))]
        rows += [(c, t, r.choice(["user", "bot"]) if c % 2 else "user", x) for t, x in enumerate(texts)]
    for c in range(200, 260):  # one conversation many times
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    return rows


def test_equals_the_plain_trie(spark):
    rows = forest(rng())
    assert got(trie.prefix_trie(frame(spark, rows).repartition(7))) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"), (1, None, None, None), (1, None, "user", "null turn"), (1, 0, "user", LONG), (1, 0, "user", LONG), (2, 5, "", "tie"),
        (2, 5, "a", "tie"), (2, 5, None, "tie"), (-3, 1, "user", "below zero"), (-7, 1, "user", "below zero"), (7, 1, "user", "turnless, as its first turns are those of 5"),
        (13, 1, None, ""), (10**15, 1, "user", "x"), (10**15 + 1, 1, "user", "y"), (10**15 + 1, 2, "user", "z"),
    ]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    assert trie.prefix_trie(frame(spark, [])).collect() == []
    assert trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_long_chain_by_segments(spark, monkeypatch):
    """One conversation with most rows: places and prefixes by segments, the chain contracted in few rounds."""
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(1500)] + [(6, t, "user", f"turn {t % 7}") for t in range(900)] + forest(rng())[:200]
    monkeypatch.setattr(trie, "MAX_GROUP_ROWS", 100)
    monkeypatch.setattr(trie.prefixes, "__defaults__", (100,))
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("shape", ["caterpillar", "random", "chain"])
def test_subtree_totals(spark, shape):
    """Any tree; also one whose chains appear only after rakes, where the draws take over."""
    r = rng()
    n = 700
    parent = {0: None}
    for i in range(1, n):
        parent[i] = i - 1 if shape == "chain" else (i - 1 if i % 2 else max(0, i - 2)) if shape == "caterpillar" else r.randrange(max(0, i - 5), i)
    depth = {0: 0}
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    total = {i: i for i in range(n)}
    for i in sorted(range(1, n), key=depth.get, reverse=True):
        total[parent[i]] += total[i]
    rows = [(i, depth[i], parent[i], depth[i] - 1 if i else None, i) for i in range(n)]
    tree = spark.createDataFrame(rows, "c long, d long, pc long, pd long, x long")
    res = trie.subtree_totals(tree, ["x"], 3 if shape == "chain" else max(depth.values()))
    assert {row["c"]: row["x"] for row in res.collect()} == total


def test_hash_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    ends = spark.range(1000).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("long").alias("pa"), (F.col("id") % 3).alias("pb"), (F.col("id") * 37 % 1000).alias("conv"))
    want = {k: hashlib.sha256(",".join(str(x) for x in sorted(i * 37 % 1000 for i in range(1000) if i % 3 == k)).encode()).hexdigest() for k in range(3)}
    assert {r["pb"]: r["ends_sha256"] for r in trie.ends_hashes(ends).collect()} == want
