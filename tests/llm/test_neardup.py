import random
from collections import Counter, defaultdict

import fixtures as fx
import numpy as np

from gridwright.llm import neardup
from gridwright.llm.graph import components
from gridwright.llm.neardup import near_duplicates, without_near_duplicates

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = fx.words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component of each id, by all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverse = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inverse[g].append(d)
    same = Counter((a, b) for ids in inverse.values() for i, b in enumerate(ids) for a in ids[:i])
    for (a, b), n in same.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(n, edits, seed=1):
    r = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"e{r.random()}"
        out.append(" ".join(w))
    return out


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_of_near_copies(spark):
    rows = list(enumerate([*near_copies(120, 1), *near_copies(60, 2, 9), *near_copies(40, 4, 3)]))
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_all_pairs_within_the_distance_share_a_key():
    r = np.random.default_rng(3)
    size = neardup._VALUES
    a = r.integers(0, 1 << 16, (300, size)).astype(np.uint64)
    b = a.copy()
    for row in b:
        row[r.choice(size, 2 * neardup.CHUNKS - 1, replace=False)] ^= np.uint64(1)
    assert (neardup._keys(a) == neardup._keys(b)).any(axis=1).all()


def test_awkward_rows(spark):
    df = fx.awkward(spark, [(1, fx.LONG + " more"), (2, "word"), (3, "WORD"), (4, "two words"), (5, "TWO\twords")])
    rows = near_duplicates(df).collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[900][0].n_shingles == by[901][0].n_shingles == by[902][0].n_shingles == 0
    assert all(r.component_id == d and r.kept for d in (900, 901, 902, 908) for r in by[d])
    assert by[903][0].component_id == 1 and not by[903][0].kept
    assert by[3][0].component_id == 2 and by[5][0].component_id == 4 and by[4][0].n_shingles == 1
    assert {r.component_id for r in by[907]} == {906} and by[None][0].component_id is None
    left = without_near_duplicates(df)
    assert left.columns == df.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == [1, 2, 4, 900, 901, 902, 904, 905, 905, 906, 908]


def test_empty_table(spark):
    assert near_duplicates(fx.empty(spark)).count() == 0
    assert without_near_duplicates(fx.empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 7)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_pipeline_stage_matches_brute_force_at_80(spark):
    import corpus_pipeline

    r = random.Random(7)
    rows = []
    for i in range(400):  # three or four edits of 150 words: a similarity of 0.75 to 0.86
        w = [f"p{i}w{j}" for j in range(150)]
        rows.append((2 * i, " ".join(w)))
        for at in r.sample(range(150), r.choice([3, 3, 4])):
            w[at] = f"e{r.random()}"
        rows.append((2 * i + 1, " ".join(w)))
    sets = {d: shingles(t) for d, t in rows}
    like = [len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d, _ in rows[::2]]
    assert sum(0.8 <= x < 0.85 for x in like) > 150 and min(like) < 0.8
    want = sorted([d for d, _ in rows[::2]] + [2 * i + 1 for i, x in enumerate(like) if x < 0.8])
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in left.collect()) == want


def test_layouts_miss_hardly_any_pair():
    assert neardup.layout(85) == neardup.Layout()
    for percent in (70, 80, 85, 90, 100):
        cut, s = neardup.layout(percent), percent / 100
        shares = s**cut.chunk + cut.chunk * s ** (cut.chunk - 1) * (1 - s)
        assert (1 - shares) ** cut.chunks <= neardup.MISS and cut.most >= cut.values * (1 - s) + 4.5 * (cut.values * s * (1 - s)) ** 0.5


def test_texts_of_one_short_hash_are_told_apart(spark):
    """Two texts without an id whose 32-bit hashes are equal: the copy of a text with an id goes, the other stays."""
    rows = [(None, "text number 38147"), (None, "text number 190994"), (1, "text number 38147")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where("doc_id is null").selectExpr("hash(text) as h").distinct().count() == 1
    left = sorted((r.doc_id or 0, r.text) for r in without_near_duplicates(df).collect())
    assert left == [(0, "text number 190994"), (1, "text number 38147")]
