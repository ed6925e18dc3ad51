"""I-Match fingerprints against a plain version in Python."""

import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from fixtures import awkward, empty, rng, text

from gridwright.llm import imatch

SIGNED = 1 << 63


def h64(value, seed=42):
    data = value.encode() if isinstance(value, str) else struct.pack("<i" if isinstance(value, Int) else "<q", value)
    got = xxhash.xxh64(data, seed=seed & ((1 << 64) - 1)).intdigest()
    return got - (1 << 64) if got >= SIGNED else got


class Int(int):
    """Hashed as 32 bits."""


def terms(value):
    return {h64(t) for t in re.split(r"[\W_]+", value.lower()) if t}


def drawn(term, salt, r):
    """16 bits for a term and a family."""
    return (h64(Int(r // 4), h64(Int(salt), h64(term))) >> 16 * (r % 4)) & 0xFFFF


def brute_parts(value, lexicon):
    kept, parts = terms(value) & lexicon, []
    for r in range(imatch.REPLICATES):
        part = (15 << 16) + (h64(h64(value.lower()), h64(Int(r))) & 0xFFFF)
        for level in range(imatch.TOP_LEVEL + 1):
            x = 0
            for t in kept:
                if drawn(t, 2, r) % 4**level == 0:
                    x ^= drawn(t, 1, r)
            part = (level << 16) + x if x else part
        parts.append(part)
    return parts


def brute_lexicon(rows):
    """Without texts of very many copies."""
    df = Counter(t for _, v in rows for t in terms(v or ""))
    n = len(rows)
    return {t for t, c in df.items() if imatch.LOW * n <= c <= max(imatch.HIGH * n, 1)}


def brute(rows):
    rows = sorted(((d is not None, d or 0, h64(t or ""), t or "") for d, t in rows))
    lexicon = brute_lexicon([(d, t) for _, d, _, t in rows])
    out = []
    for i, (known, d, _, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][3]
        k = len(t) // 2
        edited = t[: len(t) - k] + after[:k]
        a, b, c = (brute_parts(x, lexicon) for x in (t, edited, after))
        same = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / imatch.REPLICATES
        out.append((d if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:05x}" for x in a), "".join(f"{x:05x}" for x in b), same(a, b), same(a, c)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))


def got(df):
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return order([tuple(r[c] for c in cols) for r in df.collect()])


@pytest.fixture
def rows():
    r = rng()
    words = [f"w{i}" for i in range(400)]
    out = [(i, " ".join(r.choice(words[: r.choice((20, 400))]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    return out + [(200 + i, out[i][1]) for i in range(10)] + [(300, None), (301, ""), (302, "Únïcode wörds, 漢字 😀!"), (400, text(r, 300))]


def test_equals_the_plain_version(spark, rows, monkeypatch):
    monkeypatch.setattr(imatch, "LOW", 1 / 50)
    monkeypatch.setattr(imatch, "HEAVY", 1.0)
    monkeypatch.setattr(imatch, "BLOCK_ROWS", 20)
    monkeypatch.setattr(imatch.fit_lexicon, "__defaults__", (1 / 50, imatch.HIGH))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(imatch.edited_fingerprints(docs)) == order(brute(rows))


def test_awkward_rows(spark):
    docs = awkward(spark)
    res = imatch.edited_fingerprints(docs)
    assert res.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found, plain = got(res), order(brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert [f[:3] for f in found] == [p[:3] for p in plain]
    assert all(0 <= f[5] <= 1 and 0 <= f[6] <= 1 for f in found)


def test_empty_and_single(spark):
    assert imatch.edited_fingerprints(empty(spark)).collect() == []
    one = imatch.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in one] == [(5, 6, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]


def test_likeness_follows_the_overlap(spark):
    """A few changed words leave most parts, another text hardly any; copies of one text do not empty the lexicon."""
    r = rng()
    words = [f"term{i}" for i in range(20_000)]
    texts = [" ".join(r.sample(words, 120)) for _ in range(400)]
    near = [" ".join(["changed", *t.split()[1:]]) for t in texts[:50]]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(near)), *((2000 + i, texts[7]) for i in range(300))]
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parts = lambda d: [prints[d][i : i + 5] for i in range(0, len(prints[d]), 5)]
    same = lambda a, b: sum(x == y for x, y in zip(parts(a), parts(b), strict=True)) / imatch.REPLICATES
    assert sum(same(i, 1000 + i) for i in range(50)) / 50 > 0.9
    assert sum(same(i, i + 1) for i in range(50)) / 50 < 0.1
    assert all(prints[2000 + i] == prints[7] for i in range(300))


def test_no_python_and_one_move_of_the_texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = imatch.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    main = plan[: plan.index("Subquery")]
    assert main.count("hashpartitioning") == 1
