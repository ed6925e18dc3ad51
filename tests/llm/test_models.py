import math
import zlib
from collections import Counter, defaultdict

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwright.llm import lm, quality, toxicity
from gridwright.llm.textblocks import blocks, span_hash, prefix_sums, text_hash, words

SF = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    return float(np.mean([(a > s[y == 0]).mean() + 0.5 * (a == s[y == 0]).mean() for a in s[y == 1]]))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_words_and_hashes():
    texts = ["Ab  cd\tAB", None, "", " é\n\x0bx ", "tail"]
    found = []
    for lo, _, data, offs in blocks(pa.array(texts), max_bytes=8):
        s, e, r = words(data, offs)
        found += [(lo + int(i), data[a:b].tobytes().decode()) for a, b, i in zip(s, e, r, strict=True)]
        assert [int(h) for h in span_hash(prefix_sums(data), s, e)] == [text_hash(data[a:b].tobytes()) for a, b in zip(s, e, strict=True)]
    assert found == [(0, "Ab"), (0, "cd"), (0, "AB"), (3, "é"), (3, "x"), (4, "tail")]


def all_maximal(scores):
    """Maximal scoring segments by their definition: take the best segment, then both sides of it."""
    if not scores:
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return all_maximal(scores[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in all_maximal(scores[j:])]


def shifted(found, by):
    return [(a + by, b + by, s) for a, b, s in found]


def test_segments_are_the_maximal_ones():
    r = fx.rng()
    for _ in range(300):
        n = r.randint(1, 25)
        places = sorted(r.sample(range(n), r.randint(0, min(n, 8))))
        score = [r.choice([0.31, 0.83, 1.37, 2.11]) + r.random() / 100 for _ in places]
        full = [-0.4] * n
        for p, s in zip(places, score, strict=True):
            full[p] = s
        want = [(a, b, round(s, 9)) for a, b, s in all_maximal(full)]
        assert [(a, b, round(s, 9)) for a, b, s in toxicity.segments(places, score, 0.4)] == want


def test_toxicity_on_held_out_documents(spark, tables):
    docs, labels = tables
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.toxic, got.score) > 0.85 and (got.predicted == got.toxic).mean() > 0.95
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 1
    some = toxicity.toxicity(docs, labels).where("predicted = 1").join(docs, "doc_id").first()
    assert some.passages and all(0 <= p.start < p.end <= len(some.text) and p.expectation < 1 for p in some.passages)


def test_quality_on_held_out_documents(spark, tables):
    docs, labels = tables
    got = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.quality, got.score) > 0.95 and (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_held_out_rows_teach_nothing(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    from gridwright.llm.textblocks import held_out_ids

    other = labels.withColumn("toxic", F.when(held_out_ids("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).drop("passages").collect())) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_on_awkward_rows(spark, run):
    df = fx.awkward(spark)
    for labels in (fx.labels(spark), fx.labels(spark).limit(0)):
        rows = run(df, labels).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        same = [r.score for r in rows if r.doc_id == 904]
        assert same[0] == same[1]
    assert run(fx.empty(spark), fx.labels(spark)).count() == 0
    assert toxicity.fit_toxicity(df, fx.labels(spark)).keep_clean(df).columns == df.columns


def test_temperature_softens_bold_logits():
    r = np.random.default_rng(1)
    y = (r.random(4000) < 0.5).astype(float)
    logit = np.where(y > 0, 1, -1) * 1.0 + r.normal(0, 1.4, 4000)
    assert quality.best_temperature(5 * logit, y) > 3 * quality.best_temperature(logit, y)


def brute_lm(rows, held):
    docs = [(d, ["<s>", *fx.words(t), "</s>"]) for d, t in rows]
    c, b, t = Counter(), Counter(), Counter()
    for d, w in docs:
        if not held(d):
            c.update(w)
            b.update(zip(w, w[1:], strict=False))
            t.update(zip(w, w[1:], w[2:], strict=False))
    begins = c.pop("<s>", 0)
    total, types = sum(c.values()), len(c)
    least = max(2, math.ceil(lm.SHARE * total))
    names = {w for w in c if c[w] >= least} | {"<s>"}
    b = {k: n for k, n in b.items() if n >= least and set(k) <= names}
    t = {k: n for k, n in t.items() if n >= least and k[:2] in b and k[1:] in b}
    one = lambda w: (c[w] + 1) / (total + types + 1)
    two = {k: (n - lm.DISCOUNT) / (begins if k[0] == "<s>" else c[k[0]]) for k, n in b.items()}
    three = {k: (n - lm.DISCOUNT) / b[k[:2]] for k, n in t.items()}

    def weights(arcs, lower):
        up, down = defaultdict(float), defaultdict(float)
        for k, p in arcs.items():
            up[k[:-1]] += p
            down[k[:-1]] += lower(k)
        return {h: max(1 - up[h], 1e-12) / max(1 - down[h], 1e-12) for h in up}

    back1, back2 = weights(two, lambda k: one(k[-1])), weights(three, lambda k: two[k[1:]])

    def score(w):
        """The automaton itself, one token after another: state, failure arcs, weights."""
        states = {()} | set(back1) | set(back2)
        out, state = 0.0, ("<s>",) if ("<s>",) in states else ()
        for i in range(1, len(w)):
            arc = {**two, **three}
            while state and (*state, w[i]) not in arc:
                out += math.log10((back1 if len(state) == 1 else back2)[state])
                state = state[1:] if state[1:] in states else ()
            out += math.log10(arc[(*state, w[i])] if state else one(w[i]))
            state = next(s for s in (tuple(w[max(0, i - 1) : i + 1]), (w[i],), ()) if s in states)
        return out

    return {d: (len(w) - 1, sum(x in c for x in w[1:]), total, sum(math.log10(one(x)) for x in w[1:]), score(w)) for d, w in docs}


def test_language_model_matches_a_sequential_automaton(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(d, " ".join((t or "").split()[:150])) for d, t in rows]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want = brute_lm(rows, held)
    got = {r.doc_id: r for r in lm.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, (n, known, total, base, score) in want.items():
        g = got[d]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (n, known, total, held(d))
        assert abs(g.base_score - base) < 1e-6 and abs(g.score - score) < 1e-6


def test_rare_pairs_and_triples_score_as_frequent_ones(spark, monkeypatch):
    r = fx.rng()
    rows = [(i, " ".join(r.choice("abcdefghij") + r.choice(["", "x"]) for _ in range(40))) for i in range(30)]
    rows += [(100 + i, f"only{i // 2} twice{i // 2} here{i // 2} and there") for i in range(8)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    repeated = [*rows, rows[0], rows[0]]
    want = brute_lm(repeated, held)
    monkeypatch.setattr(lm, "SHARE", 0.01)  # as in a large corpus, where few n-grams have such a share
    monkeypatch.setattr(lm, "WORD_SHARE", 0.05)
    got = lm.language_model(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
    assert len(got) == len(repeated)
    for g in got:
        n, known, total, base, score = want[g.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total)
        assert abs(g.base_score - base) < 1e-6 and abs(g.score - score) < 1e-6


def test_rare_words_come_from_the_count_table(spark, monkeypatch):
    rows = [(i, f"the same words here {i} and the rare{i % 9} the same") for i in range(40)] + [(3, "the same words here 3 and the rare3 the same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.doc_id, r.n_known, round(r.base_score, 9))
    want = sorted(map(key, lm.language_model(df).collect()))
    monkeypatch.setattr(lm, "WORD_SHARE", 0.05)
    assert sorted(map(key, lm.language_model(df).collect())) == want


def test_texts_ask_the_buckets_in_batches(spark, monkeypatch):
    r = fx.rng()
    rows = [(i, " ".join(r.choice("abcdefgh") + r.choice(["", "x", "y"]) for _ in range(r.randrange(60)))) for i in range(240)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(None, rows[5][1]), (None, None), (None, rows[5][1])]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    want = brute_lm([(i, t or "") for i, (_, t) in enumerate(rows)], lambda i: held(rows[i][0]))
    for name, value in (("SHARE", 0.01), ("WORD_SHARE", 0.1), ("BUCKET", 300), ("ASKED", 300), ("_HELD", 2000)):
        monkeypatch.setattr(lm, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    total, types, weights, _, _ = lm.fit_weights(df)
    cast = spark.sparkContext.broadcast(weights)
    docs = df.withColumn("held_out", F.lit(False))
    sent = lm._asked(docs, cast, math.log10(total + types + 1)).collect()
    batches = [np.frombuffer(x.a, lm._TEXT) for x in sent if x.kind == lm._TEXTS]
    assert weights.asked > 20 and len(batches) > 3 and sum(map(len, batches)) == len(rows)
    # a row a batch and bucket, not a row a text and bucket
    assert len(sent) <= len(batches) * (2 * weights.asked + 1) < len(rows) * weights.asked
    got = lm.language_model(df).collect()
    key = lambda x: (x[0] is None, x[0] or 0, round(x[-1], 6))
    found = sorted(((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got), key=key)
    for g, w in zip(found, sorted(((d, held(d), *want[i]) for i, (d, _) in enumerate(rows)), key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6
    assert len({g.score for g in got if g.doc_id == 3 or (g.doc_id or 0) >= 300}) == 1


def test_answers_to_other_batches_are_noticed():
    def table(asks, answers):
        text = np.zeros(2, lm._TEXT)
        own = (0, lm._TEXTS, 7, text, np.array([asks]))
        return pa.Table.from_batches([lm._rows([own, *answers])])

    answer = (1, lm._ASK, 7, lm._steps(np.array([1])), np.array([-0.5]))
    assert lm._finished(4)(table(1, [answer])).column("score").to_pylist() == [0.0, -0.5]
    with pytest.raises(RuntimeError):
        lm._finished(4)(table(2, [answer]))


def test_places_by_leading_bits():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 300, 5000):
        known = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
        keys = np.concatenate([known, r.integers(0, 2**64 - 1, 1000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (lm.Places(known)(keys) == lm._lookup(known, keys)).all()
    crowded = np.arange(500, dtype=np.uint64) * np.uint64(3)
    assert (lm.Places(crowded)(np.arange(1500, dtype=np.uint64)) == lm._lookup(crowded, np.arange(1500, dtype=np.uint64))).all()


def test_language_model_on_awkward_rows(spark):
    df = fx.awkward(spark)
    rows = lm.language_model(df).collect()
    assert len(rows) == df.count()
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (900, 901, 902))
    a, b = (r for r in rows if r.doc_id == 904)
    assert a == b
    assert lm.language_model(fx.empty(spark)).count() == 0


def test_probabilities_of_a_history_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a b d", "a b c", "b c a b c a", "a a b c d", "d a b"] * 3)]
    model, _ = lm.fit_automaton(spark.createDataFrame(rows, "doc_id long, text string"))
    low = (1 << 20) - 1
    assert len(model.arc_keys) and len(model.pair_keys)
    arcs = {(int(k) >> 20, int(k) & low): 10**v for k, v in zip(model.arc_keys, model.arc_logs, strict=True)}
    root = {i: 10 ** model.root[lm._lookup(model.held, model.names[i : i + 1])[0]] for i in range(len(model.names)) if model.names[i] != np.uint64(lm.BEGIN)}

    def p(state, word):
        if state == 0:
            return root[word]
        return arcs[state, word] if (state, word) in arcs else 10 ** model.fail_log[state] * p(int(model.fail_state[state]), word)

    unknown = 10 ** -math.log10(model.total + model.types + 1)
    for state in range(len(model.fail_state)):
        rest, s = unknown, state
        while s:
            rest, s = rest * 10 ** model.fail_log[s], int(model.fail_state[s])
        assert abs(sum(p(state, w) for w in root) + rest - 1) < 1e-9
