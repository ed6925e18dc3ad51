import hashlib
import math
import os
import re
import sys
import time
from collections import Counter, defaultdict

import fixtures as fx
import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle import compare, connect  # noqa: E402

from gridwright.llm import dom, htmltext, mixing, pii, topk  # noqa: E402
from gridwright.llm.queries import load  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) == ""


def test_a_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# exact top-k


def brute_top(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got_top(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


@pytest.mark.parametrize("span", [1, 40, 2**30])
def test_top_k_with_ties_and_many_blocks(spark, monkeypatch, span):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    monkeypatch.setattr(topk, "BINS", 8)
    r = fx.rng()
    same = [r.randint(-span, span) for _ in range(4)]
    rows = [(i, same if i % 3 == 0 else [r.randint(-span, span) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    assert got_top(topk.top_k(df, df.where("id % 20 = 0"), 7)) == brute_top(rows, rows[::20], 7)


def test_top_k_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [0.5, -0.5]), (1, [0.51, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (40, [1.0, 1.0]), (6, []), (None, [1.0, 2.0]), (1, [0.51, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    good = df.where(topk.usable("embedding")).select(F.col("vec_id").alias("id"), topk.whole("embedding").alias("v"))
    assert got_top(topk.top_k(good, good.where("id % 20 = 0"))) == {20: [(1, 32 * 32), (1, 32 * 32), (40, 0)], 40: [(1, 32 * 64), (1, 32 * 64), (20, 0)]}
    assert topk.top_k(good.limit(0), good.limit(0)).count() == 0 and topk.top_k(good, good.limit(0)).count() == 0
    one = good.where("id = 20")
    assert topk.top_k(one, one).count() == 0


def test_top_k_keeps_every_row_of_an_id(spark, monkeypatch):
    """Different vectors of one id all count; a query that is there twice is asked once; other lengths take no part."""
    monkeypatch.setattr(topk, "BLOCK", 50)
    rows = [(1, [5, 0]), (1, [9, 0]), (20, [1, 0]), (20, [3, 7]), (2, [4, 4]), (3, [1, 2, 3]), (40, [1]), *((7, [i, 0]) for i in range(500))]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.top_k(df, df.where("id % 20 = 0"), 504).collect()
    scores = sorted(((r["score"], r["vec_id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert {r["query_id"] for r in got} == {20}
    assert scores == sorted([(5, 1), (9, 1), (4, 2), *((i, 7) for i in range(500))], key=lambda x: (-x[0], x[1]))
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 504))


@pytest.mark.parametrize("span, dims, k", [(40, 1, 3), (1, 5, 7), (2**13, 5, 90), (2**30, 5, 7)])
def test_top_k_over_many_groups(spark, monkeypatch, span, dims, k):
    """Groups of a few rows, also fewer than k; vectors of one component; ids of both signs, one of them often."""
    monkeypatch.setattr(topk, "GROUP_BYTES", 200)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    grid = []
    monkeypatch.setattr(topk, "_grid", lambda *x, f=topk._grid: grid.append(f(*x)) or grid[-1])
    r = fx.rng()
    same = [r.randint(-span, span) for _ in range(dims)]
    rows = [(40 if i % 9 == 0 else i - 150, same if i % 3 == 0 else [r.randint(-span, span) for _ in range(dims)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    queries = {i: v for i, v in sorted(rows, reverse=True) if i % 20 == 0}
    assert got_top(topk.top_k(df, df.where("id % 20 = 0"), k)) == brute_top(rows, queries.items(), k)
    assert grid[0][1] > 10


def test_top_k_scores_wrap_beyond_64_bits():
    q, c = np.array([[-(2**63), 1]]), np.array([[1, 2], [3, -5], [2, 7]])
    assert topk._scores(q, c).tolist() == [[-(2**63) + 2, 2**63 - 5, 7]]


def test_top_k_broadcasts_and_collects_nothing(spark, monkeypatch):
    """Copies of blocks were broadcast where the blocks themselves were below the threshold: as many as there are blocks of the other side."""
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(topk, "stored", lambda df, name, put=topk.stored: (plans.append(plan(df)), put(df, name))[1])
    r = fx.rng()
    df = spark.createDataFrame([(i, [r.randint(-99, 99) for _ in range(8)]) for i in range(400)], "id long, v array<long>")
    plans.append(plan(topk.top_k(df, df.where("id % 20 = 0"))))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


# mixing


def test_poisson_counts_and_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 10 < 7, 'big', if(id % 10 = 9, 'none', 'small')) as source", "'x' as text")
    rows = mixing.mix(docs, {"big": 1, "small": 3}, rows=8_000).collect()
    by = Counter(r.source for r in rows)
    assert set(by) == {"big", "small"} and abs(by["small"] / len(rows) - 0.75) < 0.02 and abs(len(rows) - 8_000) < 300
    mean = 6_000 / 4_000
    drawn = Counter(Counter(r.doc_id for r in rows if r.source == "small").values())
    for k in (1, 2, 3):
        assert abs(drawn[k] / 4_000 - math.exp(-mean) * mean**k / math.factorial(k)) < 0.03
    assert all(1 <= r.copy <= r.copies for r in rows)


def test_mixing_draws_texts_of_one_id_apart(spark):
    """A third of the rows has no id and the rate is below one: neither all go nor all stay, and they spread over places."""
    docs = spark.range(3_000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 2 = 0, 'a', 'b') as source", "concat('text ', id) as text")
    rows = mixing.mix(docs, {"a": 0.2, "b": 0.8}).collect()
    none = [r for r in rows if r.doc_id is None]
    for source, rate in (("a", 0.4), ("b", 1.6)):
        assert abs(sum(r.source == source for r in none) - 500 * rate) < 5 * math.sqrt(500 * rate)
    assert len({r.position for r in rows}) == len(rows)


def test_mixing_is_repeatable_and_shuffled(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('s', id % 3) as source", "'x' as text")
    a, b = (sorted((r.doc_id, r.copy, r.position) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b
    ids = [r.doc_id for r in mixing.mix(docs).coalesce(1).collect()]
    assert abs(sum(x < y for x, y in zip(ids, ids[1:], strict=False)) / len(ids) - 0.5) < 0.1


def test_mixing_awkward(spark):
    df = fx.awkward(spark)
    out = mixing.mix(df, rows=5_000)
    assert set(out.columns) == {*df.columns, "copies", "copy", "position"}
    assert {r.source for r in out.select("source").distinct().collect()} == {None, "s0", "s1"}
    twice = Counter((r.doc_id, r.copy) for r in out.collect())
    assert set(n for (d, _), n in twice.items() if d == 904) <= {2, 1} and mixing.mix(fx.empty(spark)).count() == 0
    assert mixing.mix(df, {}).count() == 0


def test_distribution_reaches_one():
    for mean in (0.0, 1e-6, 0.7, 30.0, 5_000.0):
        assert abs(mixing._distribution(mean)[-1] - 1) < 1e-9


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(x) * 2 for x in d[-2::-2]]
        return 12 <= len(d) <= 19 and (sum(map(int, d[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


TRICKY = [
    "a@b.c_d@e.f x..y@z.w %@-.-@x.y a@b.c.", "1.2.3.4.5.6.7.8 001.002.003.0004 999.1.1.1 10.0.0.1.", "4111 1111 1111 1111 4111-1111-1111-1112 12345", "5500005555555559, 4111111111111111",
    "+1 (499) 555-6503 ++49 123 456 789- +1 2", "x" * 60_000 + "@", "1" * 60_000, "1 " * 60_000, "@" * 2_000, "+" + "1 " * 30_000, "é😀 mail a.b@c.de, call +44 20 7946 0958 a@b.co",
    "1-2-3-4-5-6-7-8-9-0-1-2", "mail joe [at] example [dot] com or (555) 123-4567", "a.b@c" * 5_000,
]


def test_base_spans_match_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    docs = docs.unionAll(extra).unionAll(fx.awkward(spark).select("doc_id", "text"))
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        options = []
        for t in texts[r.doc_id]:
            spans = base_spans(t)
            counts = Counter(s.split(":")[0] for s in spans)
            options.append(([counts[k] for k in PATTERNS], hashlib.sha256(",".join(spans).encode()).hexdigest()))
            if len(texts[r.doc_id]) == 1:
                assert set(spans) <= set(r.spans.split(",")) | {""}
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) in options, r.doc_id
    assert pii.find_personal_data(fx.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.find_personal_data(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_label_model_finds_the_reliable_labelers():
    r = fx.rng()
    counts = Counter()
    truth = defaultdict(list)
    for _ in range(6_000):
        y = r.random() < 0.3
        vote = lambda right: (1 if y else -1) if r.random() < right else (-1 if y else 1)
        v = (vote(0.95), vote(0.9), vote(0.85) if r.random() < 0.6 else 0, vote(0.55))
        counts[v] += 1
        truth[v].append(y)
    p = pii.label_model(sorted(counts.items()))
    wrong = sum(n * abs(p[v] - sum(truth[v]) / n) for v, n in counts.items()) / 6_000
    assert wrong < 0.05


# pages


def article_text(html):
    import html as h

    m = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", m[1])] if m else []
    return "\n".join(x for x in parts if x)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    rows = htmltext.main_text(pages).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_other_layouts(spark):
    """Layouts of pages the trees have not seen: of the article's blocks and of the others, 98 in 100 are told apart."""
    trees = htmltext.fit_trees(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    parsed = [htmltext.article_blocks(dom.Page(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    every = [t for inside, outside in parsed for t in inside + outside]
    r = fx.rng()
    pages = [dom.Page(h) for i, (a, b) in enumerate(parsed) if a for h in htmltext.training_pages(a, b, r.sample(every, 60), 10**6 + i)]
    p, at, counts = trees.probability(dom.features(pages)), 0, Counter()
    for page in pages:
        kept = set(dom.decode(page, p[at : at + len(page.parent)]))
        at += len(page.parent)
        counts.update((page.label[i] == 1, i in kept) for i, t in enumerate(page.text) if t)
    assert counts[True, True] > 2_000 and counts[True, False] < 0.02 * counts[True, True] and counts[False, True] < 0.02 * counts[False, False]


def test_awkward_pages(spark):
    htmls = [None, "", "   ", "<p", "no markup at all", "<div><p>unclosed <b>bold", "<!-- never closed", "<article></article>", "<p>a&nbsp;b &#65;&bogus; 漢</p>" * 2_000, "</div></p></body>", "<script>x"]
    df = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate([*htmls, htmls[8]])], "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in htmltext.main_text(df).collect()}
    assert len(rows) == df.count() and rows[0].text == rows[1].text == rows[6].text == "" and rows[8].text == rows[11].text
    assert htmltext.main_text(df.limit(0)).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    for name, stage in cp.STAGES:
        out = cp.stored(stage(spark, docs, SF), f"test-{name}")
        if name != "mixing":
            assert out.columns == before and out.dtypes == docs.dtypes
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    assert docs.count() > 50 and cp.run(spark, SF).count() == docs.count()


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp

    fx.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "tie tie tie")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (fx.awkward(spark), fx.empty(spark)):
        docs = start
        for name, stage in cp.STAGES:
            docs = cp.stored(stage(spark, docs, str(tmp_path)), f"awkward-{name}")
            if name != "mixing":
                assert docs.columns == start.columns


# unclosed markup


def page_text(html):
    return "|".join(t for t in dom.Page(html).text if t)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>t</title><p>Article one.</p><p>More.</p></html>", "Article one.|More."),
        ("<html><head><meta charset=x>Loose text<p>More.</p>", "Loose text|More."),
        ("<head><script>x</script><style>y</style></head><body><p>A</p>", "A"),
        ("<head><noscript><p>gone</p></noscript><svg><p>gone</p></svg><p>A</p>", "A"),
        ("<p>Start.</p><button>Go<p>All the rest</p>", "Start.|All the rest"),
        ("<div><video src=x>no video</div><p>Rest</p>", "Rest"),
        ("<p>A</p><button>Go<p>Rest</p><button>Go</button><p>End</p>", "A|Rest|End"),
        ("<div><select><option>x<option>y</div><p>Rest</p><select><option>z</select>", "Rest"),
        ("<p>A <button><div>menu</div></button> b</p>", "A b"),
        ("<noscript><div><p>gone</p></div></noscript><p>A</p>", "A"),
        ("<object><object>gone</object>gone</object><p>A</p>", "A"),
        ("<svg><text>gone</text><p>A</p>", "A"),
        ("<p>A</p><audio>", "A"),
        ("", ""),
    ],
)
def test_unclosed_elements_end_at_blocks(html, text):
    assert page_text(html) == text


def test_many_unclosed_elements_take_linear_time():
    begun = time.time()
    assert page_text("<button>Go<p>x</p>" * 50_000).count("x") == 50_000
    assert time.time() - begun < 20


# personal data in long texts


def test_personal_data_of_a_text_with_many_numbers(spark):
    """200,000 numbers, among them mails, addresses and numbers that overlap others, in seconds; places by Python."""
    parts = [("%d" % (i * 7919 % 100_000)) if i % 50 else ("a%d@b.com" % i if i % 100 else "10.1.2.%d" % (i % 256)) for i in range(200_000)]
    text = " x ".join(parts)
    begun = time.time()
    got = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - begun < 120
    want, at = [], 0
    for i, part in enumerate(parts):
        if i % 50 == 0:
            want.append(f"{'email' if i % 100 else 'ip'}:{at}:{at + len(part)}")
        at += len(part) + 3
    assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and (got.n_email, got.n_ip) == (2_000, 2_000)


def test_added_spans_are_apart(spark):
    """The two array steps against plain loops: spans clear of the base ones, then the first of overlapping ones."""
    from pyspark.sql import functions as F

    r = fx.rng()
    for n in (0, 1, 3, 700):
        draw = lambda m: [(r.randrange(4), s, s + r.randint(1, 9)) for s in (r.randrange(6 * n + 1) for _ in range(m))]  # noqa: B023, E731
        base, extra = draw(n // 2), draw(n)
        df = spark.createDataFrame([(base, extra)], "base array<struct<kind:int,s:int,e:int>>, extra array<struct<kind:int,s:int,e:int>>")
        df = df.withColumn("extra", F.expr(f"if(size(extra) = 0, extra, {pii._apart()})"))
        got = [tuple(x) for x in df.withColumn("extra", F.expr(f"if(size(extra) < 2, extra, {pii._FIRST})")).first().extra]
        want, last = [], -1
        for k, s, e in sorted((x for x in extra if not any(b[1] < x[2] and x[1] < b[2] for b in base)), key=lambda x: (x[1], x[0], x[2])):
            if s >= last:
                want.append((k, s, e))
                last = e
        assert got == want
