import fixtures as fx

from gridwright.llm import decontam as dc


def edit_distance(pattern, text):
    """Least distance of the pattern to a part of the text, by the full matrix."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


def test_myers_is_the_edit_distance():
    r = fx.rng()
    for _ in range(300):
        p, t = ("".join(r.choice("abé") for _ in range(r.randint(a, b))) for a, b in ((1, 80), (0, 90)))
        assert dc.least_distance(p, t)[0] == edit_distance(p, t)


def test_pieces_cover_the_item():
    for n in (1, 23, 24, 81, 400):
        item = "x" * n
        assert "".join(p for _, p in dc.pieces(item)) == item and len(dc.pieces(item)) == dc.budget(item) + 1


def planted():
    r = fx.rng()
    items = [(i, fx.text(r, r.randint(1, 5))) for i in range(25)] + [(50, "short item"), (51, None), (52, ""), (None, fx.text(r, 3))]
    docs, want = [], {}
    for n in range(150):
        name, item = items[r.randrange(25)]
        body = list(dc.normal(item))
        limit = dc.budget(dc.normal(item))
        for _ in range(limit + (0 if n % 3 else limit + 2)):
            at = r.randrange(len(body))
            kind = r.randint(0, 2)
            if kind == 0:
                body[at] = r.choice("xyzé")
            elif kind == 1:
                body.insert(at, r.choice("xyz "))
            else:
                body.pop(at)
        shown = "".join(body)
        docs.append((n, fx.text(r, 3) + " " + (shown.upper() if n % 5 == 0 and shown.isascii() else shown.replace(" ", "\n  ")) + " " + fx.text(r, 2)))
    for n, t in docs:
        whole = dc.normal(t)
        want[n] = {i for i, x in items[:25] if edit_distance(dc.normal(x), whole) <= dc.budget(dc.normal(x))}
    return items, docs, want


def test_matches_brute_force(spark, monkeypatch):
    items, docs, want = planted()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in dc.decontaminate(a, b).collect()}
    assert {d: set(r.item_ids) for d, r in out.items()} == want
    assert 90 < sum(map(bool, want.values())) < 150
    monkeypatch.setattr(dc, "ITEM_BLOCK", 7)  # several passes
    again = {r.doc_id: set(r.item_ids) for r in dc.decontaminate(a, b).collect()}
    assert again == want
    assert sorted(r.doc_id for r in dc.clean_documents(a, b).collect()) == sorted(d for d, w in want.items() if not w)


def test_documents_with_items_inside(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.doc_id: dc.normal(r.text) for r in docs.collect()}
    held = {d for d, t in texts.items() if any(dc.normal(i.text) in t for i in items.collect())}
    out = {r.doc_id for r in dc.decontaminate(docs, items).collect() if r.contaminated}
    assert held and held <= out


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "twice the SAME row  stands here, word by word."), (1, "twice the SAME row  stands here, word by word."), (2, "tie"), (3, "ie ti"), (4, None), (5, " ")], "item_id long, text string")
    df = fx.awkward(spark)
    out = dc.decontaminate(df, items).collect()
    assert len(out) == df.count()
    assert sorted((r.doc_id, tuple(r.item_ids)) for r in out if r.contaminated) == [(904, (1,)), (904, (1,)), (906, (2,)), (907, (2,))]
    clean = dc.clean_documents(df, items)
    assert clean.columns == df.columns and clean.count() == df.count() - 4
    assert dc.decontaminate(fx.empty(spark), items).count() == 0
    assert dc.clean_documents(df, items.limit(0)).count() == df.count()
