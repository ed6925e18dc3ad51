import re

import fixtures as fx
import numpy as np
import pyarrow as pa

from gridwright.llm import linededup as ld
from gridwright.llm.textblocks import blocks


def plain_lines(text):
    """(begin, end, key, words) of each line, in code points."""
    out, last, stop = [], None, False
    for m in fx.WORD.finditer(text or ""):
        new = last is None or "\n" in text[last:m.start()] or stop
        if new:
            out.append([m.start() if out else 0, m.end(), m.start(), 1])
        else:
            out[-1][1], out[-1][3] = m.end(), out[-1][3] + 1
        last, stop = m.end(), re.search(r"(^|[^.!?])[.!?]$", m[0]) is not None
    begins = [x[0] for x in out] + [len(text or "")]
    return [(b, begins[i + 1], fx.lower(text[s:e]), n) for i, (b, e, s, n) in enumerate(out)]


def brute(rows):
    """Removed code points of each document: every selected gram against its first place, extended line by line."""
    docs = [(d, plain_lines(t)) for d, t in sorted(rows)]
    first, marks = {}, []
    for d, lines in docs:
        raw = "\n".join(k for _, _, k, _ in lines)
        hashes = {k: h for k, h in _hashes(raw, [k for _, _, k, _ in lines])}
        h = np.array([hashes[k] for _, _, k, _ in lines], np.uint64)
        count = np.array([n for *_, n in lines], np.int64)
        at, size = ld.selected(h, np.zeros(len(h), np.int64), count)
        for a, n in sorted(zip(at.tolist(), size.tolist(), strict=True)):
            key = (n, tuple(k for _, _, k, _ in lines[a : a + n]))
            first.setdefault(key, (d, a))
            marks.append((d, a, key))
    table = dict(docs)
    gone = {d: set() for d, _ in docs}
    for d, a, key in marks:
        d0, a0 = first[key]
        if (d, a) == (d0, a0):
            continue
        x, y = table[d], table[d0]
        low = high = 0
        while a - low > 0 and a0 - low > 0 and x[a - low - 1][2] == y[a0 - low - 1][2]:
            low += 1
        while a + high < len(x) and a0 + high < len(y) and x[a + high][2] == y[a0 + high][2]:
            high += 1
        if sum(n for *_, n in x[a - low : a + high]) >= ld.MIN_WORDS:
            gone[d].update(range(x[a - low][0], x[a + high - 1][1]))
    return gone


def _hashes(raw, keys):
    for k in keys:
        (_, _, data, offs), = blocks(pa.array([k]))
        yield k, ld.lines(data, offs)[2][0] if len(ld.lines(data, offs)[2]) == 1 else 0


def rows_with_repeats():
    r = fx.rng()
    passage, other, line = fx.text(r, 8), fx.text(r, 4), fx.sentence(r, 25)
    out = []
    for i in range(30):
        own = [fx.text(r, r.randint(1, 5)) for _ in range(3)]
        own.insert(r.randint(0, 3), passage if i % 3 == 0 else line if i % 5 == 0 else fx.sentence(r))
        if i % 4 == 0:
            own.append(other)
        out.append((i, r.choice(["\n", " "]).join(own)))
    out.append((40, "\n".join([fx.sentence(r, 12)] * 9)))
    out.append((41, "É ü.\n" + passage.upper() + "\n漢 😀 end"))
    return out, passage


def test_matches_brute_force(spark):
    rows, passage = rows_with_repeats()
    want = brute(rows)
    out = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        gone = {i for s in out[d]._removed for i in range(s.s, s.e)}
        assert gone == want[d], d
        assert out[d].text == "".join(c for i, c in enumerate(t) if i not in gone)
    core = passage[passage.index(". ") + 2 :].lower()
    assert sum(core in fx.lower(r.text) for r in out.values()) == 1


def test_any_long_enough_run_has_a_common_fingerprint():
    r = np.random.default_rng(2)
    run = r.integers(0, 1 << 60, ld.GRAM + ld.WINDOW - 1).astype(np.uint64)
    for _ in range(200):
        found = []
        for _ in range(2):
            head, tail = r.integers(0, 5, 2)
            h = np.concatenate([r.integers(0, 1 << 60, head).astype(np.uint64), run, r.integers(0, 1 << 60, tail).astype(np.uint64)])
            at, size = ld.selected(h, np.zeros(len(h), np.int64), np.full(len(h), 5))
            found.append({(a - head) for a in at.tolist() if head <= a and a + ld.GRAM <= head + len(run)})
        assert found[0] & found[1]


def test_clean_documents_stay(spark):
    r = fx.rng()
    rows = [(i, fx.text(r, 6) + "\nOf.\nThe end.\n" + fx.text(r, 2)) for i in range(20)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in out} == dict(rows)


def test_awkward_rows(spark):
    df = fx.awkward(spark, [(1, fx.LONG)])
    out = ld.dedup_lines(df)
    assert out.columns == [*df.columns, "_removed", "_emptied"]
    rows = out.collect()
    assert len(rows) == df.count()
    by = {(r.doc_id, r.k): r for r in rows}
    assert by[900, 1].text is None and by[901, 2].text == "" and not by[902, 3]._emptied
    assert by[903, 4].text == "" and by[903, 4]._emptied  # one line, first in document 1
    assert all(r.text is not None for r in rows if r.doc_id == 904)
    assert ld.dedup_lines(fx.empty(spark)).count() == 0


def test_lines_of_plain_python_agree():
    r = fx.rng()
    for _ in range(50):
        t = re.sub(" ", lambda m: r.choice([" ", " ", "\n", "  \n", "\t", "!! ", "? ", " . "]), fx.text(r, 5))
        (_, _, data, offs), = blocks(pa.array([t]))
        begin, _, _, count = ld.lines(data, offs)
        assert begin.tolist() == [b for b, *_ in plain_lines(t)] and count.tolist() == [n for *_, n in plain_lines(t)]
