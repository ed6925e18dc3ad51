"""Whitening against exact fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest
from fixtures import rng

from gridwright.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n long, y string, component string, whitened int"


def frame(spark, rows):
    """With extra columns of clashing names."""
    return spark.createDataFrame([(i, v, 1, "y", "c", 2) for i, v in rows], SCHEMA)


def fixed(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def check(rows, found, dims):
    """Everything of the contract, from whole numbers and fractions."""
    x = [fixed(v) for _, v in rows]
    n, k = len(x), min(32, dims)
    sums = [sum(c) for c in zip(*x, strict=True)]
    cov = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    plain = (np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums, strict=True)] for r in x]) @ vectors) / np.sqrt(values)
    assert len(found) == n
    for (i, _), r, p in zip(rows, x, plain, strict=True):
        got = found[i]
        assert sorted(got) == list(range(1, k + 1))
        deviation = sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))
        for c in range(k):
            g = got[c + 1]
            assert (g["n"], g["deviation"]) == (n, deviation)
            assert g["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
            assert abs(g["whitened"]) == pytest.approx(abs(p[c]), rel=1e-6, abs=1e-6)
            assert 0 <= g["identity_error"] < 1e-9
    white = np.array([[found[i][c + 1]["whitened"] for c in range(k)] for i, _ in rows])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(k)).max() < 1e-9


def test_equals_the_plain_form(spark):
    r = rng()
    rows = [(i, [r.gauss(0, 0.1 + 0.05 * j) + 0.3 * (j % 3) * math.sin(i) for j in range(6)]) for i in range(300)]
    df = wh.whiten(frame(spark, rows).repartition(5))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    check(rows, by_row(df), 6)


def test_more_dimensions_than_components(spark):
    r = rng()
    rows = [(i, [r.gauss(0, 1) for _ in range(40)]) for i in range(120)]
    check(rows, by_row(wh.whiten(frame(spark, rows))), 40)


def exact_charpoly(m):
    """Faddeev and LeVerrier in fractions."""
    n, c, b = len(m), [Fraction(0)] * (len(m) + 1), [[Fraction(0)] * len(m) for _ in m]
    c[n] = Fraction(1)
    for k in range(1, n + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(n)) + (c[n - k + 1] if i == j else 0) for j in range(n)] for i in range(n)]
        c[n - k] = -Fraction(sum(m[i][t] * b[t][i] for i in range(n) for t in range(n)), k)
    return [int(x) for x in c]


def gram(rows):
    return [[sum(r[i] * r[j] for r in rows) for j in range(len(rows[0]))] for i in range(len(rows[0]))]


@pytest.mark.parametrize("case", ["random", "deficient", "large", "diagonal", "zeros inside"])
def test_polynomial_is_exact(spark, case):
    r = rng()
    rows = [[r.randint(-9, 9) * (10**15 if case == "large" else 1) for _ in range(7)] for _ in range(4 if case == "deficient" else 12)]
    m = gram(rows)
    if case == "diagonal":
        m = [[(i // 3 + 1) * (i == j) for j in range(7)] for i in range(7)]
    if case == "zeros inside":
        for i in (2, 4):
            for j in range(7):
                m[i][j] = m[j][i] = 0
    assert wh.charpoly(spark, m) == exact_charpoly(m)


def test_roots_with_multiplicity():
    poly = [1]
    roots = [0, 0, 2, 2, 2, 5, 9]
    for root in roots:
        poly = [(poly[i - 1] if i else 0) - root * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [wh.roots_above(poly, t, 0) for t in (-1, 0, 1, 2, 5, 9)] == [7, 5, 5, 2, 1, 0]
    assert wh.roots_above(poly, 9, 1) == 2  # above 4.5
    units = [wh.isolate(poly[2:], k) + 1 for k in range(1, 6)]
    assert units == [x << wh.ROOT_BITS for x in (9, 5, 2, 2, 2)]
    golden = wh.isolate([1, -3, 1], 1)
    assert abs((golden + 1) / 2**wh.ROOT_BITS - (3 + math.sqrt(5)) / 2) < 1e-15


def test_equal_eigenvalues_share_a_space(spark):
    rows = [(2 * j + s, [float((i == j) * (1 - 2 * s)) for i in range(5)]) for j in range(5) for s in (0, 1)]
    found = by_row(wh.whiten(frame(spark, rows)))
    white = np.array([[found[i][c + 1]["whitened"] for c in range(5)] for i, _ in rows])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(5)).max() < 1e-12
    assert {round(found[i][c + 1]["explained"], 12) for i, _ in rows for c in range(5)} == {0.2}


def test_awkward_rows(spark):
    good = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (None, [0.1, 0.2, 0.3]), (4, [-3.0, 0.0, 2.0]), (5, [0.0, 9.0, 2.0]), (6, [1.0, 1.0, 1.0])]
    bad = [(7, None), (8, []), (9, [float("nan"), 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0]), (11, [None, 1.0, 2.0]), (12, [1.0, 2.0])]
    rows = wh.whiten(frame(spark, good + bad)).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in rows) == sorted((i or -1, c) for i, _ in good for c in (1, 2, 3))
    assert {r["n"] for r in rows} == {6} and max(r["identity_error"] for r in rows) < 1e-9
    assert wh.whiten(frame(spark, [])).collect() == [] and wh.whiten(frame(spark, bad[:4])).collect() == []


def test_without_variance(spark):
    one = wh.whiten(frame(spark, [(3, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = by_row(wh.whiten(frame(spark, [(i, [7.0, float(i), 7.0]) for i in range(9)])))
    assert all(r[1]["whitened"] is not None and r[2]["whitened"] is None and r[3]["explained"] == 0.0 for r in flat.values())


def test_large_entries(spark):
    """Beyond what doubles add exactly, and beyond what a long holds."""
    r = rng()
    rows = [(i, [r.uniform(-1e9, 1e9), r.uniform(-1, 1)]) for i in range(50)]
    found = by_row(wh.whiten(frame(spark, rows)))
    x = [fixed(v) for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((50 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    assert {i: f[1]["deviation"] for i, f in found.items()} == {i: d if d < 2**63 else None for i, d in want.items()}
    assert all(f[2]["identity_error"] < 1e-6 for f in found.values())
    extreme = wh.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(extreme) == 6 and all(r["whitened"] is not None for r in extreme)


def test_exact_sums_by_limbs():
    block = np.array([[2**62, -(2**62)], [12345678901234567, -1]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in block) for j in range(2)] for i in range(2)]
    assert wh._gram(block, 2**62).tolist() == want
