"""Statistics against enumeration and numpy."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from gridwright.operators import profile, ranking, significance
from gridwright.plans import comoments


@pytest.fixture(scope="module")
def wide():
    """300 columns with offsets, missing cells, a constant one and one without a value."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 300)) + r.normal(size=(400, 1)) + np.arange(300) * 1e4
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 11] = 3.3e8 / 7, np.nan
    return pd.DataFrame(x, columns=[f"c{i:03d}" for i in range(300)])


def test_correlations_of_many_columns(spark, wide):
    df = spark.createDataFrame(wide).repartition(6)
    found = profile.correlations(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in found.collect()}
    want = wide.corr().to_numpy()
    assert len(got) == 300 * 299 // 2
    for (a, b), v in got.items():
        i, j = int(a[1:]), int(b[1:])
        if 11 in (i, j):
            assert v is None
        elif 7 in (i, j):
            assert math.isnan(v)
        else:
            assert v == pytest.approx(want[i, j], abs=1e-9)


def test_pairs_by_tiles(spark, wide):
    df = spark.createDataFrame(wide.iloc[:, 12:52])
    key = lambda rows: sorted((r["a"], r["b"], r["n"], round(r["sab"], 4), round(r["saa"], 4), round(r["sa"], 4)) for r in rows)
    assert key(comoments.pair_sums(df, df.columns, tile=16).collect()) == key(comoments.pair_sums(df, df.columns).collect())


def test_cosines(spark, wide):
    df = spark.createDataFrame(wide.iloc[:, :20])
    x = wide.iloc[:, :20].fillna(0).to_numpy()
    size = np.linalg.norm(x, axis=0)
    for r in profile.column_cosines(df).collect():
        i, j = int(r["column_a"][1:]), int(r["column_b"][1:])
        want = x[:, i] @ x[:, j] / (size[i] * size[j]) if size[i] * size[j] else 0.0
        assert i <= j and r["cosine"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 5, 9, 13])
def test_signed_ranks_by_enumeration(spark, n):
    r = random.Random(n)
    d = [(i + 1) * 1.7 * r.choice([-1, 1]) for i in range(n)]
    sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
    w = min(sum(k for k, x in enumerate(d, 1) if x > 0), sum(k for k, x in enumerate(d, 1) if x < 0))
    want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
    got = significance.wilcoxon(spark.createDataFrame([(x, 0.0) for x in d], "a double, b double"), "a", "b")
    assert (got["statistic"], got["n"]) == (w, n) and got["p_value"] == pytest.approx(want, rel=1e-12)


def test_signed_ranks_beyond_the_exact_number(spark):
    """The approximation takes over, and is near the exact value there; ties and zeros are approximated at any number."""
    big = significance.wilcoxon(spark.createDataFrame([(float(i * (-1) ** (i % 3)), 0.0) for i in range(1, 52)], "a double, b double"), "a", "b")
    assert big["n"] == 51 and big["p_value"] == pytest.approx(2 * significance.signed_rank_tail(51, int(big["statistic"])), rel=0.05)
    tied = significance.wilcoxon(spark.createDataFrame([(1.0, 0.0), (1.0, 0.0), (-2.0, 0.0), (3.0, 0.0)], "a double, b double"), "a", "b")
    assert tied["p_value"] not in [k / 16 for k in range(17)]


def test_gains_of_ties_are_averaged(spark):
    """The mean over all orders of the rows that share a score."""
    rows = [("q", i, s, r) for i, (s, r) in enumerate([(3, 0), (3, 2), (2, 1), (1, 3), (1, 0), (1, 1)])] + [("p", 0, 1, 0), ("p", 1, 1, 0)]
    df = ranking.ranked(spark.createDataFrame(rows, "q string, k long, s long, rel long"), "q", "s", "rel", "k")
    for k in (1, 2, 3, 4, 6, 9):
        orders = [o for o in itertools.permutations(rows[:6]) if all(a[2] >= b[2] for a, b in zip(o, o[1:], strict=False))]
        dcg = np.mean([sum(x[3] / math.log2(p + 2) for p, x in enumerate(o[:k])) for o in orders])
        best = sum(x / math.log2(p + 2) for p, x in enumerate(sorted((r[3] for r in rows[:6]), reverse=True)[:k]))
        assert ranking.ndcg(df, "q", "rel", k, "s").first()["ndcg"] == pytest.approx(dcg / best / 2, rel=1e-12)
