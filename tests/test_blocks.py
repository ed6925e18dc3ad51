"""Pairs by blocks: every pair once, at sizes where no list of all rows is made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import joins, semantics
from gridwright.plans import blocks


def metadata(spark, n):
    """Blocks of made-up columns; every 50th has the numbers of the one before."""
    i = F.col("id") - F.when(F.col("id") % 50 == 49, 1).otherwise(0)
    cell = lambda salt, m: F.array(*[(F.pmod(F.xxhash64(i, F.lit(salt), F.lit(j)), F.lit(1000)) / 500 - 1) for j in range(m)])
    return spark.range(0, n, 1, 8).select(
        F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("column"), F.concat(F.lit("d"), (i % 5).cast("string")).alias("domain"),
        F.array(*[F.pmod(F.xxhash64(i, F.lit(j)), F.lit(2)).cast("int") for j in range(8)]).alias("patterns"),
        cell("n", 16).alias("name_block"), cell("s", 12).alias("stats_block"), cell("t", 5).alias("type_block"), cell("d", 8).alias("dist_block"),
    )


def plain(rows, pick):
    """Combined scores of the picked columns against all, by numpy."""
    wide = lambda c: np.array([r[c] for r in rows])
    whole = np.concatenate([wide(c) for c in ("name_block", "stats_block", "type_block", "dist_block")], axis=1)
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    domain, patterns = wide("domain"), wide("patterns")
    return 0.6 * unit[pick] @ unit.T + 0.3 * (domain[pick][:, None] == domain[None]) + 0.1 * (patterns[pick][:, None] == patterns[None]).mean(axis=2)


def test_best_partners_of_twenty_thousand_columns(spark):
    df = metadata(spark, 20_000)
    found = {}
    for r in semantics.most_similar(df, 3, score="combined_similarity").collect():
        found.setdefault(r["column_a"], []).append((r["rank"], r["column_b"], r["combined_similarity"]))
    assert len(found) == 20_000 and all(len(v) == 3 for v in found.values())
    rows = df.collect()
    pick = list(range(0, 20_000, 401))
    scores = plain(rows, pick)
    scores[np.arange(len(pick)), pick] = -np.inf
    for i, s in zip(pick, scores, strict=True):
        want = sorted(range(len(rows)), key=lambda j: (-round(s[j], 12), rows[j]["column"]))[:3]
        assert [(k, rows[j]["column"]) for k, j in enumerate(want, 1)] == [x[:2] for x in sorted(found[rows[i]["column"]])]
        assert [x[2] for x in sorted(found[rows[i]["column"]])] == pytest.approx([s[j] for j in want], abs=1e-9)


def test_all_pairs_of_some_columns(spark, monkeypatch):
    monkeypatch.setattr(blocks.packed, "__defaults__", (7,))
    df = metadata(spark, 60)
    rows = sorted(df.collect(), key=lambda r: r["column"])
    got = {(r["column_a"], r["column_b"]): r["combined_similarity"] for r in semantics.similarities(df).collect()}
    want = plain(rows, list(range(60)))
    assert len(got) == 60 * 59
    assert all(got[rows[i]["column"], rows[j]["column"]] == pytest.approx(want[i, j], abs=1e-12) for i in range(60) for j in range(60) if i != j)
    other = metadata(spark, 90).where("column >= 'c000060'")
    assert semantics.similarities(df, other).count() == 60 * 30 and semantics.most_similar(df, 2, other).count() == 120
    assert semantics.similarities(df.limit(0)).count() == 0


def test_domain_pairs_beyond_a_block(spark):
    names = spark.range(3000).select(F.concat(F.lit("n"), (F.col("id") % 1500).cast("string")).alias("d"))
    pairs = joins.domain_pairs(names.unionAll(spark.createDataFrame([(None,)], "d string")), "d")
    assert pairs.count() == 1500 * 1499 and pairs.distinct().count() == 1500 * 1499
