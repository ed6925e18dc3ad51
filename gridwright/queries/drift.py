"""Drift between early and late orders, and table comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import drift
from gridwright.queries.base import query, rounded, table, union_sql

CUT = "1998-01-01"
COLS = "o_totalprice, o_custkey, o_orderstatus, o_orderpriority"
_A = f"(SELECT {COLS} FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}')"
_B = f"(SELECT {COLS} FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}')"


def halves(spark, sf):
    t = table(spark, sf, "orders")
    cut = F.lit(CUT).cast("timestamp_ntz")
    cols = ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return t.where(F.col("o_orderdate") < cut).select(*cols), t.where(F.col("o_orderdate") >= cut).select(*cols)


def _shares(c):
    return f"""(SELECT coalesce(a.v, b.v) AS v, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM
      (SELECT {c} AS v, count(*)::DOUBLE / (SELECT count(*) FROM {_A}) AS p FROM {_A} GROUP BY 1) a FULL JOIN
      (SELECT {c} AS v, count(*)::DOUBLE / (SELECT count(*) FROM {_B}) AS q FROM {_B} GROUP BY 1) b ON a.v = b.v)"""


def _js(c):
    return f"""SELECT '{c}' AS "column", round(sqrt(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS score FROM {_shares(c)}"""


def _ks(c):
    return f"""SELECT '{c}' AS "column", round(max(abs(fa - fb)), 6) AS score FROM (
      SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM (
        SELECT v, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (SELECT {c} AS v, 1 AS a, 0 AS b FROM {_A} UNION ALL SELECT {c}, 0, 1 FROM {_B}) GROUP BY v))"""


_CATS = ["o_orderstatus", "o_orderpriority"]
_NUMS = ["o_totalprice", "o_custkey"]


@query("drf1_jensen_shannon", union_sql(_js(c) for c in _CATS))
def drf1(spark, sf):
    return rounded(drift.jensen_shannon(*halves(spark, sf), _CATS))


@query("drf2_half_l1", union_sql(f"""SELECT '{c}' AS "column", round(sum(abs(p - q)) / 2, 6) AS score FROM {_shares(c)}""" for c in _CATS))
def drf2(spark, sf):
    return rounded(drift.half_l1(*halves(spark, sf), _CATS))


@query("drf3_kolmogorov_smirnov", union_sql(_ks(c) for c in _NUMS))
def drf3(spark, sf):
    return rounded(drift.kolmogorov_smirnov(*halves(spark, sf), _NUMS))


@query(
    "drf4_mean_shift",
    union_sql(
        f"""SELECT '{c}' AS "column", round(abs((SELECT avg({c}) FROM {_A}) - (SELECT avg({c}) FROM {_B})) / ((SELECT stddev_samp({c}) FROM {_A}) + 1e-8), 6) AS score"""
        for c in _NUMS
    ),
)
def drf4(spark, sf):
    return rounded(drift.mean_shift(*halves(spark, sf), _NUMS))


_ALL = "(" + union_sql([_js(c) for c in _CATS] + [_ks(c) for c in _NUMS]) + ")"


@query(
    "drf5_summary",
    f"""SELECT count(*) AS n_columns, sum((score > 0.01)::INT)::BIGINT AS n_drifted, 100.0 * sum((score > 0.01)::INT) / count(*) AS drifted_pct, max(score) AS max_score,
    round(avg(score), 5) AS mean_score, coalesce(string_agg("column", ',' ORDER BY "column") FILTER (score > 0.01), '') AS drifted_columns FROM {_ALL}""",
)
def drf5(spark, sf):
    out = rounded(drift.drift_summary(drift.detect_drift(*halves(spark, sf), threshold=0.01)))
    return out.withColumn("mean_score", F.round("mean_score", 5))


def _moments(c):
    return [
        f"""SELECT 'mean_difference' AS item, '{c}' AS "column", (SELECT avg({c}) FROM {_B}) - (SELECT avg({c}) FROM {_A}) AS value""",
        f"""SELECT 'std_difference', '{c}', (SELECT stddev_samp({c}) FROM {_B}) - (SELECT stddev_samp({c}) FROM {_A})""",
    ]


@query(
    "cmp1_compare",
    f"""SELECT item, "column", round(value, 4) AS value FROM (SELECT 'only_in_first' AS item, 'o_custkey' AS "column", 1.0::DOUBLE AS value
    UNION ALL SELECT 'only_in_second', 'extra', 1 UNION ALL SELECT 'n_columns_first', '', 4 UNION ALL SELECT 'n_columns_second', '', 4
    UNION ALL SELECT 'n_common', '', 3 UNION ALL SELECT 'n_rows_first', '', count(*) FROM {_A} UNION ALL SELECT 'n_rows_second', '', count(*) FROM {_B} UNION ALL """
    + union_sql(
        [f"""SELECT 'unique_difference', '{c}', (SELECT count(DISTINCT {c}) FROM {_B}) - (SELECT count(DISTINCT {c}) FROM {_A})""" for c in ["o_totalprice", *_CATS]]
        + _moments("o_totalprice")
        + [f"""SELECT 'drift', "column", score FROM ({s})""" for s in (_js(_CATS[0]), _js(_CATS[1]), _ks("o_totalprice"))]
    )
    + ")",
)
def cmp1(spark, sf):
    a, b = halves(spark, sf)
    return rounded(drift.compare_tables(a, b.withColumnRenamed("o_custkey", "extra")), 4)
