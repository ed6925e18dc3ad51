"""Column semantics over the schemas and contents of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import semantics as sem
from gridwright.queries.base import query, rounded, table, union_sql

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations"]
_COLS = "(" + union_sql(f"""SELECT '{n}' AS "table", column_name AS "column" FROM (DESCRIBE {n})""" for n in NAMES) + ")"


def _frame(spark, sf):
    return sem.columns_frame(spark, {n: table(spark, sf, n) for n in NAMES})


def _score_sql(col: str) -> dict[str, str]:
    return {
        d: "(" + " + ".join(f"contains(lower({col}), '{w}')::INT" for w in words) + f") / {len(words)}::DOUBLE"
        for d, words in sem.DOMAINS.items()
    }


def _domain_sql(scores: dict[str, str]) -> tuple[str, str]:
    top = "greatest(" + ", ".join(scores.values()) + ")"
    return "CASE WHEN " + top + " <= 0 THEN 'unknown' " + " ".join(f"WHEN {s} = {top} THEN '{d}'" for d, s in scores.items()) + " END", top


_DOM, _TOP = _domain_sql(_score_sql('"column"'))


@query("sem1_domain", f"""SELECT "table", "column", {_DOM} AS domain, round({_TOP}, 6) AS domain_score FROM {_COLS}""")
def sem1(spark, sf):
    return rounded(sem.with_domain(_frame(spark, sf)))


_MAIL = "(SELECT user_id || '@mail' || (user_id % 7) || '.org' AS contact, CAST(user_id AS VARCHAR) AS amount_text, strftime(ts, '%Y-%m-%d') AS day_text, event_type FROM events)"


def _mail(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        F.concat(u.cast("string"), F.lit("@mail"), (u % 7).cast("string"), F.lit(".org")).alias("contact"), u.cast("string").alias("amount_text"),
        F.date_format("ts", "yyyy-MM-dd").alias("day_text"), "event_type",
    )


@query(
    "sem2_data_patterns",
    union_sql(
        f"""SELECT '{c}' AS "column", avg(regexp_matches({c}, '{sem.EMAIL}')::INT::DOUBLE) AS email, avg(regexp_matches({c}, '{sem.CURRENCY}')::INT::DOUBLE) AS currency,
        avg((regexp_matches({c}, '^\\s*\\d{{4}}(-|\\s*$)') AND try_cast({c} AS TIMESTAMP) IS NOT NULL)::INT::DOUBLE) AS "date" FROM {_MAIL}"""
        for c in ("contact", "amount_text", "day_text", "event_type")
    ),
)
def sem2(spark, sf):
    return rounded(sem.pattern_shares(_mail(spark, sf)))


_BONUS = {"contact": ("identity", 0.5), "amount_text": ("finance", 0.3), "day_text": ("temporal", 0.4), "event_type": (None, 0)}


@query(
    "sem2_domain_with_data",
    union_sql(
        "SELECT '{c}' AS \"column\", {d} AS domain FROM (SELECT count(*) FROM {m})".format(
            c=c, m=_MAIL,
            d=_domain_sql({k: f"({s}" + (f" + {b[1]})" if k == b[0] else ")") for k, s in _score_sql(f"'{c}'").items()})[0],
        )
        for c, b in _BONUS.items()
    ),
)
def sem2_domain(spark, sf):
    df = _mail(spark, sf)
    cols = sem.columns_frame(spark, {"mail": df})
    return sem.with_domain(cols, sem.data_bonus(sem.pattern_shares(df))).select("column", "domain")


def _features_sql(low: str) -> str:
    pats = ", ".join(f"regexp_matches({low}, '{p}')::INT AS {n}_pattern" for n, p in sem.NAME_PATTERNS.items())
    c = '"column"'
    return f"""SELECT "table", {c}, contains({c}, '_')::INT AS has_underscore, regexp_matches({c}, '^.+[A-Z]')::INT AS has_camelcase,
    len(regexp_extract_all({c}, '\\w+'))::INT AS word_count, regexp_matches({c}, '\\d+$')::INT AS numeric_suffix,
    (length({c}) <= 5 AND upper({c}) = {c} AND regexp_matches({c}, '[A-Z]'))::INT AS is_abbreviation, {pats} FROM {_COLS}"""


@query("sem3_name_features", _features_sql('lower("column")'))
def sem3(spark, sf):
    return sem.name_features(_frame(spark, sf))


@query("sem3_split_names", _features_sql("translate(lower(\"column\"), '_', ' ')"))
def sem3_split(spark, sf):
    return sem.name_features(_frame(spark, sf), split_underscore=True)


_SUM = {"user_id": ("numerical", "event_id"), "event_type": ("categorical", ""), "value": ("numerical", ""), "ts": ("datetime", "")}


def _summary_sql() -> str:
    rows = union_sql(
        f"SELECT '{c}' AS \"column\", {_domain_sql(_score_sql(chr(39) + c + chr(39)))[0]} AS domain, '{t[0]}' AS kind, (SELECT count(DISTINCT {c}) FROM events) AS u, (SELECT avg(({c} IS NULL)::INT::DOUBLE) FROM events) AS m"
        for c, t in _SUM.items()
    )
    return f"""WITH r AS ({rows}) SELECT 'n_columns' AS item, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'n_domains', count(DISTINCT domain) FROM r
    UNION ALL SELECT 'n_types', count(DISTINCT kind) FROM r UNION ALL SELECT 'mean_distinct', avg(u) FROM r UNION ALL SELECT 'mean_missing_rate', avg(m) FROM r
    UNION ALL SELECT 'domain:' || domain, count(*) FROM r GROUP BY domain UNION ALL SELECT 'type:' || kind, count(*) FROM r GROUP BY kind
    UNION ALL SELECT 'primary_domain:' || domain, n FROM (SELECT domain, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@query("sem4_schema_summary", _summary_sql())
def sem4(spark, sf):
    return rounded(sem.schema_summary(table(spark, sf, "events"), list(_SUM)))




@query(
    "sem5_statistics",
    union_sql(
        [
            f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(kurtosis({c}), 6) AS kurtosis, 0.0::DOUBLE AS missing,
            round(ln(1 + count(DISTINCT {c})), 6) AS log_distinct FROM lineitem"""
            for c in ("l_quantity", "l_extendedprice")
        ]
        + ["""SELECT 'l_returnflag', 0, 0, 0, 0, round(ln(1 + count(DISTINCT l_returnflag)), 6) FROM lineitem"""]
    ),
)
def sem5(spark, sf):
    v = sem.statistical_vectors(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag"])
    s = F.col("stats")
    return rounded(v.select("column", s[0].alias("mean"), s[1].alias("std"), s[5].alias("kurtosis"), s[6].alias("missing"), s[7].alias("log_distinct")))


def _hist_sql(c: str, bins: int = 32) -> str:
    return f"""SELECT '{c}' AS "column", i::INT AS i, round(coalesce(n, 0) / t / w, 6) AS v FROM (SELECT unnest(range({bins})) AS i) LEFT JOIN (
      SELECT least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS b, count(*)::DOUBLE AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1) ON i = b,
      (SELECT count(*)::DOUBLE AS t, (max({c}) - min({c})) / {bins} AS w FROM lineitem)"""


@query(
    "sem6_distribution",
    union_sql(
        [
            _hist_sql("l_quantity"),
            """SELECT 'l_suppkey_text', i::INT, round(coalesce(n, 0) / sum(n) OVER (), 6) FROM (SELECT unnest(range(32)) AS i) LEFT JOIN (
            SELECT row_number() OVER (ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR)) - 1 AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_suppkey ORDER BY 1 LIMIT 32) ON i = b""",
        ]
    ),
)
def sem6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", F.col("l_suppkey").cast("string").alias("l_suppkey_text"))
    return rounded(sem.distribution_vectors(df).select("column", F.posexplode("dist").alias("i", "v")))


@query(
    "sem7_name_vector",
    f"""SELECT "table", "column", i::INT AS i, CASE WHEN i < 16 THEN round((CAST('0x' || substr(md5("column"), (2 * least(i, 15) + 1)::INT, 2) AS UBIGINT)::DOUBLE - 127.5) / 127.5, 6) ELSE 0 END AS v
    FROM {_COLS}, (SELECT unnest(range(64)) AS i)""",
)
def sem7(spark, sf):
    return rounded(_frame(spark, sf).select("table", "column", F.posexplode(sem.name_vector(F.col("column"))).alias("i", "v")))


_SIM = {"o_totalprice": "numerical", "o_orderkey": "numerical", "o_custkey": "numerical", "o_orderstatus": "categorical", "o_orderpriority": "categorical"}


def _blocks_sql() -> str:
    parts = []
    for c, t in _SIM.items():
        name = "[" + ", ".join(f"(CAST('0x' || substr(md5('{c}'), {2 * i + 1}, 2) AS UBIGINT)::DOUBLE - 127.5) / 127.5" for i in range(16)) + "]"
        if t == "numerical":
            stats = f"(SELECT [avg({c}), stddev_samp({c}), min({c})::DOUBLE, max({c})::DOUBLE, skewness({c}), kurtosis({c}), 0, ln(1 + count(DISTINCT {c}))] FROM orders)"
            dist = "(SELECT list(v ORDER BY i) FROM (" + _hist_sql(c).replace("lineitem", "orders").replace("round(coalesce(n, 0) / t / w, 6)", "coalesce(n, 0) / t / w") + "))"
            kind = "[0, 1, 0, 0, 0]"
        else:
            stats = f"(SELECT [0, 0, 0, 0, 0, 0, 0, ln(1 + count(DISTINCT {c}))] FROM orders)"
            dist = f"""(SELECT list(coalesce(n, 0) / tot ORDER BY i) FROM (SELECT unnest(range(32)) AS i) LEFT JOIN (SELECT row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS b,
              count(*)::DOUBLE AS n FROM orders GROUP BY {c}) ON i = b, (SELECT count(*) AS tot FROM orders))"""
            kind = "[1, 0, 0, 0, 0]"
        pats = "[" + ", ".join(f"regexp_matches('{c}', '{p}')::INT" for p in sem.NAME_PATTERNS.values()) + "]"
        dom = _domain_sql(_score_sql(f"'{c}'"))[0]
        parts.append(f"SELECT '{c}' AS c, {name}::DOUBLE[] AS nb, {stats}::DOUBLE[] AS sb, {kind}::DOUBLE[] AS tb, {dist}::DOUBLE[] AS db, {pats} AS pb, {dom} AS dom")
    return union_sql(parts)


_SIMS = f"""(WITH b AS MATERIALIZED ({_blocks_sql()}) SELECT x.c AS column_a, y.c AS column_b, list_cosine_similarity(x.nb, y.nb) AS name_similarity,
  list_cosine_similarity(x.sb, y.sb) AS statistical_similarity, list_cosine_similarity(x.tb, y.tb) AS type_similarity,
  list_cosine_similarity(x.db, y.db) AS distribution_similarity,
  list_cosine_similarity(x.nb || x.sb || x.tb || x.db, y.nb || y.sb || y.tb || y.db) AS overall_similarity, (x.dom = y.dom)::INT::DOUBLE AS domain_similarity,
  list_sum(list_transform(range(1, 9), lambda i: (x.pb[i] = y.pb[i])::INT)) / 8.0 AS pattern_similarity FROM b x, b y WHERE x.c <> y.c)"""


def _pairs(spark, sf):
    return sem.similarities(sem.column_blocks(table(spark, sf, "orders"), list(_SIM)))


@query(
    "sem8_similarity",
    f"""SELECT column_a, column_b, round(name_similarity, 6) AS name_similarity, round(statistical_similarity, 6) AS statistical_similarity, round(type_similarity, 6) AS type_similarity,
    round(distribution_similarity, 6) AS distribution_similarity, round(overall_similarity, 6) AS overall_similarity FROM {_SIMS}""",
)
def sem8(spark, sf):
    out = _pairs(spark, sf).drop("domain_similarity", "pattern_similarity", "combined_similarity")
    return rounded(out)


@query(
    "sem9_combined",
    f"""SELECT column_a, column_b, domain_similarity, round(pattern_similarity, 6) AS pattern_similarity,
    round(0.6 * overall_similarity + 0.3 * domain_similarity + 0.1 * pattern_similarity, 6) AS combined_similarity FROM {_SIMS}""",
)
def sem9(spark, sf):
    return rounded(_pairs(spark, sf).select("column_a", "column_b", "domain_similarity", "pattern_similarity", "combined_similarity"))


@query(
    "ord3_top_similar",
    f"""SELECT column_a, rank::INT AS rank, column_b, round(combined_similarity, 6) AS combined_similarity FROM (SELECT *, row_number() OVER (PARTITION BY column_a ORDER BY combined_similarity DESC, column_b) AS rank
    FROM (SELECT column_a, column_b, 0.6 * overall_similarity + 0.3 * domain_similarity + 0.1 * pattern_similarity AS combined_similarity FROM {_SIMS})) WHERE rank <= 2""",
)
def ord3(spark, sf):
    return rounded(sem.most_similar(sem.column_blocks(table(spark, sf, "orders"), list(_SIM)), 2, score="combined_similarity"))
