"""Profiles, types, validation and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import importance, profile, schema, types, validate
from gridwright.queries.base import (
    DOUBLED, GAPPY, MESSY, MESSY_COLS, MESSY_NUMS, doubled, gappy, messy, query, rounded, table, union_sql,
)

LINE_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _quality_sql(source: str, cols, prefix="") -> str:
    return union_sql(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing,
        100.0 * (count(*) - count({c}))::DOUBLE / count(*) AS missing_pct, count(DISTINCT {c}) AS n_unique,
        CAST(count(DISTINCT {c}) <= 1 AS INTEGER) AS is_constant,
        CAST(count(DISTINCT {c}) > 100 AS INTEGER) AS is_high_cardinality FROM {source}"""
        for c in cols
    )


@query(
    "prf1_quality",
    f"SELECT * REPLACE (round(missing_pct, 6) AS missing_pct) FROM ({_quality_sql('lineitem', LINE_COLS)} "
    f"UNION ALL {_quality_sql(MESSY, MESSY_COLS)})",
)
def prf1(spark, sf):
    raw = profile.quality(table(spark, sf, "lineitem"))
    return rounded(raw.unionByName(profile.quality(messy(spark, sf), MESSY_COLS)))


@query(
    "prf1_duplicates",
    f"SELECT CAST((SELECT count(*) FROM {DOUBLED}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) "
    "AS BIGINT) AS duplicate_rows",
)
def prf1_duplicates(spark, sf):
    return profile.duplicate_rows(doubled(spark, sf))


@query(
    "prf2_recommendations",
    f"""WITH q AS ({_quality_sql(MESSY, MESSY_COLS)}),
    f AS (SELECT rule, "column" FROM (
      SELECT "column", unnest([CASE WHEN missing_pct > 50 THEN 'drop_missing_over_50' END,
        CASE WHEN missing_pct > 10 AND missing_pct <= 50 THEN 'impute_missing_10_50' END,
        CASE WHEN is_constant = 1 THEN 'remove_constant' END,
        CASE WHEN is_high_cardinality = 1 THEN 'engineer_high_cardinality' END]) AS rule FROM q) WHERE rule IS NOT NULL)
    SELECT rule, string_agg("column", ',' ORDER BY "column") AS columns FROM f GROUP BY rule
    UNION ALL SELECT 'remove_duplicates', CAST(n - d AS VARCHAR) FROM
      (SELECT (SELECT count(*) FROM {DOUBLED}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) AS d)
    WHERE n > d""",
)
def prf2(spark, sf):
    rec = profile.recommendations(
        profile.quality(messy(spark, sf), MESSY_COLS), profile.duplicate_rows(doubled(spark, sf))
    )
    return rec.select("rule", F.array_join("columns", ",").alias("columns"))


def _stats_sql(source, cols) -> str:
    return union_sql(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75 FROM {source}"""
        for c in cols
    )


@query("prf3_statistics", _stats_sql(MESSY, MESSY_NUMS))
def prf3(spark, sf):
    return rounded(profile.statistics(messy(spark, sf), MESSY_NUMS))


@query(
    "prf4_profile",
    f"""WITH q AS ({_quality_sql(MESSY, MESSY_COLS)}), s AS ({_stats_sql(MESSY, MESSY_NUMS)}),
    w AS (SELECT "column", n_rows::DOUBLE AS n_rows, n_missing::DOUBLE AS n_missing, missing_pct,
      n_unique::DOUBLE AS n_unique, 100.0 - missing_pct AS completeness_pct,
      (missing_pct > 50)::INT::DOUBLE AS mostly_missing, is_constant::DOUBLE AS is_constant,
      (n_unique > 0.9 * n_rows)::INT::DOUBLE AS nearly_unique FROM q)
    SELECT "column", metric, round(value, 5) AS value FROM (
      UNPIVOT w ON n_rows, n_missing, missing_pct, n_unique, completeness_pct, mostly_missing, is_constant,
        nearly_unique INTO NAME metric VALUE value)
    UNION ALL SELECT "column", metric, round(value, 5) FROM (
      UNPIVOT (SELECT * EXCLUDE (count) FROM s) ON mean, std, min, q25, q50, q75, max, skew, kurtosis
      INTO NAME metric VALUE value)""",
)
def prf4(spark, sf):
    cols = MESSY_COLS
    df = messy(spark, sf)
    full = profile.full_profile(df, cols)
    full = full.where(~((F.col("column") == "always_one") & F.col("metric").isin(
        "mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurtosis")))
    return rounded(full, 5)


def _top_sql(source, cols, order) -> str:
    return union_sql(
        f"""SELECT '{c}' AS "column", rank::INTEGER AS rank, value, count FROM (
        SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count,
        row_number() OVER (ORDER BY count(*) {order}, CAST({c} AS VARCHAR)) AS rank
        FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""
        for c in cols
    )


@query("prf5_top_values", _top_sql("lineitem", ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey"], "DESC"))
def prf5(spark, sf):
    return profile.top_values(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey"]
    )


@query("prf5_least_values", _top_sql("orders", ["o_custkey", "o_orderpriority"], "ASC"))
def prf5_least(spark, sf):
    return profile.top_values(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], least=True)


@query(
    "prf5_normalized",
    union_sql(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
        round(count(*)::DOUBLE / (SELECT count({c}) FROM {MESSY}), 6) AS share
        FROM {MESSY} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ["returnflag", "linestatus"]
    ),
)
def prf5_normalized(spark, sf):
    return rounded(profile.normalized_counts(messy(spark, sf), ["returnflag", "linestatus"]))


_PAIRS = [(a, b) for i, a in enumerate(MESSY_NUMS) for b in MESSY_NUMS[i + 1 :]]


@query(
    "prf6_correlations",
    union_sql(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM {MESSY}" for a, b in _PAIRS),
)
def prf6(spark, sf):
    return rounded(profile.correlations(messy(spark, sf), MESSY_NUMS))


def _meta_sql(source, nums, others) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(DISTINCT {c}) AS n_unique,
        round((count(*) - count({c}))::DOUBLE / count(*), 6) AS missing_rate, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM {source}"""
        for c in nums
    ]
    parts += [
        f"""SELECT '{c}', count(*), count(DISTINCT {c}), round((count(*) - count({c}))::DOUBLE / count(*), 6),
        NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM {source}"""
        for c in others
    ]
    return union_sql(parts)


@query("prf7_metadata", _meta_sql(GAPPY, ["value"], ["event_type", "ts"]))
def prf7(spark, sf):
    return rounded(profile.column_metadata(gappy(spark, sf), ["value", "event_type", "ts"]))


@query(
    "prf8_column_statistics",
    union_sql(
        f"""SELECT '{c}' AS "column", 'double' AS dtype, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS missing_rate,
        count(DISTINCT {c}) AS n_unique, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.5), 6) AS median FROM {MESSY}"""
        for c in MESSY_NUMS
    ),
)
def prf8(spark, sf):
    return rounded(profile.normalizer_statistics(messy(spark, sf), MESSY_NUMS))


@query(
    "prf9_cardinality",
    union_sql(
        f"""SELECT '{c}' AS "column", '{t}' AS semantic_type,
        CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS cardinality,
        round((count(*) - count({c}))::DOUBLE / count(*), 6) AS missing_rate FROM {MESSY}"""
        for c, t in [("quantity", "numerical"), ("returnflag", "categorical"), ("linestatus", "categorical"),
                     ("always_one", "boolean")]
    ),
)
def prf9(spark, sf):
    df = messy(spark, sf)
    cols = ["quantity", "returnflag", "linestatus", "always_one"]
    kinds = types.general_types(types.type_facts(df, cols))
    return rounded(profile.cardinality_with_null(df, kinds, cols))


@query(
    "prf10_vector",
    union_sql(
        f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
        max({c}) AS max, round(quantile_cont({c}, 0.5), 6) AS median, round(skewness({c}), 6) AS skew,
        round(kurtosis({c}), 6) AS kurtosis, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_ratio FROM {MESSY}"""
        for c in MESSY_NUMS
    ),
)
def prf10(spark, sf):
    return rounded(profile.statistics_vector(messy(spark, sf), MESSY_NUMS))


@query(
    "prf10_cosines",
    union_sql(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
        round(sum(coalesce({a}, 0) * coalesce({b}, 0)) / (sqrt(sum({a} * {a})) * sqrt(sum({b} * {b}))), 6) AS cosine
        FROM {MESSY}"""
        for i, a in enumerate(MESSY_NUMS) for b in MESSY_NUMS[i:]
    ),
)
def prf10_cosines(spark, sf):
    return rounded(profile.column_cosines(messy(spark, sf), MESSY_NUMS))


@query(
    "prf11_card",
    f"""SELECT 'n_rows' AS item, count(*) AS value FROM {MESSY} UNION ALL SELECT 'n_features', 6
    UNION ALL SELECT 'has_target', 1 UNION ALL SELECT 'type_numerical', 4
    UNION ALL SELECT 'type_categorical', 1 UNION ALL SELECT 'type_boolean', 1""",
)
def prf11(spark, sf):
    df = messy(spark, sf)
    kinds = types.general_types(types.type_facts(df, MESSY_COLS))
    return profile.dataset_card(kinds, df.agg(F.count("*").alias("n_rows")), "linestatus")


# ---------------------------------------------------------------- types

TYPED = """(SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate,
  strftime(o_orderdate, '%d/%m/%Y') AS day_text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS yes_no,
  CAST(o_orderkey % 2 AS INTEGER) AS bit, CAST(o_orderkey % 8 AS INTEGER) AS small,
  CASE WHEN o_orderkey < 0 THEN 'x' END AS nothing,
  'order number ' || o_orderkey || ' of customer ' || o_custkey || ' with status ' || o_orderstatus || ' and priority ' || o_orderpriority AS story,
  'k' || o_orderkey AS code FROM orders)"""
TYPED_COLS = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "day_text", "yes_no", "bit", "small",
              "nothing", "story", "code"]


def typed(spark, sf):
    t = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return t.select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_text"),
        F.when(k % 2 == 0, "Yes").otherwise("no").alias("yes_no"),
        (k % 2).cast("int").alias("bit"), (k % 8).cast("int").alias("small"),
        F.when(k < 0, "x").alias("nothing"),
        F.concat(F.lit("order number "), k, F.lit(" of customer "), "o_custkey", F.lit(" with status "),
                 "o_orderstatus", F.lit(" and priority "), "o_orderpriority").alias("story"),
        F.concat(F.lit("k"), k).alias("code"),
    )


_FMT = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S.%f", "%Y%m%d", "%d-%m-%Y"]


def _facts_sql() -> str:
    kind = {"o_orderkey": "integer", "o_totalprice": "number", "o_orderdate": "datetime", "bit": "integer", "small": "integer"}
    parts = []
    for c in TYPED_COLS:
        k = kind.get(c, "string")
        zero = f"coalesce(bool_and({c} IN (0, 1)), false)" if k in ("integer", "number") else "false"
        words = (
            f"coalesce(bool_and(trim(lower({c})) IN ('true','false','yes','no','1','0','t','f','y','n')), false)"
            if k == "string" else "false"
        )
        dates = (
            " OR ".join(f"count(*) FILTER ({c} IS NOT NULL AND try_strptime({c}, '{f}') IS NULL) = 0" for f in _FMT)
            if k == "string" else "false"
        )
        size = f"avg(length({c}))" if k == "string" else "0.0"
        parts.append(
            f"""SELECT '{c}' AS "column", '{k}' AS kind, count(*) AS n_rows, count({c}) AS n_present,
            count(DISTINCT {c}) AS n_unique, {zero} AS zero_one, {words} AS bool_words, {dates} AS dates_ok,
            {size} AS avg_len FROM {TYPED}"""
        )
    return union_sql(parts)


def _type_sql(case: str) -> str:
    return f"""SELECT "column", {case} AS semantic_type, n_present, n_unique FROM ({_facts_sql()})"""


@query(
    "typ1_semantic_types",
    _type_sql(
        """CASE WHEN n_present = 0 THEN 'unknown' WHEN kind = 'datetime' THEN 'datetime' WHEN zero_one THEN 'boolean'
        WHEN kind IN ('integer','number') THEN 'numerical' WHEN bool_words THEN 'boolean' WHEN dates_ok THEN 'datetime'
        WHEN n_unique::DOUBLE / n_present <= 0.05 OR n_unique <= 20 THEN 'categorical'
        WHEN avg_len > 50 THEN 'text' ELSE 'categorical' END"""
    ),
)
def typ1(spark, sf):
    return types.general_types(types.type_facts(typed(spark, sf)))


_TOK_CASE = """CASE WHEN kind = 'datetime' THEN 'datetime' WHEN kind = 'integer' AND n_unique <= 10 THEN 'categorical'
  WHEN kind IN ('integer','number') THEN 'numerical' ELSE 'categorical' END"""


@query("typ2_tokenizer_types", _type_sql(_TOK_CASE))
def typ2(spark, sf):
    return types.tokenizer_types(types.type_facts(typed(spark, sf)))


@query("typ3_column_types", _type_sql(_TOK_CASE))
def typ3(spark, sf):
    return types.column_types(types.type_facts(typed(spark, sf)))


@query(
    "typ4_normalizer_types",
    _type_sql(
        """CASE WHEN kind = 'datetime' THEN 'datetime'
        WHEN kind IN ('integer','number') AND n_unique::DOUBLE / n_rows < 0.05 AND n_unique < 20 THEN 'categorical'
        WHEN kind IN ('integer','number') THEN 'numerical' ELSE 'categorical' END"""
    ),
)
def typ4(spark, sf):
    return types.normalizer_types(types.type_facts(typed(spark, sf)))


# ---------------------------------------------------------------- validation

RULES = validate.Rules(
    min_rows=10, expected_columns=("quantity", "price", "discount", "gone"), allow_extra_columns=False,
    expected_dtypes={"quantity": "int", "returnflag": "float", "tax": "float"}, missing_threshold=0.3,
)


def _struct_sql(n_rows_sql: str) -> str:
    return f"SELECT 'error' AS severity, 'too_many_rows' AS code, '' AS \"column\" FROM ({n_rows_sql}) WHERE n > 1000"


@query("val1_structure", _struct_sql("SELECT count(*) AS n FROM lineitem") + " UNION ALL SELECT 'error','too_many_columns',''")
def val1(spark, sf):
    rules = validate.Rules(max_rows=1000, max_columns=3)
    return validate.structure_issues(table(spark, sf, "lineitem"), rules).select("severity", "code", "column")


_VAL2 = """SELECT 'error' AS severity, 'missing_column' AS code, 'gone' AS "column"
  UNION ALL SELECT 'warning', 'extra_column', unnest(['tax','returnflag','linestatus','always_one'])"""


@query("val2_columns", _VAL2 + f" FROM (SELECT count(*) AS n FROM {MESSY})")
def val2(spark, sf):
    df = messy(spark, sf).select(*MESSY_COLS)
    return schema.column_set_issues(df, RULES.expected_columns).select("severity", "code", "column")


_VAL3 = f"""SELECT CASE WHEN bad = 0 THEN 'warning' ELSE 'error' END AS severity,
  CASE WHEN bad = 0 THEN 'dtype_convertible' ELSE 'dtype_mismatch' END AS code, "column" FROM (
  SELECT 'quantity' AS "column", count(*) FILTER (quantity IS NOT NULL AND try_cast(quantity AS BIGINT) IS NULL) AS bad FROM {MESSY}
  UNION ALL SELECT 'returnflag', count(*) FILTER (returnflag IS NOT NULL AND try_cast(returnflag AS DOUBLE) IS NULL) FROM {MESSY})"""


@query("val3_dtypes", _VAL3)
def val3(spark, sf):
    return validate.dtype_issues(messy(spark, sf), RULES.expected_dtypes).select("severity", "code", "column")


def _outlier_sql(source, cols) -> str:
    return union_sql(
        f"""SELECT '{c}' AS "column", count({c}) AS n_present, CAST(count(*) FILTER (q3 > q1 AND
        ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
        FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}) b"""
        for c in cols
    )


_VAL4 = f"""WITH f AS (SELECT q.*, coalesce(n_outliers, 0) AS n_outliers FROM ({_quality_sql(MESSY, MESSY_COLS)}) q
    LEFT JOIN ({_outlier_sql(MESSY, MESSY_NUMS)}) o USING ("column"))
  SELECT 'error' AS severity, 'excessive_missing' AS code, "column" FROM f WHERE n_missing::DOUBLE / n_rows > 0.3
  UNION ALL SELECT 'warning', 'moderate_missing', "column" FROM f WHERE n_missing::DOUBLE / n_rows > 0.1 AND n_missing::DOUBLE / n_rows <= 0.3
  UNION ALL SELECT 'error', 'excessive_outliers', "column" FROM f WHERE n_outliers::DOUBLE / n_rows > 0.1
  UNION ALL SELECT 'warning', 'moderate_outliers', "column" FROM f WHERE n_outliers::DOUBLE / n_rows > 0.05 AND n_outliers::DOUBLE / n_rows <= 0.1
  UNION ALL SELECT 'warning', 'constant_column', "column" FROM f WHERE n_unique <= 1"""


@query("val4_quality", _VAL4)
def val4(spark, sf):
    df = messy(spark, sf).select(*MESSY_COLS)
    return validate.quality_issues(df, RULES).select("severity", "code", "column")


_SKEWED = "(SELECT value, value * value AS squared, CAST(event_id AS DOUBLE) AS id FROM events)"


@query("val5_outlier_counts", _outlier_sql(_SKEWED, ["value", "squared", "id"]))
def val5(spark, sf):
    t = table(spark, sf, "events")
    df = t.select("value", (F.col("value") * F.col("value")).alias("squared"), F.col("event_id").cast("double").alias("id"))
    return validate.outlier_counts(df)


@query("val6_validate", f"({_VAL2}) UNION ALL ({_VAL3}) UNION ALL ({_VAL4})")
def val6(spark, sf):
    df = messy(spark, sf).select(*MESSY_COLS)
    return validate.validate(df, RULES).issues.select("severity", "code", "column")


# ---------------------------------------------------------------- importance

_IMP_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _mi_sql(c: str, source: str) -> str:
    filled = f"(SELECT t, coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {source})) AS x FROM {source})"
    return f"""SELECT '{c}' AS feature, round(sum(p * ln(p / (px * py))), 6) AS importance FROM (
      SELECT n / tot AS p, sum(n) OVER (PARTITION BY b) / tot AS px, sum(n) OVER (PARTITION BY t) / tot AS py FROM (
        SELECT b, t, count(*)::DOUBLE AS n, (sum(count(*)) OVER ())::DOUBLE AS tot FROM (
          SELECT t, least(greatest(ceil((x - lo) / (hi - lo) * 10) - 1, 0), 9) AS b FROM {filled},
            (SELECT min(x) AS lo, max(x) AS hi FROM {filled}) r) GROUP BY b, t))"""


_IMP_SRC = """(SELECT l_returnflag AS t, l_linestatus, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
  l_extendedprice, l_discount, l_tax FROM lineitem)"""


@query(
    "imp1_mutual_information",
    union_sql([_mi_sql(c, _IMP_SRC) for c in _IMP_NUM])
    + f""" UNION ALL SELECT 'l_linestatus', round(sum(p * ln(p / (px * py))), 6) FROM (
      SELECT n / tot AS p, sum(n) OVER (PARTITION BY b) / tot AS px, sum(n) OVER (PARTITION BY t) / tot AS py FROM (
        SELECT l_linestatus AS b, t, count(*)::DOUBLE AS n, (sum(count(*)) OVER ())::DOUBLE AS tot FROM {_IMP_SRC} GROUP BY 1, 2))""",
)
def imp1(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")))
    return rounded(importance.mutual_information(t, "l_returnflag", _IMP_NUM + ["l_linestatus"]))


@query(
    "imp2_correlation",
    union_sql(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS importance FROM lineitem"
              for c in ["l_quantity", "l_discount", "l_tax"]),
)
def imp2(spark, sf):
    return rounded(importance.absolute_correlation(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query(
    "imp3_variance",
    union_sql(f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS importance FROM lineitem"
              for c in ["l_quantity", "l_discount", "l_tax"]),
)
def imp3(spark, sf):
    return rounded(importance.variance(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query(
    "ord2_importance_ranking",
    """SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, importance FROM ("""
    + union_sql(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS importance FROM lineitem"
                for c in ["l_quantity", "l_discount", "l_tax"]) + ")",
)
def ord2(spark, sf):
    return rounded(importance.ranked(imp2(spark, sf)))


