"""Schema work, filters, joins, missing values and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import impute, joins, outlier, schema
from gridwright.plans.storage import scratch_path
from gridwright.queries.base import (
    DOUBLED, GAPPY, MESSY, MESSY_NUMS, doubled, gappy, messy, query, rounded, table, union_sql,
)
from gridwright.queries.profiling import typed

# ---------------------------------------------------------------- schema


@query(
    "sch1_semantic_schema",
    """SELECT 'error' AS severity, 'missing_column' AS code, 'gone' AS "column"
    UNION ALL SELECT 'warning', 'extra_column', unnest(['o_totalprice','o_orderdate','day_text','bit','small','nothing','story','code'])
    UNION ALL SELECT 'error', 'type_mismatch', 'yes_no' FROM orders HAVING count(*) > 0""",
)
def sch1(spark, sf):
    want = {"o_orderkey": "numerical", "o_orderstatus": "categorical", "yes_no": "categorical", "gone": "text"}
    return schema.semantic_issues(typed(spark, sf), want).select("severity", "code", "column")


@query(
    "sch2_storage_schema",
    """SELECT 'error' AS severity, 'missing_column' AS code, 'l_extra' AS "column" FROM lineitem HAVING count(*) > 0
    UNION ALL SELECT 'error', 'extra_column', 'l_tax' UNION ALL SELECT 'error', 'dtype_mismatch', 'l_quantity'""",
)
def sch2(spark, sf):
    df = table(spark, sf, "lineitem")
    store = schema.SchemaStore(spark, scratch_path(spark, "schemas"))
    want = df.select(
        *[F.col(c).cast("string") if c == "l_quantity" else F.col(c) for c in df.columns if c != "l_tax"],
        F.lit("x").alias("l_extra"),
    ).schema
    store.register("lineitem", want)
    return store.validate(df, "lineitem").select("severity", "code", "column")


@query(
    "sch3_conform",
    """SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN lower(trim(yes_no)) IN ('true','yes','1','t','y') THEN 1 ELSE 0 END AS yes_no,
    strftime(o_orderdate, '%Y-%m-%d') AS day_text, 0.0::DOUBLE AS weight, 0 AS flag, 'Unknown' AS note,
    CAST(bit AS VARCHAR) AS bit
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS yes_no, o_orderdate,
      CAST(o_orderkey % 2 AS INTEGER) AS bit FROM orders)""",
)
def sch3(spark, sf):
    want = {
        "o_orderkey": "numerical", "yes_no": "boolean", "day_text": "datetime", "weight": "numerical",
        "flag": "boolean", "note": "categorical", "bit": "categorical",
    }
    out = schema.conform(typed(spark, sf), want)
    return out.select(
        "o_orderkey", F.col("yes_no").cast("int").alias("yes_no"),
        F.date_format("day_text", "yyyy-MM-dd").alias("day_text"), "weight",
        F.col("flag").cast("int").alias("flag"), "note", "bit",
    )


@query(
    "sch4_convertible",
    """SELECT 'story' AS "column", count(*) FILTER (try_cast(story AS DOUBLE) IS NULL) AS n_bad, 0 AS convertible
    FROM (SELECT 'order number ' || o_orderkey AS story FROM orders)
    UNION ALL SELECT 'small', 0, 1 UNION ALL SELECT 'yes_no', 0, 1 UNION ALL SELECT 'day_text', 0, 1""",
)
def sch4(spark, sf):
    want = {"story": "float", "small": "int", "yes_no": "bool", "day_text": "datetime"}
    return schema.convertible(typed(spark, sf), want)


_MIXED = """(SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE CAST(o_orderkey AS VARCHAR) END AS a,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)"""


def _mixed(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 9 == 0, "bad").otherwise(k.cast("string")).alias("a"),
        F.when(k % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
    )


@query(
    "sch5_coerce",
    f"""SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(try_cast(a AS BIGINT), -1) AS a,
    coalesce(strftime(try_strptime(d, '%Y-%m-%d'), '%Y-%m-%d'), '') AS d FROM {_MIXED}""",
)
def sch5(spark, sf):
    out = schema.coerce_columns(_mixed(spark, sf), {"a": "int", "d": "datetime", "o_orderkey": "string"})
    return out.select(
        "o_orderkey", F.coalesce("a", F.lit(-1)).alias("a"),
        F.coalesce(F.date_format("d", "yyyy-MM-dd"), F.lit("")).alias("d"),
    )


@query(
    "sch6_align",
    "SELECT c_custkey, c_mktsegment, CAST(NULL AS DOUBLE) AS balance, c_acctbal FROM customer",
)
def sch6(spark, sf):
    return schema.align_columns(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment", "balance"], "c_acctbal")


# ---------------------------------------------------------------- filters


@query("flt1_drop_duplicates", f"SELECT DISTINCT * FROM {DOUBLED}")
def flt1(spark, sf):
    return schema.drop_duplicates(doubled(spark, sf))


@query(
    "flt2_drop_constant",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, discount, tax, returnflag, linestatus, price FROM {MESSY}",
)
def flt2(spark, sf):
    return schema.drop_constant(messy(spark, sf))


_HOLES = f"(SELECT acctbal, segment, CASE WHEN c_nationkey > 12 THEN c_nationkey END AS nation FROM {DOUBLED})"


def _holes(spark, sf):
    return doubled(spark, sf).select(
        "acctbal", "segment", F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")).alias("nation")
    )


@query(
    "flt3_drop_empty",
    f"SELECT acctbal, segment, nation FROM {_HOLES} WHERE acctbal IS NOT NULL OR segment IS NOT NULL OR nation IS NOT NULL",
)
def flt3(spark, sf):
    return schema.drop_empty_rows(_holes(spark, sf))


@query("flt4_drop_missing_target", f"SELECT * FROM {DOUBLED} WHERE acctbal IS NOT NULL")
def flt4(spark, sf):
    return schema.drop_missing(doubled(spark, sf), ["acctbal"])


@query("flt5_split_target", "SELECT c_custkey, c_acctbal, 4 AS n_features FROM customer")
def flt5(spark, sf):
    x, y = schema.split_target(table(spark, sf, "customer"), "c_acctbal", ["c_custkey"])
    return y.withColumn("n_features", F.lit(len(x.columns)))


# ---------------------------------------------------------------- joins


@query(
    "jn1_first_match",
    """SELECT c_custkey, CAST(o_orderkey IS NOT NULL AS INTEGER) AS orders_found, coalesce(o_orderkey, -1) AS orders_o_orderkey,
    coalesce(o_totalprice, -1) AS orders_o_totalprice, n_name AS nation_n_name
    FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
      ON c_custkey = o_custkey AND rn = 1 LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def jn1(spark, sf):
    out = joins.multi_table(
        table(spark, sf, "customer"),
        {"orders": table(spark, sf, "orders"), "nation": table(spark, sf, "nation")},
        {
            "orders": {"primary_key": "c_custkey", "foreign_key": "o_custkey", "order_cols": ["o_orderdate", "o_orderkey"]},
            "nation": {"primary_key": "c_nationkey", "foreign_key": "n_nationkey", "order_cols": ["n_name"]},
        },
    )
    return out.select(
        "c_custkey", "orders_found", F.coalesce("orders_o_orderkey", F.lit(-1)).alias("orders_o_orderkey"),
        F.coalesce("orders_o_totalprice", F.lit(-1.0)).alias("orders_o_totalprice"), "nation_n_name",
    )


@query(
    "jn2_lookup",
    """SELECT o_orderkey, coalesce(n, 0) AS n_customer_orders FROM orders LEFT JOIN (
    SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) ON o_custkey = k""",
)
def jn2(spark, sf):
    from gridwright.operators import encode

    t = table(spark, sf, "orders")
    early = t.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return encode.lookup(t, "o_custkey", encode.frequency_mapping(early, "o_custkey"), "n_customer_orders", 0).select(
        "o_orderkey", "n_customer_orders"
    )


_SHARES = """(SELECT {c} AS value, count(*)::DOUBLE / (SELECT count(*) FROM {s}) AS share FROM {s} GROUP BY 1)"""


@query(
    "jn3_align_distributions",
    f"""SELECT coalesce(a.value, b.value) AS value, round(coalesce(a.share, 0), 6) AS p, round(coalesce(b.share, 0), 6) AS q
    FROM {_SHARES.format(c="p_brand", s="(SELECT * FROM part WHERE p_size < 25)")} a
    FULL JOIN {_SHARES.format(c="p_brand", s="(SELECT * FROM part WHERE p_size >= 25)")} b ON a.value = b.value""",
)
def jn3(spark, sf):
    from gridwright.operators import profile

    t = table(spark, sf, "part")
    a = profile.normalized_counts(t.where("p_size < 25"), ["p_brand"])
    b = profile.normalized_counts(t.where("p_size >= 25"), ["p_brand"])
    return rounded(joins.align_distributions(a, b))


@query(
    "jn4_domain_pairs",
    """SELECT a.source AS source, b.source AS target FROM (SELECT DISTINCT source FROM documents) a,
    (SELECT DISTINCT source FROM documents) b WHERE a.source <> b.source""",
)
def jn4(spark, sf):
    return joins.domain_pairs(table(spark, sf, "documents"), "source")


@query(
    "jn5_comparable",
    """SELECT o_orderkey AS key, o_totalprice AS time, n_later FROM orders JOIN (
    SELECT t, sum(n) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - n AS n_later
    FROM (SELECT o_totalprice AS t, count(*) AS n FROM orders GROUP BY 1)) ON o_totalprice = t WHERE o_orderstatus = 'F'""",
)
def jn5(spark, sf):
    t = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("time"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"),
    )
    return joins.comparable_counts(t, "key", "time", "event")


@query("jn6_combine", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer")
def jn6(spark, sf):
    x, y = schema.split_target(table(spark, sf, "customer"), "c_acctbal", ["c_custkey"])
    return joins.combine_target(x, y, ["c_custkey"])


@query(
    "set1_column_sets",
    """SELECT 'c_custkey' AS "column", 'both' AS side FROM customer HAVING count(*) > 0 UNION ALL SELECT 'c_nationkey', 'both'
    UNION ALL SELECT unnest(['c_name', 'c_acctbal', 'c_mktsegment']), 'left_only'
    UNION ALL SELECT unnest(['acctbal', 'segment']), 'right_only'""",
)
def set1(spark, sf):
    return schema.column_sets(table(spark, sf, "customer"), doubled(spark, sf))


@query(
    "set2_append",
    """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def set2(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"),
                                            F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return schema.append_rows(a, b)


# ---------------------------------------------------------------- missing values

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "mv1_mean_median",
    f"""SELECT {_KEYS}, round(coalesce(quantity, (SELECT avg(quantity) FROM {MESSY})), 6) AS quantity,
    coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {MESSY})) AS price FROM {MESSY}""",
)
def mv1(spark, sf):
    df = messy(spark, sf).select(*KEY_COLS, "quantity", "price")
    return rounded(impute.apply_fill(df, impute.fit_fill(df, {"quantity": "mean", "price": "median"})))


_MODE = """(SELECT {c} FROM {s} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query(
    "mv2_mode",
    f"""SELECT {_KEYS}, coalesce(returnflag, {_MODE.format(c="returnflag", s=MESSY)}) AS returnflag,
    coalesce(quantity, {_MODE.format(c="quantity", s=MESSY)}) AS quantity FROM {MESSY}""",
)
def mv2(spark, sf):
    df = messy(spark, sf).select(*KEY_COLS, "returnflag", "quantity")
    return impute.apply_fill(df, impute.fit_fill(df, {"returnflag": "mode", "quantity": "mode"}))


@query(
    "mv3_constant",
    f"SELECT {_KEYS}, coalesce(quantity, 0) AS quantity, coalesce(returnflag, 'Unknown') AS returnflag FROM {MESSY}",
)
def mv3(spark, sf):
    return impute.fill_constants(messy(spark, sf).select(*KEY_COLS, "quantity", "returnflag"))


@query(
    "mv4_knn",
    f"SELECT {_KEYS}, round(coalesce(discount, (SELECT avg(discount) FROM {MESSY})), 6) AS discount FROM {MESSY}",
)
def mv4(spark, sf):
    df = messy(spark, sf).select(*KEY_COLS, "discount")
    return rounded(impute.apply_fill(df, impute.fit_fill(df, {"discount": "knn"})))


@query(
    "mv6_forward_backward",
    f"""SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER w, -1) AS forward,
    coalesce(first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS backward
    FROM {GAPPY} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def mv6(spark, sf):
    df = gappy(spark, sf)
    f = impute.directional_fill(df.withColumn("forward", F.col("value")), ["forward"], ["user_id"], ["ts", "event_id"])
    b = impute.directional_fill(f.withColumn("backward", F.col("value")), ["backward"], ["user_id"], ["ts", "event_id"], backward=True)
    return b.select("event_id", F.coalesce("forward", F.lit(-1.0)).alias("forward"), F.coalesce("backward", F.lit(-1.0)).alias("backward"))


@query(
    "mv7_interpolate",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {GAPPY}),
    q AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS va, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia,
      first_value(value IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib FROM p
      WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(value, va + (vb - va) * (i - ia) / nullif(ib - ia, 0), va, -1), 6) AS value FROM q""",
)
def mv7(spark, sf):
    out = impute.interpolate(gappy(spark, sf), ["value"], ["user_id"], ["ts", "event_id"])
    return rounded(out.select("event_id", F.coalesce("value", F.lit(-1.0)).alias("value")))


@query(
    "mv8_train_test_fill",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM {MESSY} WHERE l_orderkey % 10 < 8)) AS quantity
    FROM {MESSY} WHERE l_orderkey % 10 >= 8""",
)
def mv8(spark, sf):
    df = messy(spark, sf).select(*KEY_COLS, "quantity")
    values = impute.fit_fill(df.where("l_orderkey % 10 < 8"), {"quantity": "median"})
    return impute.apply_fill(df.where("l_orderkey % 10 >= 8"), values)


@query(
    "mv8_fill_log",
    union_sql(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_filled FROM {MESSY}""" for c in MESSY_NUMS),
)
def mv8_log(spark, sf):
    df = messy(spark, sf)
    return impute.fill_log(df, {c: 0.0 for c in MESSY_NUMS})


@query(
    "mv9_recovery_fill",
    f"""SELECT c_custkey, c_nationkey, acctbal, coalesce(segment, {_MODE.format(c="segment", s="(SELECT * FROM " + DOUBLED + " WHERE acctbal IS NOT NULL)")}) AS segment
    FROM {DOUBLED} WHERE acctbal IS NOT NULL""",
)
def mv9(spark, sf):
    df = schema.drop_missing(doubled(spark, sf), ["acctbal"])
    values = {c: v for c, v in impute.recovery_values(df, target="acctbal").items() if c == "segment"}
    return impute.apply_fill(df, values)


@query(
    "mv10_last_resort",
    f"SELECT c_custkey, c_nationkey, coalesce(acctbal, 0) AS acctbal, coalesce(segment, 'unknown') AS segment FROM {DOUBLED}",
)
def mv10(spark, sf):
    from gridwright.plans import prepare

    out = prepare.minimal_transform(doubled(spark, sf))
    return out.select(F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("int"), "acctbal", "segment")


@query(
    "mv11_null_as_zero",
    f"""SELECT {_KEYS}, round((coalesce(quantity, 0) - m) / s, 6) AS quantity FROM {MESSY},
    (SELECT avg(coalesce(quantity, 0)) AS m, stddev_pop(coalesce(quantity, 0)) AS s FROM {MESSY})""",
)
def mv11(spark, sf):
    from gridwright.operators import scale

    df = messy(spark, sf).select(*KEY_COLS, "quantity")
    return rounded(scale.apply_scaler(df, scale.fit_scaler(df, ["quantity"], null_as_zero=True), null_as_zero=True))


# ---------------------------------------------------------------- outliers

EV = "(SELECT event_id, value FROM events)"


def _ev(spark, sf):
    return table(spark, sf, "events").select("event_id", "value")


def _flag_sql(bounds: str) -> str:
    return f"SELECT event_id, value, CAST(value < lo OR value > hi AS INTEGER) AS value_outlier FROM {EV}, ({bounds})"


_IQR = f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {EV})"
_Z = f"SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM {EV}"


@query("out1_iqr", _flag_sql(_IQR))
def out1(spark, sf):
    df = _ev(spark, sf)
    return outlier.flag(df, outlier.fit_bounds(df, ["value"], "iqr"))


@query("out2_zscore", _flag_sql(_Z))
def out2(spark, sf):
    df = _ev(spark, sf)
    return outlier.flag(df, outlier.fit_bounds(df, ["value"], "zscore"))


@query(
    "out3_percentile",
    _flag_sql(f"SELECT quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM {EV}"),
)
def out3(spark, sf):
    df = _ev(spark, sf)
    return outlier.flag(df, outlier.fit_bounds(df, ["value"], "percentile"))


_WIDE = "(SELECT event_id, value, value * value AS squared, sqrt(value) AS root FROM events)"


def _wide(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", "value", (v * v).alias("squared"), F.sqrt(v).alias("root"))


def _multi_sql(cap: str) -> str:
    cols = ["value", "squared", "root"]
    bounds = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.75) AS {c}3" for c in cols
    )
    flags = " + ".join(
        f"CAST({c} < {c}1 - 1.5 * ({c}3 - {c}1) OR {c} > {c}3 + 1.5 * ({c}3 - {c}1) AS INTEGER)" for c in cols
    )
    return f"""WITH f AS (SELECT event_id, value, {flags} AS k FROM {_WIDE}, (SELECT {bounds} FROM {_WIDE})),
    r AS (SELECT *, row_number() OVER (ORDER BY k DESC, md5(concat_ws('|', event_id, '', '42')), event_id) AS rn FROM f)
    SELECT event_id, value FROM r WHERE NOT (k > 1 AND rn <= {cap})"""


@query("out4_remove_multi", _multi_sql("(SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM events)"))
def out4(spark, sf):
    df = _wide(spark, sf)
    b = outlier.fit_bounds(df, ["value", "squared", "root"], "iqr")
    return outlier.remove_multi_outliers(df, b, ["event_id"]).select("event_id", "value")


@query("out4_remove_capped", _multi_sql("(SELECT CAST(floor(0.02 * count(*)) AS BIGINT) FROM events)"))
def out4_capped(spark, sf):
    df = _wide(spark, sf)
    b = outlier.fit_bounds(df, ["value", "squared", "root"], "iqr")
    return outlier.remove_multi_outliers(df, b, ["event_id"], max_share=0.02).select("event_id", "value")


@query(
    "out5_clip",
    f"""SELECT event_id, round(least(greatest(value, lo), hi), 6) AS iqr, round(least(greatest(value, zlo), zhi), 6) AS zscore
    FROM {EV}, ({_IQR}), (SELECT lo AS zlo, hi AS zhi FROM ({_Z}))""",
)
def out5(spark, sf):
    df = _ev(spark, sf).select("event_id", F.col("value").alias("iqr"), F.col("value").alias("zscore"))
    b = outlier.fit_bounds(df, ["iqr"], "iqr") | outlier.fit_bounds(df, ["zscore"], "zscore")
    return rounded(outlier.clip(df, b))


@query("out6_remove", f"SELECT event_id, value FROM {EV}, ({_IQR}) WHERE NOT (value < lo OR value > hi)")
def out6(spark, sf):
    df = _ev(spark, sf)
    return outlier.remove_outside(df, outlier.fit_bounds(df, ["value"], "iqr"))


@query(
    "out7_log",
    "SELECT c_custkey, c_acctbal, round(ln(1 + size), 6) AS size FROM (SELECT c_custkey, c_acctbal, c_acctbal * c_acctbal + 1 AS size FROM customer)",
)
def out7(spark, sf):
    t = table(spark, sf, "customer")
    df = t.select("c_custkey", "c_acctbal", (F.col("c_acctbal") * F.col("c_acctbal") + 1).alias("size"))
    return rounded(outlier.log_transform(df, ["c_acctbal", "size"]))


@query(
    "out8_recovery_clip",
    f"SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value, 1.0::DOUBLE AS fixed FROM {EV}, ({_IQR})",
)
def out8(spark, sf):
    df = _ev(spark, sf).withColumn("fixed", F.lit(1.0))
    b = {c: v for c, v in outlier.iqr_bounds(df, ["value", "fixed"]).items() if v[0] != v[1]}
    return rounded(outlier.clip(df, b))


@query("out9_isolation_forest")
def out9(spark, sf):
    df = _wide(spark, sf)
    forest = outlier.IsolationForest(["value", "squared", "root"], ["event_id"]).fit(df)
    return rounded(forest.predict(df).select("event_id", "score", "is_anomaly"))


_MAHA = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, l_discount AS b FROM lineitem)"""


@query(
    "out10_mahalanobis",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(((a - ma) * (a - ma) * cbb - 2 * (a - ma) * (b - mb) * cab + (b - mb) * (b - mb) * caa) / (caa * cbb - cab * cab), 6) AS score
    FROM {_MAHA}, (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS caa, var_pop(b) AS cbb, covar_pop(a, b) AS cab FROM {_MAHA})""",
)
def out10(spark, sf):
    t = table(spark, sf, "lineitem")
    df = t.select(*KEY_COLS, F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return rounded(outlier.mahalanobis(df, ["a", "b"]).drop("a", "b"))


@query("out10_robust_envelope")
def out10_robust(spark, sf):
    from gridwright.operators.robust import robust_envelope

    df = table(spark, sf, "lineitem").select(*KEY_COLS, F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return rounded(robust_envelope(df, ["a", "b"], 0.05).drop("a", "b"))


@query("out11_reconstruction")
def out11(spark, sf):
    return rounded(
        outlier.reconstruction_error(
            table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2
        ).select(*KEY_COLS, "score")
    )


@query(
    "out12_centre_distance",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT i, avg(v) AS m FROM x GROUP BY i)
    SELECT vec_id, round(sum((v - m) * (v - m)), 5) AS score FROM x JOIN m USING (i) GROUP BY vec_id""",
)
def out12(spark, sf):
    return rounded(outlier.centre_distance(table(spark, sf, "embeddings"), "embedding").select("vec_id", "score"), 5)


@query(
    "out13_threshold",
    f"SELECT event_id, CAST(value > (SELECT quantile_cont(value, 0.95) FROM {EV}) AS INTEGER) AS is_anomaly FROM {EV}",
)
def out13(spark, sf):
    df = _ev(spark, sf)
    return outlier.predict_anomaly(df, "value", outlier.score_threshold(df, "value")).select("event_id", "is_anomaly")


@query(
    "out14_report",
    """WITH p AS (SELECT value AS s, (event_type = 'error')::INT AS t, (value > 50)::INT AS p FROM events),
    a AS (SELECT avg(s) AS score_mean, stddev_samp(s) AS score_std, max(s) AS score_max, min(s) AS score_min,
      count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp,
      count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 1 AND p = 0) AS fn FROM p)
    SELECT round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std, score_max, score_min, tp, fp, tn, fn,
      round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(tp::DOUBLE / (tp + fp), 6) AS precision,
      round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM a""",
)
def out14(spark, sf):
    df = table(spark, sf, "events").select(
        F.col("value").alias("s"), (F.col("event_type") == "error").cast("int").alias("t"),
        (F.col("value") > 50).cast("int").alias("p"),
    )
    return rounded(outlier.anomaly_report(df, "s", "t", "p"))
