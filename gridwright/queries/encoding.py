"""Scaling, encoders and the end-to-end preparation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import encode, scale
from gridwright.plans import prepare
from gridwright.queries.base import DOUBLED, MESSY, doubled, messy, query, rounded, table
from gridwright.queries.cleaning import KEY_COLS

_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _scaled(spark, sf, method):
    df = table(spark, sf, "lineitem").select(*KEY_COLS, "l_quantity", "l_extendedprice")
    return rounded(scale.apply_scaler(df, scale.fit_scaler(df, ["l_quantity", "l_extendedprice"], method)))


def _scale_sql(centre: str, width: str) -> str:
    cols = ["l_quantity", "l_extendedprice"]
    stats = ", ".join(f"{centre.format(c=c)} AS {c}_a, {width.format(c=c)} AS {c}_b" for c in cols)
    cells = ", ".join(f"round(({c} - {c}_a) / {c}_b, 6) AS {c}" for c in cols)
    return f"SELECT {_K}, {cells} FROM lineitem, (SELECT {stats} FROM lineitem)"


@query("nrm1_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def nrm1(spark, sf):
    return _scaled(spark, sf, "standard")


@query("nrm2_minmax", _scale_sql("min({c})", "(max({c}) - min({c}))"))
def nrm2(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("nrm3_robust", _scale_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def nrm3(spark, sf):
    return _scaled(spark, sf, "robust")


@query("nrm4_normal_scores")
def nrm4(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(scale.apply_normal_scores(df, scale.fit_normal_scores(df, ["value"])))


_ROWVEC = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100]) AS x,
  generate_subscripts([1, 2, 3, 4], 1) AS i, rid FROM (SELECT *, row_number() OVER () AS rid FROM lineitem))"""


@query(
    "nrm5_row_wise",
    f"""SELECT {_K}, max(CASE WHEN i = 1 THEN round((x - m) / (s + 1e-8), 5) END) AS standard_1,
    max(CASE WHEN i = 4 THEN round((x - m) / (s + 1e-8), 5) END) AS standard_4,
    max(CASE WHEN i = 2 THEN round((x - lo) / (hi - lo + 1e-8), 5) END) AS minmax_2,
    max(CASE WHEN i = 3 THEN round((x - med) / (q3 - q1 + 1e-8), 5) END) AS robust_3 FROM (
    SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s, min(x) OVER w AS lo, max(x) OVER w AS hi,
      quantile_cont(x, 0.5) OVER w AS med, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3
    FROM {_ROWVEC} WINDOW w AS (PARTITION BY rid)) GROUP BY {_K}, rid""",
)
def nrm5(spark, sf):
    v = F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    df = table(spark, sf, "lineitem").select(*KEY_COLS, v.alias("v"))
    s, m, r = (scale.normalize_row(F.col("v"), k) for k in ("standard", "minmax", "robust"))
    out = df.select(*KEY_COLS, s.alias("s"), m.alias("m"), r.alias("r"))
    return rounded(
        out.select(*KEY_COLS, F.col("s")[0].alias("standard_1"), F.col("s")[3].alias("standard_4"),
                   F.col("m")[1].alias("minmax_2"), F.col("r")[2].alias("robust_3")), 5,
    )


# ---------------------------------------------------------------- categories

_EARLY = "TIMESTAMP '1997-01-01'"


def _orders(spark, sf):
    t = table(spark, sf, "orders")
    return t, t.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))


@query(
    "enc1_label",
    f"""SELECT o_orderkey, coalesce(code, -1) AS code FROM orders LEFT JOIN (
    SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderdate < {_EARLY}))
    ON o_custkey = v""",
)
def enc1(spark, sf):
    t, early = _orders(spark, sf)
    return encode.encode_category(early, t, "o_custkey", "label", "code").select("o_orderkey", "code")


@query(
    "enc1_first_seen",
    """SELECT key, row_number() OVER (ORDER BY seen, key) - 1 AS value FROM (
    SELECT o_custkey AS key, min(o_orderkey) AS seen FROM orders GROUP BY 1)""",
)
def enc1_first(spark, sf):
    return encode.first_seen_mapping(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"])


@query(
    "enc2_frequency",
    f"""SELECT o_orderkey, coalesce(n, 0) AS code, coalesce(n, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders WHERE o_orderdate < {_EARLY} GROUP BY o_custkey))) AS code_common
    FROM orders LEFT JOIN (SELECT o_custkey AS v, count(*) AS n FROM orders WHERE o_orderdate < {_EARLY} GROUP BY 1) ON o_custkey = v""",
)
def enc2(spark, sf):
    t, early = _orders(spark, sf)
    a = encode.encode_category(early, t, "o_custkey", "frequency", "code")
    b = encode.encode_category(early, a, "o_custkey", "frequency", "code_common", unseen="most_frequent")
    return b.select("o_orderkey", "code", "code_common")


@query(
    "enc3_target",
    f"""WITH m AS (SELECT o_custkey AS v, avg(o_totalprice) AS m FROM orders WHERE o_orderdate < {_EARLY} GROUP BY 1)
    SELECT o_orderkey, round(coalesce(m, (SELECT avg(m) FROM m)), 6) AS code FROM orders LEFT JOIN m ON o_custkey = v""",
)
def enc3(spark, sf):
    t, early = _orders(spark, sf)
    return rounded(encode.encode_category(early, t, "o_custkey", "target", "code", "o_totalprice").select("o_orderkey", "code"))


@query(
    "enc4_onehot",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F",
    CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders""",
)
def enc4(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.one_hot(t, "o_orderstatus", encode.fit_categories(t, "o_orderstatus"))


@query(
    "enc4_sparse",
    f"""WITH k AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderdate < {_EARLY}))
    SELECT o_orderkey, code::INTEGER AS cust_index, (SELECT count(*) FROM k)::INTEGER AS cust_size FROM orders LEFT JOIN k ON o_custkey = v""",
)
def enc4_sparse(spark, sf):
    t, early = _orders(spark, sf)
    return encode.one_hot_sparse(t.select("o_orderkey", "o_custkey"), "o_custkey", encode.label_mapping(early, "o_custkey"), "cust").drop("o_custkey")


@query(
    "enc5_datetime",
    """SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dayofweek,
    hour(ts)::INT AS ts_hour, round(sin(2 * pi() * month(ts) / 12), 6) AS ts_month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS ts_month_cos,
    round(sin(2 * pi() * day(ts) / 31), 6) AS ts_day_sin, round(cos(2 * pi() * day(ts) / 31), 6) AS ts_day_cos FROM events""",
)
def enc5(spark, sf):
    return rounded(encode.expand_datetime(table(spark, sf, "events").select("event_id", "ts"), "ts"))


@query(
    "enc6_cyclic",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS d FROM orders),
    y AS (SELECT avg(year(d)) AS m, stddev_pop(year(d)) AS s FROM t)
    SELECT o_orderkey, coalesce(round((year(d) - m) / s, 6), 0) AS y, coalesce(round(sin(2 * pi() * (month(d) - 1) / 12), 6), 0) AS ms,
    coalesce(round(cos(2 * pi() * (month(d) - 1) / 12), 6), 0) AS mc, coalesce(round(sin(2 * pi() * (day(d) - 1) / 31), 6), 0) AS ds,
    coalesce(round(cos(2 * pi() * (isodow(d) - 1) / 7), 6), 0) AS wc FROM t, y""",
)
def enc6(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("d"))
    v = encode.cyclic_datetime(F.col("d"), encode.fit_year_scaler(t, "d"))
    out = t.select("o_orderkey", v.alias("v"))
    return rounded(out.select("o_orderkey", *[F.col("v")[i].alias(n) for i, n in ((0, "y"), (1, "ms"), (2, "mc"), (3, "ds"), (8, "wc"))]))


@query(
    "enc7_boolean",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 WHEN toxic = 1 THEN 0 ELSE 1 END AS code FROM labels""",
)
def enc7(spark, sf):
    b = F.when(F.col("doc_id") % 5 != 0, F.col("toxic") == 1)
    return table(spark, sf, "labels").select("doc_id", encode.boolean_code(b).alias("code"))


_EDGE = "CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END"


@query(
    "enc8_quantile_bins",
    f"""WITH t AS (SELECT {_K}, {_EDGE} AS price FROM lineitem),
    e AS (SELECT quantile_cont(price, [{', '.join(str(i / 100) for i in range(101))}]) AS edges, avg(price) AS m, stddev_pop(price) AS s FROM t)
    SELECT {_K}, CASE WHEN price IS NULL THEN 100 ELSE least(greatest(len(list_filter(edges, lambda v: v <= price)) - 1, 0), 99) END::INTEGER AS price_bin,
    coalesce(round((price - m) / s, 6), 0) AS price_scaled FROM t, e""",
)
def enc8(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *KEY_COLS, F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice")).alias("price")
    )
    return rounded(encode.encode_numbers(df, encode.quantile_edges(df, ["price"], 100)).drop("price"))


@query(
    "enc9_uniform_bins",
    f"""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT {_K}, least(greatest(len(list_filter(range(0, 21), lambda i: lo + i * ((hi - lo) / 20) <= l_quantity)) - 1, 0), 19)::INTEGER AS l_quantity_bin
    FROM lineitem, e""",
)
def enc9(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY_COLS, "l_quantity")
    edges = encode.uniform_edges(df, ["l_quantity"], 20)
    return df.select(*KEY_COLS, encode.bin_id(F.col("l_quantity"), edges["l_quantity"]).alias("l_quantity_bin"))


_VOCAB = """(SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (
  SELECT token FROM (SELECT coalesce(p_name, 'NaN') AS token, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1 ORDER BY n DESC, token LIMIT 38)
  UNION SELECT '<UNK>' UNION SELECT '<MASK>'))"""


@query(
    "enc10_vocabulary",
    f"""SELECT p_partkey, coalesce(token_id, (SELECT token_id FROM {_VOCAB} WHERE token = '<UNK>'))::INTEGER AS token_id FROM part LEFT JOIN {_VOCAB} ON p_name = token""",
)
def enc10(spark, sf):
    t = table(spark, sf, "part")
    vocab = encode.vocabulary(t.where("p_size <= 25"), "p_name", 40)
    return encode.encode_vocabulary(t, "p_name", vocab, "token_id").select("p_partkey", "token_id")


@query("enc11_string_code", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN (CAST('0x' || substr(md5(c_name), 1, 8) AS UBIGINT) % 10000) / 10000.0::DOUBLE ELSE 0 END AS code FROM customer")
def enc11(spark, sf):
    t = table(spark, sf, "customer")
    return t.select("c_custkey", encode.string_code(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))).alias("code"))


@query(
    "enc12_label_ids",
    """SELECT c_custkey, code FROM customer JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM
    (SELECT DISTINCT c_mktsegment AS v FROM customer)) ON c_mktsegment = v""",
)
def enc12(spark, sf):
    t = table(spark, sf, "customer")
    return encode.encode_category(t, t, "c_mktsegment", "label", "code").select("c_custkey", "code")


def _matrix_rows(spark, sf, kind):
    from pyspark.ml.functions import vector_to_array

    t = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    # fitted without one segment, which is unseen after
    known = t.where("segment is null or segment <> 'MACHINERY'")
    model = encode.fit_design(known, "c_nationkey", kind, exclude=["c_custkey"])
    return model.transform(t).select("c_custkey", vector_to_array("features").alias("v"))


_MATRIX = """WITH t AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, 'missing') AS seg, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS bal FROM customer),
  k AS (SELECT * FROM t WHERE seg <> 'MACHINERY'), m AS (SELECT quantile_cont(bal, 0.5) AS med FROM k),
  s AS (SELECT avg(coalesce(bal, med)) AS mean, stddev_pop(coalesce(bal, med)) AS dev FROM k, m),
  l AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS code FROM (SELECT DISTINCT seg FROM k)),
  j AS (SELECT c_custkey, coalesce(bal, med) AS bal, coalesce(code, -1) AS code, mean, dev FROM t CROSS JOIN m CROSS JOIN s LEFT JOIN l USING (seg))"""


@query("enc13_design_tree", _MATRIX + " SELECT c_custkey, round(bal, 6) AS acctbal, code::DOUBLE AS segment FROM j")
def enc13(spark, sf):
    out = _matrix_rows(spark, sf, "tree")
    return rounded(out.select("c_custkey", F.col("v")[0].alias("acctbal"), F.col("v")[1].alias("segment")))


@query(
    "enc13_design_linear",
    _MATRIX + """ SELECT c_custkey, round((bal - mean) / dev, 6) AS acctbal,
    list_transform(range(1, (SELECT max(code) + 1 FROM l)::BIGINT), lambda i: CASE WHEN i = code THEN 1.0 ELSE 0.0 END::DOUBLE)::VARCHAR AS levels FROM j""",
)
def enc13_linear(spark, sf):
    out = _matrix_rows(spark, sf, "linear")
    levels = F.concat(F.lit("["), F.array_join(F.transform(F.slice("v", 2, F.size("v") - 1), lambda x: x.cast("string")), ", "), F.lit("]"))
    return rounded(out.select("c_custkey", F.col("v")[0].alias("acctbal"), levels.alias("levels")))


# ---------------------------------------------------------------- whole plans

_PIP_SRC = f"(SELECT DISTINCT * FROM {MESSY})"


def _pip1_sql() -> str:
    nums = ["quantity", "price", "discount", "tax"]
    stats = ", ".join(
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, quantile_cont({c}, 0.5) AS {c}_f, quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3"
        for c in nums
    )
    fill = ", ".join(f"coalesce({c}, {c}_f) AS {c}" for c in nums)
    flags = " + ".join(
        f"CAST({c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1) AS INTEGER)" for c in nums
    )
    cells = ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}" for c in nums)
    mode = f"(SELECT returnflag FROM {_PIP_SRC} WHERE returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return f"""WITH d AS {_PIP_SRC}, p AS (SELECT {stats} FROM d),
    f AS (SELECT {_K}, {fill}, coalesce(returnflag, {mode}) AS returnflag, linestatus,
      p.* FROM d, p)
    SELECT {_K}, {cells}, returnflag, linestatus FROM f WHERE {flags} <= 2"""


@query("pip1_prepare", _pip1_sql())
def pip1(spark, sf):
    df = messy(spark, sf)
    fitted = prepare.fit_prepare(df, KEY_COLS)
    return rounded(fitted.transform(df))


@query(
    "pip1_feature_info",
    f"""SELECT unnest(['quantity','price','discount','tax','returnflag','linestatus']) AS "column",
    unnest(['numerical','numerical','numerical','numerical','categorical','categorical']) AS semantic_type FROM (SELECT count(*) FROM {MESSY})""",
)
def pip1_info(spark, sf):
    df = messy(spark, sf)
    return prepare.fit_prepare(df, KEY_COLS).feature_info(spark)


def _robust_input(spark, sf):
    t = table(spark, sf, "orders")
    return t.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderdate",
    )


_ROB = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, o_orderdate FROM orders)"""


@query(
    "pip2_robust",
    f"""WITH m AS (SELECT priority AS mp FROM {_ROB} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM {_ROB}),
    f AS (SELECT o_orderkey, o_orderdate, coalesce(priority, mp) AS priority,
      least(greatest(coalesce(price, q2), q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS price FROM {_ROB}, m, q),
    s AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c FROM f),
    n AS (SELECT priority AS k, count(*) AS n FROM f GROUP BY 1)
    SELECT o_orderkey, round((price - b) / (c - a), 6) AS price, n AS priority, year(o_orderdate)::INT AS o_orderdate_year,
    month(o_orderdate)::INT AS o_orderdate_month, (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek,
    round(sin(2 * pi() * day(o_orderdate) / 31), 6) AS o_orderdate_day_sin
    FROM f, s, n WHERE priority = k""",
)
def pip2(spark, sf):
    df = _robust_input(spark, sf)
    out = prepare.fit_robust(df, exclude=["o_orderkey"]).transform(df)
    return rounded(out.select("o_orderkey", "price", "priority", "o_orderdate_year", "o_orderdate_month",
                              "o_orderdate_dayofweek", "o_orderdate_day_sin"))


@query(
    "pip2_action_log",
    f"""SELECT 'fill' AS step, 'price' AS "column", count(*) - count(price) AS n_cells FROM {_ROB}
    UNION ALL SELECT 'fill', 'priority', count(*) - count(priority) FROM {_ROB}
    UNION ALL SELECT 'clip', 'price', count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) FROM {_ROB},
      (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM {_ROB})""",
)
def pip2_log(spark, sf):
    df = _robust_input(spark, sf)
    return prepare.fit_robust(df, exclude=["o_orderkey"]).action_log(df)




@query(
    "pip3_repair",
    f"""WITH q AS (SELECT quantile_cont(acctbal, 0.5) AS f FROM {DOUBLED} WHERE segment IS NOT NULL),
    b AS (SELECT quantile_cont(coalesce(acctbal, f), 0.25) AS q1, quantile_cont(coalesce(acctbal, f), 0.75) AS q3 FROM {DOUBLED}, q WHERE segment IS NOT NULL)
    SELECT round(least(greatest(coalesce(acctbal, f), q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS acctbal, 0.0::DOUBLE AS score, segment
    FROM {DOUBLED}, q, b WHERE segment IS NOT NULL""",
)
def pip3(spark, sf):
    df = doubled(spark, sf).select("c_custkey", F.col("acctbal").cast("string").alias("acctbal"), "segment")
    out, _ = prepare.repair(df, ["acctbal", "score"], {"acctbal": "float"}, "segment")
    return rounded(out)


@query(
    "pip3_repair_log",
    f"""SELECT 'added_column' AS action, 'score' AS "column", 1 AS n UNION ALL SELECT 'dropped_column', 'c_custkey', 1
    UNION ALL SELECT 'coerced', 'acctbal', 1 UNION ALL SELECT 'filled', 'acctbal', count(*) - count(acctbal) FROM {DOUBLED} WHERE segment IS NOT NULL
    UNION ALL SELECT 'filled', 'score', count(*) FROM {DOUBLED} WHERE segment IS NOT NULL""",
)
def pip3_log(spark, sf):
    df = doubled(spark, sf).select("c_custkey", F.col("acctbal").cast("string").alias("acctbal"), "segment")
    _, log = prepare.repair(df, ["acctbal", "score"], {"acctbal": "float"}, "segment")
    return log
