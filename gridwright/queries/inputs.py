"""Readers, catalogue, sinks and generators. Files are written from the tables into fresh folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import profile
from gridwright.plans.storage import scratch_path
from gridwright.queries.base import MESSY, MESSY_NUMS, messy, query, rounded, table
from gridwright.sources import generators as gen
from gridwright.sources import readers, sinks
from gridwright.sources.catalog import Catalog

_CUST = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_CUST_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _landed(spark, sf, fmt, suffix, **options):
    path = scratch_path(spark, "landed") + suffix
    table(spark, sf, "customer").write.options(**options).format(fmt).save(path)
    return path


@query("src1_csv", _CUST)
def src1(spark, sf):
    return readers.read_csv(spark, _landed(spark, sf, "csv", ".csv", header=True), _CUST_SCHEMA)


@query("src1_info", "SELECT 'customer' AS name, 'csv' AS format, count(*) AS n_rows, 5 AS n_columns FROM customer")
def src1_info(spark, sf):
    path = _landed(spark, sf, "csv", ".csv", header=True)
    return readers.info(readers.read_csv(spark, path, _CUST_SCHEMA), "customer", path, "csv").drop("path", "n_bytes")


@query("src2_parquet", "SELECT 'orders' AS name, 'parquet' AS format, count(*) AS n_rows, 6 AS n_columns FROM orders")
def src2(spark, sf):
    path = f"{sf}/orders.parquet"
    return readers.info(readers.read_parquet(spark, path), "orders", path, "parquet").drop("path", "n_bytes")


@query("src3_json", _CUST)
def src3(spark, sf):
    return readers.read_json(spark, _landed(spark, sf, "json", ".json"), _CUST_SCHEMA)


@query("src4_auto", "SELECT kind, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer, (SELECT unnest(['csv', 'json', 'parquet']) AS kind) GROUP BY 1")
def src4(spark, sf):
    out = None
    for kind in ("csv", "json", "parquet"):
        opts = {"header": True} if kind == "csv" else {}
        df = readers.load_auto(spark, _landed(spark, sf, kind, f".{kind}", **opts))
        row = df.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "src5_target_summary",
    """SELECT o_orderstatus AS item, count(*)::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT 'mean', round(avg(o_totalprice), 4) FROM orders
    UNION ALL SELECT 'std', round(stddev_samp(o_totalprice), 4) FROM orders UNION ALL SELECT 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders""",
)
def src5(spark, sf):
    path = f"{sf}/orders.parquet"
    _, a = readers.load_with_target(spark, path, "o_orderstatus", "classification")
    _, b = readers.load_with_target(spark, path, "o_totalprice", "regression")
    return rounded(a.unionByName(b), 4)


@query("src6_delimited", "SELECT p_partkey, p_size, p_retailprice FROM part UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def src6(spark, sf):
    names, kinds = ["p_partkey", "p_size", "p_retailprice"], ["long", "int", "double"]
    a = scratch_path(spark, "blanks")
    table(spark, sf, "part").select(F.concat_ws("   ", F.lit(""), *[F.col(c).cast("string") for c in names])).write.text(a)
    b = scratch_path(spark, "semicolon")
    table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").write.option("sep", ";").csv(b)
    return readers.read_delimited(spark, a, names, r"\s+", kinds).unionByName(readers.read_delimited(spark, b, names, ";", kinds))


# columns of every given table
_WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3,
    "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query("src7_list", " UNION ALL ".join(f"SELECT '{t}' AS name, 'parquet' AS format, (SELECT count(*) FROM {t}) AS n_rows, {n} AS n_columns" for t, n in _WIDTHS.items()))
def src7(spark, sf):
    return readers.list_datasets(spark, sf)


# ---------------------------------------------------------------- catalogue


def _catalog(spark, sf) -> Catalog:
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    listed = readers.list_datasets(spark, sf).collect()
    cat.register_many([
        {"name": r["name"], "source": "local", "path": f"{sf}/{r['name']}.parquet", "n_rows": r["n_rows"], "n_columns": r["n_columns"],
         "task_type": "regression" if r["name"] in ("orders", "part") else "classification", "description": f"Table of {r['name']}"}
        for r in listed
    ])
    cat.register("orders", "local", f"{sf}/orders.parquet", n_rows=1, n_columns=6, task_type="regression", description="Sales, replaced entry", owner="me")
    cat.remove("region")
    return cat


_NAMES = ["nation", "customer", "supplier", "part", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(
    "cat1_register",
    "SELECT 'orders' AS name, 1 AS n_rows, 6 AS n_columns, '{\"owner\": \"me\"}' AS metadata UNION ALL "
    + " UNION ALL ".join(f"SELECT '{n}', count(*), (SELECT count(*)::INT FROM (DESCRIBE {n})), '{{}}' FROM {n}" for n in _NAMES),
)
def cat1(spark, sf):
    return _catalog(spark, sf).entries().select("name", "n_rows", "n_columns", "metadata")


@query("cat2_get", "SELECT n_name, n_nationkey FROM nation")
def cat2(spark, sf):
    return _catalog(spark, sf).load("nation").select("n_name", "n_nationkey")


@query("cat3_search", "SELECT 'orders' AS name FROM orders HAVING count(*) > 0")
def cat3(spark, sf):
    return _catalog(spark, sf).search("SALES").select("name")


@query("cat4_by_task", "SELECT unnest(['orders', 'part']) AS name FROM (SELECT count(*) FROM orders)")
def cat4(spark, sf):
    return _catalog(spark, sf).by_task("regression").select("name")


# a registered table that is not there is generated in its registered shape
@query(
    "cat5_load_many",
    "SELECT 'part' AS name, 'p_retailprice' AS target, count(*) AS n_rows FROM part UNION ALL SELECT 'orders', 'o_orderpriority', count(*) FROM orders UNION ALL SELECT 'gone', 'target', count(*) FROM part",
)
def cat5(spark, sf):
    cat = _catalog(spark, sf)
    n = table(spark, sf, "part").count()
    cat.register("gone", "local", f"{sf}/gone.parquet", n_rows=n, n_columns=4, task_type="regression")
    loaded = cat.load_many(["part", "orders", "gone"])
    out = None
    for name, (df, target) in loaded.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(target).alias("target"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- sinks


@query("snk1_cached", "SELECT c_custkey, c_acctbal FROM customer")
def snk1(spark, sf):
    root = scratch_path(spark, "cache")
    build = lambda: table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    sinks.cached(spark, root, "my data/customers", {"v": 1}, build)
    return sinks.cached(spark, root, "my data/customers", {"v": 1}, lambda: build().limit(0))


@query("snk2_results", "SELECT kind, o_orderstatus AS model, count(*) AS value FROM orders, (SELECT unnest(['json', 'csv']) AS kind) GROUP BY 1, 2")
def snk2(spark, sf):
    res = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.count("*").alias("value"))
    out = None
    for kind in ("json", "csv"):
        path = scratch_path(spark, "results")
        sinks.save_results(res, path, kind)
        back = sinks.load_results(spark, path, "model string, value long", kind).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "snk3_profile",
    f"""WITH c AS (UNPIVOT (SELECT quantity::DOUBLE AS quantity, price::DOUBLE AS price, discount::DOUBLE AS discount, tax::DOUBLE AS tax FROM {MESSY}) ON quantity, price, discount, tax INTO NAME "column" VALUE v),
    n AS (SELECT count(*)::DOUBLE AS n FROM lineitem), s AS (SELECT "column", count(*)::DOUBLE AS k, count(DISTINCT v)::DOUBLE AS u, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, quantile_cont(v, 0.25) AS q25,
      quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS hi, skewness(v) AS skew, kurtosis(v) AS kurt FROM c GROUP BY 1)
    SELECT "column", unnest(['n_rows', 'n_missing', 'missing_pct', 'n_unique', 'completeness_pct', 'mostly_missing', 'is_constant', 'nearly_unique', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max', 'skew', 'kurtosis']) AS metric,
      round(unnest([n, n - k, 100 * (n - k) / n, u, 100 - 100 * (n - k) / n, (100 * (n - k) / n > 50)::INT, (u <= 1)::INT, (u > 0.9 * n)::INT, mean, std, lo, q25, q50, q75, hi, skew, kurt]), 4) AS value FROM s, n""",
)
def snk3(spark, sf):
    path = scratch_path(spark, "profile")
    sinks.save_profile(profile.full_profile(messy(spark, sf), MESSY_NUMS), path)
    back = spark.read.schema("column string, metrics map<string, double>").json(path)
    return rounded(back.select("column", F.explode("metrics").alias("metric", "value")), 4)


# ---------------------------------------------------------------- generators: ids come from a table


def _ids(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


def _g_sql(salt: str, seed: int = 42, key: str = "id") -> str:
    h = f"md5(concat_ws('|', {key}, '{salt}', '{seed}'))"
    u = lambda at: f"(CAST(CAST('0x' || substr({h}, {at}, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"
    return f"(sqrt(-2 * ln(greatest({u(1)}, 2.0 ** -52))) * cos(2 * pi() * {u(17)}))"


def _u_sql(salt: str, seed: int = 42) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', id, '{salt}', '{seed}')), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"


def _pick_sql(n: int, salt: str, seed: int = 42) -> str:
    return f"CAST(floor({_u_sql(salt, seed)} * {n}) AS INTEGER)"


_GEN_IDS = "(SELECT o_orderkey AS id FROM orders)"


def _class_sql(n_features: int, n_classes: int, sep: float, flip: float, seed: int, more: str = "") -> str:
    """Gaussian classes around corners whose signs are fixed numbers."""
    signs = lambda j: "[" + ", ".join("1.0" if gen._weight("corner", c, j, seed=seed) >= 0 else "-1.0" for c in range(n_classes)) + "]"
    y = _pick_sql(n_classes, "class", seed)
    cells = ", ".join(f"round({_g_sql(f'x{j}', seed)} + {sep!r} * ({signs(j)})[{y} + 1], 6) AS feature_{j}" for j in range(n_features))
    return f"SELECT id, {cells}, CASE WHEN {_u_sql('flip', seed)} < {flip!r} THEN {_pick_sql(n_classes, 'redraw', seed)} ELSE {y} END AS target{more} FROM {_GEN_IDS}"


def _mixed_sql(n_numeric: int, n_categorical: int, n_values: int) -> str:
    nums = ", ".join(f"{_g_sql(f'n{j}')} AS num_feature_{j}" for j in range(n_numeric))
    cats = ", ".join(f"'category_' || {_pick_sql(n_values, f'c{j}')} AS cat_feature_{j}" for j in range(n_categorical))
    score = " + ".join(_g_sql(f"n{j}") for j in range(min(3, n_numeric)))
    return f"""(SELECT * EXCLUDE (s, cut), (s > cut)::INTEGER AS target FROM (SELECT *, quantile_cont(s, 0.5) OVER () AS cut FROM (
      SELECT id, {nums}, {cats}, {score} + 0.1 * {_g_sql('score')} AS s FROM {_GEN_IDS})))"""


def _messy_sql(n_numeric: int, n_categorical: int) -> str:
    cells = [
        f"CASE WHEN {_u_sql(f'null-num_feature_{j}')} >= 0.1 THEN round(CASE WHEN {_u_sql(f'out-num_feature_{j}')} < 0.05 THEN num_feature_{j} * 10 ELSE num_feature_{j} END, 6) END AS num_feature_{j}" for j in range(n_numeric)
    ] + [f"CASE WHEN {_u_sql(f'null-cat_feature_{j}')} >= 0.1 THEN cat_feature_{j} END AS cat_feature_{j}" for j in range(n_categorical)]
    return f"""SELECT id, {', '.join(cells)}, target,
      CASE WHEN {_u_sql('mixed')} < 0.7 THEN CAST(round({_g_sql('mt')}, 3) + 0.0 AS VARCHAR) WHEN {_u_sql('mixed')} < 0.9 THEN 'text' ELSE 'N/A' END AS mixed_types,
      CASE WHEN {_u_sql('bad-date')} < 0.01 THEN 'invalid_date' ELSE strftime(DATE '2023-01-01' + {_pick_sql(365, 'day')}, '%Y-%m-%d') END AS datetime_col FROM {_mixed_sql(n_numeric, n_categorical, 100)}"""


@query("gen1_classification", _class_sql(5, 3, 1.0, 0.01, 42))
def gen1(spark, sf):
    return rounded(gen.classification(_ids(spark, sf), "id", 5, 3))


@query(
    "gen1_regression",
    "SELECT id, " + ", ".join(f"round({_g_sql(f'x{j}')}, 5) AS feature_{j}" for j in range(3))
    + ", round(" + " + ".join(f"{100.0 * gen._weight('coef', j, seed=42)!r} * {_g_sql(f'x{j}')}" for j in range(3)) + f" + 0.1 * {_g_sql('noise')}, 5) AS target FROM (SELECT o_orderkey AS id FROM orders)",
)
def gen1_regression(spark, sf):
    return rounded(gen.regression(_ids(spark, sf), "id", 3), 5)


@query("gen2_mixed", f"SELECT id, {', '.join(f'round(num_feature_{j}, 6) AS num_feature_{j}' for j in range(3))}, cat_feature_0, cat_feature_1, target FROM {_mixed_sql(3, 2, 5)}")
def gen2(spark, sf):
    return rounded(gen.mixed(_ids(spark, sf), "id", 3, 2))


@query("gen3_domains", " UNION ALL ".join(_class_sql(3, 2, 0.5 + 0.25 * i, 0.01 * (i + 1), 42 + i, f", '{d}' AS domain") for i, d in enumerate("abc")))
def gen3(spark, sf):
    return rounded(gen.domains(_ids(spark, sf), "id", ["a", "b", "c"], 3))


@query("gen4_messy", _messy_sql(3, 2))
def gen4(spark, sf):
    return rounded(gen.messy(_ids(spark, sf), "id", 3, 2))
