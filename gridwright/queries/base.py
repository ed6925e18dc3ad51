"""Registry and shared inputs of the queries. Inputs are whole tables; missing cells and duplicate
rows, which the tables lack, come from fixed expressions over the keys, the same in both engines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def union_sql(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)


# lineitem with missing cells
MESSY = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity,
  CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END AS price,
  CASE WHEN l_suppkey % 11 <> 0 THEN l_discount END AS discount,
  l_tax AS tax,
  CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END AS returnflag,
  l_linestatus AS linestatus,
  CAST(1 AS DOUBLE) AS always_one
FROM lineitem)"""
MESSY_COLS = ["quantity", "price", "discount", "tax", "returnflag", "linestatus", "always_one"]
MESSY_NUMS = ["quantity", "price", "discount", "tax"]


def messy(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    gap = lambda key, n, c: F.when(F.col(key) % n != 0, F.col(c))
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        gap("l_orderkey", 7, "l_quantity").alias("quantity"),
        gap("l_partkey", 3, "l_extendedprice").alias("price"),
        gap("l_suppkey", 11, "l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        gap("l_partkey", 5, "l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.lit(1.0).alias("always_one"),
    )


# customers with missing cells and every third row twice
DOUBLED = """(SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS acctbal,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS segment FROM customer
  UNION ALL
  SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END FROM customer WHERE c_custkey % 3 = 0)"""


def doubled(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer")
    base = t.select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("acctbal"),
        F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    return base.unionByName(base.where(F.col("c_custkey") % 3 == 0))


# events with gaps in the value
GAPPY = """(SELECT event_id, user_id, event_type, ts,
  CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events")
    return t.select(
        "event_id", "user_id", "event_type", "ts",
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"),
    )


def hash_sql(expr: str, seed: int = 42, salt: str = "") -> str:
    """md5 text of the keys, as the hash order uses it."""
    return f"md5(concat_ws('|', {expr}, '{salt}', '{seed}'))"


def uniform_sql(expr: str, salt: str, seed: int = 42, start: int = 1) -> str:
    h = hash_sql(expr, seed, salt)
    return f"(CAST(CAST('0x' || substr({h}, {start}, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"
