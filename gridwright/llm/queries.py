"""The registered queries of this subpackage and their SQL. Each applies one operator to a whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("query_text", "query_models", "query_vectors", "query_conversations")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load():
    """All queries and their SQL."""
    for name in MODULES:
        importlib.import_module(f"gridwright.llm.{name}")
    return dict(QUERIES), dict(SQL)
