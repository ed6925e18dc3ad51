"""Cached copies, result tables and reports."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def safe_name(name: str) -> str:
    """Letters, digits, dash and underscore."""
    return re.sub(r"[^0-9A-Za-z_-]", "_", name)


def config_hash(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(
    spark: SparkSession, root: str, name: str, config: dict, build: Callable[[], DataFrame], force_refresh: bool = False
) -> DataFrame:
    """Parquet copy under root/<name>/<config hash>; built once, read back afterwards."""
    path = f"{root.rstrip('/')}/{safe_name(name)}/{config_hash(config)}"
    if not force_refresh:
        try:
            return spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def load_results(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def save_profile(profile: DataFrame, path: str) -> None:
    """One JSON line per column: metric -> value."""
    from pyspark.sql import functions as F

    rows = profile.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    rows.write.mode("overwrite").json(path)
