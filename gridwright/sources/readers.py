"""File readers. Each returns the table; `info` describes what was read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header; give a schema for large inputs, inference costs a pass."""
    reader = spark.read.option("header", options.pop("header", True)).options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def load_auto(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Reader by suffix; an unknown suffix is an error."""
    kind = FORMATS.get(suffix(path))
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "json":
        return read_json(spark, path, schema)
    return read_csv(spark, path, schema, **({"sep": "\t"} if suffix(path) == ".tsv" else {}))


def read_delimited(
    spark: SparkSession, path: str, names: Sequence[str], sep: str = ",", types: Sequence[str] | None = None
) -> DataFrame:
    """Header-less file with configured names; a separator of ``\\s+`` splits on runs of blanks."""
    kinds = list(types or ["string"] * len(names))
    if sep != r"\s+":
        schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds))
        return spark.read.schema(schema).option("sep", sep).option("header", False).csv(path)
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(
        *[cells[i].try_cast(t).alias(n) for i, (n, t) in enumerate(zip(names, kinds))]
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def info(df: DataFrame, name: str, path: str, fmt: str) -> DataFrame:
    """One row: name, format, path, bytes, rows, columns."""
    size = files(df.sparkSession, path).agg(F.sum("length")).first()[0]
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("name"), F.lit(fmt).alias("format"), F.lit(path).alias("path"), F.lit(size).cast("long").alias("n_bytes"),
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
    )


def target_summary(df: DataFrame, target: str, task: str) -> DataFrame:
    """(item, value): class counts, or mean, std, min and max; the target must exist."""
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    if task == "classification":
        return df.groupBy(F.col(target).cast("string").alias("item")).agg(F.count("*").cast("double").alias("value"))
    x = F.col(target).cast("double")
    stats = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return stats.unpivot([], stats.columns, "item", "value")


def load_with_target(spark: SparkSession, path: str, target: str, task: str, schema=None) -> tuple[DataFrame, DataFrame]:
    df = load_auto(spark, path, schema)
    return df, target_summary(df, target, task)


def list_datasets(spark: SparkSession, directory: str) -> DataFrame:
    """(name, format, n_rows, n_columns) of the data sets directly below a directory (a file, or a
    folder of part files). Parquet counts come from the footers; text formats are counted by Spark."""
    base = directory.rstrip("/")
    below = F.regexp_extract("path", "^.*?" + re.escape(base.split(":", 1)[-1]) + "/([^/]+)", 1)
    # one row per data set, not per file
    names = [r[0] for r in files(spark, directory).select(below.alias("n")).distinct().collect()]
    rows = []
    for n in sorted(names):
        kind = FORMATS.get(suffix(n))
        if kind is None:
            continue
        df = load_auto(spark, f"{base}/{n}")
        rows.append((n.rsplit(".", 1)[0], kind, df.count(), len(df.columns)))
    return spark.createDataFrame(rows, "name string, format string, n_rows long, n_columns int")
