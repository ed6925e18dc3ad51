"""Schema checks, coercion and row/column filters. All are single projections or one aggregate."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.columns import dtype_family, present
from gridwright.operators.profile import column_rows
from gridwright.operators.types import BOOLEAN_WORDS, general_types, parse_date, type_facts

ISSUE_SCHEMA = "severity string, code string, column string, message string"
TRUE_WORDS = ("true", "yes", "1", "t", "y")


def issues_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Issues found on the driver from a schema alone (one row per column at most)."""
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def column_set_issues(df: DataFrame, expected: Sequence[str], allow_extra: bool = False) -> DataFrame:
    have = df.columns
    rows = [("error", "missing_column", c, "expected column is absent") for c in expected if c not in have]
    if not allow_extra:
        rows += [("warning", "extra_column", c, "column is not expected") for c in have if c not in expected]
    return issues_frame(df.sparkSession, rows)


def semantic_issues(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Missing, extra and wrongly typed columns against an expected semantic schema."""
    out = column_set_issues(df, list(expected))
    both = [c for c in expected if c in df.columns]
    if not both:
        return out
    want = F.create_map(*[v for c in both for v in (F.lit(c), F.lit(expected[c]))])
    typed = general_types(type_facts(df, both)).withColumn("want", want[F.col("column")])
    wrong = typed.where(F.col("semantic_type") != F.col("want")).select(
        F.lit("error").alias("severity"),
        F.lit("type_mismatch").alias("code"),
        "column",
        F.concat(F.lit("expected "), "want", F.lit(", found "), "semantic_type").alias("message"),
    )
    return out.unionByName(wrong)


class SchemaStore:
    """Named storage schemas, kept as JSON rows of a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def register(self, name: str, schema: T.StructType) -> None:
        row = self.spark.createDataFrame([(name, schema.json())], "name string, schema string")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def get(self, name: str) -> T.StructType:
        latest = (
            self.spark.read.parquet(self.path).where(F.col("name") == name)
            .agg(F.max_by("schema", "at").alias("schema")).first()
        )
        if latest["schema"] is None:
            raise KeyError(name)
        return T.StructType.fromJson(json.loads(latest["schema"]))

    def validate(self, df: DataFrame, name: str) -> DataFrame:
        """Every mismatch of columns or dtype families is an error."""
        want = {f.name: dtype_family(f.dataType) for f in self.get(name)}
        have = {f.name: dtype_family(f.dataType) for f in df.schema}
        rows = [("error", "missing_column", c, "expected column is absent") for c in want if c not in have]
        rows += [("error", "extra_column", c, "column is not expected") for c in have if c not in want]
        rows += [
            ("error", "dtype_mismatch", c, f"expected {want[c]}, found {have[c]}")
            for c in want if c in have and want[c] != have[c]
        ]
        return issues_frame(df.sparkSession, rows)


def coerce(c: Column, to: str) -> Column:
    """Cast to int, float, datetime, bool, string or category; bad values become null."""
    if to == "int":
        return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))
    if to == "float":
        return c.try_cast("double")
    if to == "datetime":
        return parse_date(c.cast("string"))
    if to == "bool":
        word = F.trim(F.lower(c.cast("string")))
        return F.when(word.isin(*BOOLEAN_WORDS), word.isin(*TRUE_WORDS))
    return c.cast("string")


def conform(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Make the table match a semantic schema: defaults for absent columns, no extras, fixed order."""
    blank = {"numerical": F.lit(0.0), "boolean": F.lit(False)}
    to = {"numerical": "float", "boolean": "bool", "datetime": "datetime"}
    return df.select(
        *[
            (coerce(F.col(c), to.get(t, "string")) if c in df.columns else blank.get(t, F.lit("Unknown"))).alias(c)
            for c, t in expected.items()
        ]
    )


def convertible(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Per column: values that would be lost by the conversion, and whether there are none."""
    bad = lambda c: F.count_if(F.col(c).isNotNull() & coerce(F.col(c), wanted[c]).isNull())
    rows = column_rows(df, list(wanted), {"n_bad": bad})
    return rows.withColumn("convertible", (F.col("n_bad") == 0).cast("int"))


def coerce_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return df.select(*[coerce(F.col(c), wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])


def align_columns(df: DataFrame, expected: Sequence[str], target: str | None = None) -> DataFrame:
    """Absent expected columns as nulls, extras dropped, target kept."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in expected]
    if target and target in df.columns and target not in expected:
        cols.append(F.col(target))
    return df.select(*cols)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value (min equals max, no distinct count needed)."""
    cols = list(cols or df.columns)
    v = lambda c: present(df, c)
    row = df.agg(
        *[(F.count(v(c)) == 0).alias(f"e{i}") for i, c in enumerate(cols)],
        *[(F.min(v(c)) == F.max(v(c))).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return [c for i, c in enumerate(cols) if row[f"e{i}"] or row[f"s{i}"]]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    any_present = F.lit(False)
    for c in df.columns:
        any_present = any_present | present(df, c).isNotNull()
    return df.where(any_present)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c in cols:
        keep = keep & present(df, c).isNotNull()
    return df.where(keep)


def split_target(df: DataFrame, target: str, key_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Features and target, both with the row key so that they can be joined again."""
    features = df.select(*[c for c in df.columns if c != target])
    return features, df.select(*key_cols, target)


def column_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where each column name occurs: both, left_only or right_only."""
    a, b = left.columns, right.columns
    rows = [(c, "both" if c in b else "left_only") for c in a] + [(c, "right_only") for c in b if c not in a]
    return left.sparkSession.createDataFrame(rows, "column string, side string")


def append_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


