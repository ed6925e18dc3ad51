"""Semantic types. One profile pass gathers the facts, four rule tables read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.columns import is_numeric, is_temporal, present, scalar_columns

# The date formats (with the shape a text must have before it is worth parsing) and
# the boolean words that decide a type.
DATE_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy-M-d H:m:s.SSSSSS": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{6}$",
    "yyyyMMdd": r"^\d{8}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
}
ANY_DATE = r"^\s*\d{4}(-|\s*$)"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")


def parse_as(c: Column, fmt: str) -> Column:
    """One format; a failing parse raises inside the JVM, so texts of another shape skip it."""
    return F.when(c.rlike(DATE_FORMATS[fmt]), F.try_to_timestamp(c, F.lit(fmt)))


def parse_any(c: Column) -> Column:
    return F.when(c.rlike(ANY_DATE), c.try_cast("timestamp"))


def parse_date(c: Column) -> Column:
    """First format that parses, else Spark's own timestamp cast; null when none does."""
    return F.coalesce(*[parse_as(c, f) for f in DATE_FORMATS], parse_any(c))


def storage_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_temporal(dtype):
        return "datetime"
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return "integer"
    return "number" if is_numeric(dtype) else "string"


def type_facts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: storage kind, counts, distinct count and the string/number tests.

    One pass: cells are counted by distinct value first, so each test runs once per distinct value
    and not once per row. A long text travels as its digest (it is neither a date nor a word).
    """
    cols = list(cols or scalar_columns(df))
    kinds = F.create_map(
        *[x for c in cols for x in (F.lit(c), F.lit(storage_kind(df.schema[c].dataType)))]
    )
    cells = df.select(*[present(df, c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value"
    )
    size = F.length("value")
    counts = (
        cells.select("column", F.when(size > 32, F.md5("value")).otherwise(F.col("value")).alias("v"), size.alias("len"))
        .groupBy("column", "v", "len")
        .agg(F.count("*").alias("n"))
        .withColumn("kind", kinds[F.col("column")])
    )
    v = F.when((F.col("kind") == "string") & (F.col("len") <= 32), F.col("v"))
    text = F.col("kind") == "string"
    number = F.col("kind").isin("integer", "number")
    known = F.col("v").isNotNull()
    every = lambda ok: F.coalesce(F.bool_and(F.when(known, F.coalesce(ok, F.lit(False)))), F.lit(False))
    tests = {f"d{i}": every(parse_as(v, f).isNotNull()) for i, f in enumerate(DATE_FORMATS)}
    facts = counts.groupBy("column").agg(
        F.first("kind").alias("kind"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_present"),
        F.count("v").alias("n_unique"),
        every(number & F.col("v").try_cast("double").isin(0.0, 1.0)).alias("zero_one"),
        every(text & F.trim(F.lower(v)).isin(*BOOLEAN_WORDS)).alias("bool_words"),
        (F.sum(F.col("len") * F.col("n")) / F.sum(F.when(known, F.col("n")))).alias("avg_len"),
        every(parse_any(v).isNotNull()).alias("d_any"),
        *[e.alias(k) for k, e in tests.items()],
    )
    return facts.select(
        "column", "kind", "n_rows", "n_present", "n_unique", "zero_one", "bool_words", "avg_len",
        F.greatest("d_any", *tests).alias("dates_ok"),
    )


def _label(facts: DataFrame, expr) -> DataFrame:
    return facts.select("column", expr.alias("semantic_type"), "n_present", "n_unique")


def general_types(facts: DataFrame, categorical_threshold: float = 0.05) -> DataFrame:
    """Main rule table: unknown, datetime, boolean, numerical, categorical, text."""
    k, n, u = F.col("kind"), F.col("n_present"), F.col("n_unique")
    expr = (
        F.when(n == 0, "unknown")
        .when(k == "datetime", "datetime")
        .when((k == "boolean") | F.col("zero_one"), "boolean")
        .when(k.isin("integer", "number"), "numerical")
        .when(F.col("bool_words"), "boolean")
        .when(F.col("dates_ok"), "datetime")
        .when((u / n <= categorical_threshold) | (u <= 20), "categorical")
        .when(F.col("avg_len") > 50, "text")
        .otherwise("categorical")
    )
    return _label(facts, expr)


def tokenizer_types(facts: DataFrame) -> DataFrame:
    """Storage-first rule: bool, datetime, integer with at most 10 distinct values, number, rest."""
    k = F.col("kind")
    expr = (
        F.when(k == "boolean", "boolean")
        .when(k == "datetime", "datetime")
        .when((k == "integer") & (F.col("n_unique") <= 10), "categorical")
        .when(k.isin("integer", "number"), "numerical")
        .otherwise("categorical")
    )
    return _label(facts, expr)


def column_types(facts: DataFrame) -> DataFrame:
    """Utility variant of the storage-first rule; same table."""
    return tokenizer_types(facts)


def normalizer_types(facts: DataFrame) -> DataFrame:
    """Numbers with few distinct values, both relative (< 5%) and absolute (< 20), are categorical."""
    k, u = F.col("kind"), F.col("n_unique")
    few = (u / F.when(F.col("n_rows") > 0, F.col("n_rows")) < 0.05) & (u < 20)
    expr = (
        F.when(k == "datetime", "datetime")
        .when(k.isin("integer", "number") & few, "categorical")
        .when(k.isin("integer", "number"), "numerical")
        .otherwise("categorical")
    )
    return _label(facts, expr)


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """Semantic type per column on the driver (one row per column)."""
    rows = general_types(type_facts(df, cols)).collect()
    found = {r["column"]: r["semantic_type"] for r in rows}
    return {c: found[c] for c in (cols or scalar_columns(df))}
