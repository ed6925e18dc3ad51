"""Schema helpers: which columns are numeric, what counts as missing, casts for statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_scalar(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or is_temporal(dtype) or isinstance(dtype, (T.StringType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_scalar(f.dataType)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN folded into null, so that both mean "missing"."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def as_number(df: DataFrame, name: str) -> Column:
    """Double view of a numeric or boolean column for statistics (decimals are widened too)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return present(df, name).cast("double")


def dtype_family(dtype: T.DataType) -> str:
    """Storage family used by the dtype rules: integer, float, boolean, datetime, string, other."""
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_temporal(dtype):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


def number_array(values: Sequence[float]) -> Column:
    """Sorted or unsorted numbers as one array literal; one call, however many there are."""
    text = (f"{float(v)!r}D" if math.isfinite(v) else f"double('{float(v)!r}')" for v in values)
    return F.expr(f"array({', '.join(text)})")


def literal_map(mapping: dict) -> Column:
    """A small driver-side dict as a map literal."""
    cells = []
    for k, v in mapping.items():
        cells += [F.lit(k), F.lit(v)]
    return F.create_map(*cells)
