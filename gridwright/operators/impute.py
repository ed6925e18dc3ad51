"""Missing values: fitted constants, carry forward/backward, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.columns import as_number, is_numeric, numeric_columns, present, string_columns
from gridwright.operators.profile import column_rows, missing_count, value_counts
from gridwright.plans.ordered import MAX_GROUP_ROWS, carry_last, order_position
from gridwright.plans.quantiles import fit_median


def fit_mean(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(as_number(df, c)).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def fit_mode(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value, the smallest on ties; counted by key, so no task holds all values. All
    string columns share one pass."""
    out: dict[str, object] = {c: None for c in cols}
    texts = [c for c in cols if c in string_columns(df)]
    best = F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value")
    if texts:
        known = value_counts(df, texts).where(F.col("value").isNotNull())
        out |= {r["column"]: r["value"] for r in known.groupBy("column").agg(best).collect()}
    for c in cols:
        if c not in texts:
            counts = df.select(present(df, c).alias("value")).where("value is not null").groupBy("value").count()
            out[c] = counts.agg(best).first()[0]
    return out


def fit_knn(df: DataFrame, cols: Sequence[str], k: int = 5) -> dict[str, float]:
    """Nearest-neighbour strategy fitted on one column at a time: a row that misses its only
    coordinate has no distance to any other, so the fill value is the column mean."""
    return fit_mean(df, cols)


def fit_fill(df: DataFrame, strategies: dict[str, str]) -> dict[str, object]:
    """Fill value per column; strategies: mean, median, mode, knn, constant."""
    pick = lambda *names: [c for c, s in strategies.items() if s in names]
    nums = set(numeric_columns(df))
    values: dict[str, object] = {}
    values |= fit_mean(df, pick("mean", "knn"))
    values |= fit_median(df, pick("median"))
    values |= fit_mode(df, pick("mode"))
    values |= {c: (0.0 if c in nums else "Unknown") for c in pick("constant")}
    return values


def default_strategies(df: DataFrame, numeric: str = "median", categorical: str = "mode") -> dict[str, str]:
    return {c: numeric for c in numeric_columns(df)} | {c: categorical for c in string_columns(df)}


def filled(df: DataFrame, c: str, value) -> Column:
    if value is None:
        return F.col(c)
    x = present(df, c)
    dtype = df.schema[c].dataType
    fits = not isinstance(dtype, T.IntegralType) or not isinstance(value, float) or value.is_integer()
    if is_numeric(dtype) and not fits:
        return F.coalesce(x.cast("double"), F.lit(value)).alias(c)
    return F.coalesce(x, F.lit(value).cast(dtype)).alias(c)


def apply_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.select(*[filled(df, c, values[c]) if c in values else F.col(c) for c in df.columns])


def fill_log(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Cells that the fitted values would fill, per column."""
    return column_rows(df, [c for c in values if c in df.columns], {"n_filled": missing_count(df)})


def fill_constants(df: DataFrame, number: float = 0.0, text: str = "Unknown") -> DataFrame:
    """Numbers get 0, strings a word; datetimes and other types are left alone."""
    values: dict[str, object] = {c: number for c in numeric_columns(df)}
    values |= {c: text for c in string_columns(df)}
    return apply_fill(df, values)


def recovery_values(df: DataFrame, numeric: str = "median", target: str | None = None) -> dict[str, object]:
    """Median or mean for numbers, mode otherwise, 'unknown' when a column has no value at all."""
    strategies = {c: s for c, s in default_strategies(df, numeric).items() if c != target}
    values = fit_fill(df, strategies)
    return {
        c: (v if v is not None else (0.0 if strategies[c] == numeric else "unknown")) for c, v in values.items()
    }


def directional_fill(
    df: DataFrame,
    cols: Sequence[str],
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    backward: bool = False,
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Forward (or backward) fill inside each group in the given order."""
    values = {f"__f_{c}": present(df, c) for c in cols}
    out = carry_last(df, group_cols, order_cols, values, backward, max_group)
    return out.select(*[F.col(f"__f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def interpolate(
    df: DataFrame,
    cols: Sequence[str],
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Linear by row position; trailing gaps repeat the last value, leading gaps stay missing."""
    placed = order_position(df, group_cols, order_cols, out="__p", max_group=max_group)
    point = lambda c: F.when(
        present(df, c).isNotNull(), F.struct(F.col("__p").alias("p"), present(df, c).cast("double").alias("v"))
    )
    out = carry_last(placed, group_cols, order_cols, {f"__a_{c}": point(c) for c in cols}, False, max_group)
    out = carry_last(out, group_cols, order_cols, {f"__b_{c}": point(c) for c in cols}, True, max_group)

    def value(c):
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        span = F.when(b["p"] > a["p"], b["p"] - a["p"])
        between = a["v"] + (b["v"] - a["v"]) * (F.col("__p") - a["p"]) / span
        return F.coalesce(present(df, c).cast("double"), between, a["v"]).alias(c)

    return out.select(*[value(c) if c in cols else F.col(c) for c in df.columns])
