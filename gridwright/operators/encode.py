"""Encoders. A fitted vocabulary is a DataFrame joined back; small fitted numbers become literals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.bisect import edges_passed
from gridwright.functions.columns import as_number, numeric_columns, present, string_columns
from gridwright.operators.scale import fit_scaler
from gridwright.plans.ordered import prefix_sums
from gridwright.plans.quantiles import fit_median, fit_quantiles
from gridwright.plans.storage import written

UNK, MASK, NAN = "<UNK>", "<MASK>", "NaN"


class UnseenCategory(ValueError):
    """A category that was not there at fit time, under the 'error' policy."""


def lookup(df: DataFrame, column: str, mapping: DataFrame, out: str, default) -> DataFrame:
    """category -> value join with a default for unseen ones. `mapping` has (key, value), unique
    keys. No broadcast hint: Spark decides by size, and AQE splits a hot key otherwise."""
    m = mapping.select(F.col("key").alias("__k"), F.col("value").alias("__v"))
    joined = df.join(m, F.col(column) == F.col("__k"), "left")
    return joined.withColumn(out, F.coalesce(F.col("__v"), F.lit(default))).drop("__k", "__v")


def label_mapping(df: DataFrame, column: str) -> DataFrame:
    """Codes 0.. in sorted order of the distinct values; ranked in range segments."""
    values = df.select(F.col(column).alias("key")).where(F.col("key").isNotNull()).distinct()
    return prefix_sums(values, [], ["key"], {"value": F.lit(1)}).select(
        "key", (F.col("value") - 1).cast("long").alias("value")
    )


def first_seen_mapping(df: DataFrame, column: str, order_cols: Sequence[str]) -> DataFrame:
    """Codes 0.. in order of first appearance under an explicit row order."""
    first = (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
        .agg(F.min(F.struct(*order_cols)).alias("at"))
    )
    return prefix_sums(first, [], ["at", "key"], {"value": F.lit(1)}).select(
        "key", (F.col("value") - 1).cast("long").alias("value")
    )


def frequency_mapping(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
        .agg(F.count("*").alias("value"))
    )


def target_mapping(df: DataFrame, column: str, target: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
        .agg(F.avg(as_number(df, target)).alias("value"))
    )


def default_code(mapping: DataFrame, method: str, unseen: str = "ignore"):
    """Code of an unseen category: label -1 (0 with most_frequent), frequency 0 (the maximum with
    most_frequent), target the unweighted mean of the category means."""
    if method == "target":
        return mapping.agg(F.avg("value")).first()[0]
    if method == "frequency":
        return mapping.agg(F.max("value")).first()[0] if unseen == "most_frequent" else 0
    return 0 if unseen == "most_frequent" else -1


def encode_category(
    train: DataFrame, df: DataFrame, column: str, method: str, out: str,
    target: str | None = None, unseen: str = "ignore",
) -> DataFrame:
    """Fit on `train`, apply to `df`; method: label, frequency or target."""
    fit = {"label": label_mapping, "frequency": frequency_mapping}
    mapping = target_mapping(train, column, target) if method == "target" else fit[method](train, column)
    if unseen == "error":
        new = df.where(F.col(column).isNotNull()).join(
            mapping, F.col(column) == mapping["key"], "left_anti"
        )
        hit = new.select(column).limit(1).collect()
        if hit:
            raise UnseenCategory(f"{column}: {hit[0][0]!r}")
    return lookup(df, column, mapping, out, default_code(mapping, method, unseen))


def fit_categories(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """Sorted distinct values for one-hot columns; more than `limit` cannot become columns."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories; use one_hot_sparse")
    return sorted(r[0] for r in rows)


def one_hot_sparse(df: DataFrame, column: str, mapping: DataFrame, out: str | None = None) -> DataFrame:
    """{column}_size and {column}_index: the one-hot vector as its length and the place of its 1, from `label_mapping`. Any number of
    categories; a missing or unseen one has no place, the vector of zeros."""
    name = out or column
    coded = lookup(df, column, mapping, f"{name}_index", -1)
    size = mapping.agg(F.count("*").cast("int")).first()[0]
    index = F.col(f"{name}_index")
    return coded.withColumn(f"{name}_index", F.when(index >= 0, index).cast("int")).withColumn(f"{name}_size", F.lit(size))


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    cells = [F.coalesce((F.col(column) == c).cast("int"), F.lit(0)).alias(f"{column}_{c}") for c in categories]
    return df.select(*[c for c in df.columns if c != column], *cells)


def expand_datetime(df: DataFrame, column: str) -> DataFrame:
    """year, month, day, dayofweek (Monday 0), hour and the cycles of month and day."""
    t = F.col(column)
    two_pi = 2.0 * math.pi
    p = lambda s: f"{column}_{s}"
    cells = [
        F.year(t).alias(p("year")), F.month(t).alias(p("month")), F.dayofmonth(t).alias(p("day")),
        F.weekday(t).alias(p("dayofweek")), F.hour(t).alias(p("hour")),
        F.sin(two_pi * F.month(t) / 12).alias(p("month_sin")), F.cos(two_pi * F.month(t) / 12).alias(p("month_cos")),
        F.sin(two_pi * F.dayofmonth(t) / 31).alias(p("day_sin")), F.cos(two_pi * F.dayofmonth(t) / 31).alias(p("day_cos")),
    ]
    return df.select(*[c for c in df.columns if c != column], *cells)


def fit_year_scaler(df: DataFrame, column: str) -> tuple[float, float]:
    row = df.agg(F.avg(F.year(column)).alias("m"), F.stddev_pop(F.year(column)).alias("s")).first()
    return row["m"], row["s"] or 1.0


def cyclic_datetime(c: Column, year_scaler: tuple[float, float]) -> Column:
    """Nine numbers: scaled year, sin/cos of month, day, hour, weekday; zeros for a missing date."""
    m, s = year_scaler
    turn = lambda x, n: 2.0 * math.pi * x / n
    angles = [turn(F.month(c) - 1, 12), turn(F.dayofmonth(c) - 1, 31), turn(F.hour(c), 24), turn(F.weekday(c), 7)]
    cells = [(F.year(c) - F.lit(m)) / F.lit(s)]
    for a in angles:
        cells += [F.sin(a), F.cos(a)]
    return F.when(c.isNotNull(), F.array(*cells)).otherwise(F.array_repeat(F.lit(0.0), 9))


def boolean_code(c: Column) -> Column:
    """true 0, false 1, missing 2."""
    return F.when(c.isNull(), 2).when(c, 0).otherwise(1)


def quantile_edges(df: DataFrame, cols: Sequence[str], n_bins: int = 100) -> dict[str, list[float]]:
    return fit_quantiles(df, cols, [i / n_bins for i in range(n_bins + 1)])


def uniform_edges(df: DataFrame, cols: Sequence[str], n_bins: int = 100) -> dict[str, list[float]]:
    row = df.agg(
        *[F.min(as_number(df, c)).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.max(as_number(df, c)).alias(f"b{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: [float(v) for v in np.linspace(row[f"a{i}"], row[f"b{i}"], n_bins + 1)] for i, c in enumerate(cols)}


def bin_id(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin, clipped to the outer bins; a missing value gets the bin after the last."""
    n = len(edges) - 1
    inner = F.least(F.greatest(edges_passed(x, edges) - 1, F.lit(0)), F.lit(n - 1))
    return F.when(x.isNull(), F.lit(n)).otherwise(inner).cast("int")


def encode_numbers(df: DataFrame, edges: dict[str, list[float]], normalization: str = "standard", scaler: dict[str, tuple] | None = None) -> DataFrame:
    """{col}_bin and {col}_scaled (0 for a missing value) per column; the scaler is fitted on `df` unless given."""
    scaler = fit_scaler(df, list(edges), normalization) if scaler is None else scaler
    cells = []
    for c, e in edges.items():
        a, s = scaler[c]
        x = as_number(df, c)
        cells += [bin_id(x, e).alias(f"{c}_bin"), F.coalesce((x - a) / s, F.lit(0.0)).alias(f"{c}_scaled")]
    return df.select("*", *cells)


def vocabulary(df: DataFrame, column: str, max_size: int = 10_000) -> DataFrame:
    """(token, token_id): the most frequent values plus two specials, ids in sorted order.

    The table never exceeds `max_size` rows: the top-k runs before any ordering.
    """
    text = F.coalesce(present(df, column).cast("string"), F.lit(NAN)).alias("token")
    counts = df.select(text).groupBy("token").count()
    top = counts.orderBy(F.col("count").desc(), F.col("token")).limit(max_size - 2).select("token")
    spark = df.sparkSession
    specials = spark.range(2).select(F.when(F.col("id") == 0, UNK).otherwise(MASK).alias("token"))
    every = top.unionByName(specials).distinct()
    # at most max_size rows in this ordering
    w = Window.partitionBy(F.lit(0)).orderBy("token")
    return every.select("token", (F.row_number().over(w) - 1).cast("int").alias("token_id"))


def encode_vocabulary(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    unk = vocab.where(F.col("token") == UNK).first()["token_id"]
    keyed = df.withColumn("__t", F.coalesce(present(df, column).cast("string"), F.lit(NAN)))
    mapping = vocab.select(F.col("token").alias("key"), F.col("token_id").alias("value"))
    return lookup(keyed, "__t", mapping, out, unk).drop("__t")


def mask_token_id(vocab: DataFrame) -> int:
    return vocab.where(F.col("token") == MASK).first()["token_id"]


def string_code(c: Column) -> Column:
    """Deterministic number in [0, 1) for a string; 0 when missing."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(10000)) / 10000.0)


MISSING = "missing"


class Design:
    """A fitted design matrix. Numbers get the median; a missing string is a level of its own.

    tree: numbers as they are and ordinal codes in sorted order, unseen -1. linear: numbers by mean and population
    deviation, and one column for each level but the first; unseen levels are all zeros. Levels live in tables, so a
    column may have any number of them."""

    def __init__(self, kind: str, medians: dict, scaler: dict, codes: dict[str, DataFrame], sizes: dict[str, int]):
        self.kind, self.medians, self.scaler, self.codes, self.sizes = kind, medians, scaler, codes, sizes

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the vector column ``features``."""
        out, parts = df, []
        for c, m in self.medians.items():
            x = F.coalesce(as_number(df, c).cast("double"), F.lit(0.0 if m is None else float(m)))
            if c in self.scaler:
                mean, scale = self.scaler[c]
                x = (x - F.lit(float(mean))) / F.lit(float(scale))
            out = out.withColumn(f"__n_{c}", x)
            parts.append(f"__n_{c}")
        for c, codes in self.codes.items():
            out = out.withColumn("__level", F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))
            out = lookup(out, "__level", codes, f"__c_{c}", -1).drop("__level")
            if self.kind == "tree":
                out = out.withColumn(f"__c_{c}", F.col(f"__c_{c}").cast("double"))
                parts.append(f"__c_{c}")
            elif self.sizes[c] > 1:
                # the slot that is left out holds the first level and the unseen ones
                last = self.sizes[c] - 1
                out = out.withColumn(f"__c_{c}", F.when(F.col(f"__c_{c}") > 0, F.col(f"__c_{c}") - 1).otherwise(last).cast("double"))
                hot = OneHotEncoder(inputCol=f"__c_{c}", outputCol=f"__h_{c}", dropLast=True)
                edges = df.sparkSession.range(2).select((F.col("id") * last).cast("double").alias(f"__c_{c}"))
                out = hot.fit(edges).transform(out)
                parts.append(f"__h_{c}")
        out = VectorAssembler(inputCols=parts, outputCol="features").transform(out)
        return out.drop(*[x for x in out.columns if x.startswith(("__n_", "__c_", "__h_"))])


def fit_design(df: DataFrame, target: str, kind: str = "tree", exclude: Sequence[str] = ()) -> Design:
    """Fits a ``Design`` on all numeric and string columns but the target and the excluded ones."""
    skip = {target, *exclude}
    nums = [c for c in numeric_columns(df) if c not in skip]
    cats = [c for c in string_columns(df) if c not in skip]
    medians = fit_median(df, nums) if nums else {}
    scaler = {}
    if kind == "linear" and nums:
        filled = df.select(*[F.coalesce(as_number(df, c).cast("double"), F.lit(0.0 if medians[c] is None else float(medians[c]))).alias(c) for c in nums])
        scaler = fit_scaler(filled, nums)
    codes, sizes = {}, {}
    for c in cats:
        levels = df.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c))
        codes[c] = written(label_mapping(levels, c), "levels")
        sizes[c] = codes[c].count()
    return Design(kind, medians, scaler, codes, sizes)
