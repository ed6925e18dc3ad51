"""Column and table profiles. Statistics of many columns are fused into one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.columns import as_number, numeric_columns, present, scalar_columns
from gridwright.functions.statistics import ratio, sample_kurtosis, sample_skewness
from gridwright.plans.comoments import means, pair_sums
from gridwright.plans.quantiles import fit_quantiles

BLOCK = 60  # columns per fused aggregate, to stay below the code-generation limits


def column_rows(
    df: DataFrame,
    cols: Sequence[str],
    metrics: dict[str, Callable[[str], Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    parts = []
    for at in range(0, len(cols), BLOCK):
        block = list(cols[at : at + BLOCK])
        aggs = [fn(c).alias(f"{i}:{m}") for i, c in enumerate(block) for m, fn in metrics.items()]
        wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        cells = [
            F.struct(F.lit(c).alias("column"), *[F.col(f"`{i}:{m}`").alias(m) for m in metrics])
            for i, c in enumerate(block)
        ]
        parts.append(wide.select(*by, F.explode(F.array(*cells)).alias("s")).select(*by, "s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Characters of a text that travel as they are.
NARROW = 64


def _cell(df: DataFrame, c: str, narrow: bool) -> Column:
    v = present(df, c).cast("string")
    if narrow and isinstance(df.schema[c].dataType, T.StringType):
        # the first characters and a digest stand for a long text, so that the shuffle carries a bounded cell
        return F.when(F.length(v) > NARROW, F.concat(F.substring(v, 1, NARROW), F.md5(v))).otherwise(v)
    return v


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, narrow: bool = False) -> DataFrame:
    """(column, value, count), nulls included; one partially aggregated shuffle for all columns."""
    cols = list(cols or scalar_columns(df))
    texts = df.select(*[_cell(df, c, narrow).alias(c) for c in cols])
    return (
        texts.unpivot([], cols, "column", "value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
    )


def quality(df: DataFrame, cols: Sequence[str] | None = None, high_cardinality: int = 100) -> DataFrame:
    """Per column: rows, missing, missing %, distinct, constant flag, high-cardinality flag."""
    counts = value_counts(df, cols, narrow=True)
    per = counts.groupBy("column").agg(
        F.sum("count").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("n_missing"),
        F.count("value").alias("n_unique"),
    )
    return per.select(
        "column",
        "n_rows",
        "n_missing",
        (100.0 * F.col("n_missing") / F.col("n_rows")).alias("missing_pct"),
        "n_unique",
        (F.col("n_unique") <= 1).cast("int").alias("is_constant"),
        (F.col("n_unique") > high_cardinality).cast("int").alias("is_high_cardinality"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, as one number."""
    return (
        df.groupBy(*df.columns).count().agg(
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")
        )
    )


def recommendations(quality_rows: DataFrame, duplicates: DataFrame, outliers: DataFrame | None = None,
                    types: DataFrame | None = None) -> DataFrame:
    """Advice rules over the quality rows: (rule, columns), rules without a column are left out."""
    pct = F.col("missing_pct")
    rules = [
        ("drop_missing_over_50", pct > 50),
        ("impute_missing_10_50", (pct > 10) & (pct <= 50)),
        ("remove_constant", F.col("is_constant") == 1),
        ("engineer_high_cardinality", F.col("is_high_cardinality") == 1),
    ]
    hits = quality_rows.select(
        "column",
        F.explode(
            F.filter(
                F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull()
            )
        ).alias("rule"),
    )
    if outliers is not None:  # rows (column, n_outliers)
        hits = hits.unionByName(
            outliers.where("n_outliers > 0").select("column", F.lit("review_outliers").alias("rule"))
        )
    if types is not None:  # rows (column, semantic_type)
        hits = hits.unionByName(
            types.where("semantic_type = 'unknown'").select(
                "column", F.lit("review_unknown_type").alias("rule")
            )
        )
    by_rule = hits.groupBy("rule").agg(F.array_sort(F.collect_list("column")).alias("columns"))
    dup = duplicates.where("duplicate_rows > 0").select(
        F.lit("remove_duplicates").alias("rule"), F.array(F.col("duplicate_rows").cast("string")).alias("columns")
    )
    return by_rule.unionByName(dup)


def missing_count(df: DataFrame) -> Callable[[str], Column]:
    return lambda c: F.count_if(present(df, c).isNull())


def statistics(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """describe() plus skewness and kurtosis for numeric columns."""
    cols = list(cols or numeric_columns(df))
    x = lambda c: as_number(df, c)
    rows = column_rows(
        df,
        cols,
        {
            "count": lambda c: F.count(x(c)),
            "mean": lambda c: F.avg(x(c)),
            "std": lambda c: F.stddev_samp(x(c)),
            "min": lambda c: F.min(x(c)),
            "max": lambda c: F.max(x(c)),
            "skew": lambda c: sample_skewness(x(c)),
            "kurtosis": lambda c: sample_kurtosis(x(c)),
        },
    )
    q = fit_quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx)
    lookup = F.create_map(*[v for c in cols for v in (F.lit(c), F.array(*[F.lit(p) for p in q[c]]))])
    qs = lookup[F.col("column")]
    return rows.select(
        "*", qs[0].alias("q25"), qs[1].alias("q50"), qs[2].alias("q75")
    )


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5, least: bool = False, texts: bool = True) -> DataFrame:
    """Most (or least) frequent values, ties by value (of long texts: by their first characters); the per-column limit is
    applied before the shuffle. Long texts are counted by a digest; those of the few winners are fetched after, unless
    `texts` is false."""
    counts = value_counts(df, cols, narrow=True).where(F.col("value").isNotNull())
    by = F.col("count").asc() if least else F.col("count").desc()
    w = Window.partitionBy("column").orderBy(by, F.col("value").asc())
    top = (
        counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("column", "rank", "value", "count")
    )
    wide = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts or not wide:
        return top
    winners = top.where(F.length("value") > NARROW).select("column", F.col("value").alias("digest"))  # k rows a column
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _cell(df, c, True).alias("digest"), present(df, c).alias("text")) for c in wide])).alias("s")).select("s.*")
    found = cells.where(F.length("digest") > NARROW).join(F.broadcast(winners), ["column", "digest"]).groupBy("column", "digest").agg(F.min("text").alias("text"))
    named = top.join(found.withColumnRenamed("digest", "value"), ["column", "value"], "left")
    return named.select("column", "rank", F.coalesce("text", "value").alias("value"), "count")


def normalized_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value shares among non-null rows."""
    counts = value_counts(df, cols).where(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return counts.join(totals, "column").select(
        "column", "value", "count", (F.col("count") / F.col("total")).alias("share")
    )


def _named_pairs(sums: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    return sums.withColumn("column_a", F.get(names, F.col("a"))).withColumn("column_b", F.get(names, F.col("b")))


def correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form, in two scans: means, then the sums of all pairs about them. Null without
    a common row, NaN where a column does not vary over the common rows."""
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double")
    shift = means(df, cols)
    s = _named_pairs(pair_sums(df, cols, shift), cols).where("a < b")
    scale = F.array(*[F.lit(1e-28 * x * x) for x in shift])  # what rounding leaves of a constant column
    n = F.when(F.col("n") > 0, F.col("n"))
    spread = lambda ss, x: F.col(ss) - F.col(x) * F.col(x) / n
    flat = lambda ss, x, i: spread(ss, x) <= n * F.get(scale, F.col(i))
    both = F.col("sab") - F.col("sa") * F.col("sb") / n
    corr = F.when(F.col("n") == 0, None).when(flat("saa", "sa", "a") | flat("sbb", "sb", "b"), F.lit(float("nan")))
    corr = corr.otherwise(both / F.sqrt(spread("saa", "sa") * spread("sbb", "sb")))
    return s.select("column_a", "column_b", corr.alias("corr"))


def column_metadata(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct, missing rate and numeric moments per column, as the tokenizer keeps them."""
    cols = list(cols or scalar_columns(df))
    nums = set(numeric_columns(df))
    x = lambda c: as_number(df, c) if c in nums else F.lit(None).cast("double")
    moments = column_rows(
        df,
        cols,
        {
            "mean": lambda c: F.avg(x(c)),
            "std": lambda c: F.stddev_samp(x(c)),
            "min": lambda c: F.min(x(c)),
            "max": lambda c: F.max(x(c)),
            "skew": lambda c: sample_skewness(x(c)) if c in nums else F.max(x(c)),
            "kurtosis": lambda c: sample_kurtosis(x(c)) if c in nums else F.max(x(c)),
        },
    )
    q = quality(df, cols).select(
        "column", "n_rows", "n_unique", (F.col("n_missing") / F.col("n_rows")).alias("missing_rate")
    )
    return q.join(moments, "column")


def normalizer_statistics(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """dtype, missing, distinct and mean/std/min/max/median per column."""
    cols = list(cols or scalar_columns(df))
    nums = [c for c in cols if c in numeric_columns(df)]
    med = fit_quantiles(df, nums, [0.5])
    dtypes = {c: df.schema[c].dataType.simpleString() for c in cols}
    pairs = F.create_map(*[v for c in cols for v in (F.lit(c), F.lit(dtypes[c]))])
    meds = F.create_map(*[v for c in nums for v in (F.lit(c), F.lit(med[c][0]))]) if nums else None
    meta = column_metadata(df, cols)
    return meta.select(
        "column",
        pairs[F.col("column")].alias("dtype"),
        "missing_rate",
        "n_unique",
        "mean",
        "std",
        "min",
        "max",
        (meds[F.col("column")] if nums else F.lit(None).cast("double")).alias("median"),
    )


def cardinality_with_null(df: DataFrame, types: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Semantic type, cardinality where null counts as a value, and missing rate."""
    q = quality(df, cols)
    return q.join(types.select("column", "semantic_type"), "column").select(
        "column",
        "semantic_type",
        (F.col("n_unique") + (F.col("n_missing") > 0).cast("int")).alias("cardinality"),
        (F.col("n_missing") / F.col("n_rows")).alias("missing_rate"),
    )


def statistics_vector(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """mean, std, min, max, median, skew, kurtosis, null ratio per numeric column."""
    cols = list(cols or numeric_columns(df))
    s = statistics(df, cols)
    n = column_rows(df, cols, {"null_ratio": lambda c: F.avg(present(df, c).isNull().cast("double"))})
    return s.join(n, "column").select(
        "column", "mean", "std", "min", "max", F.col("q50").alias("median"), "skew", "kurtosis", "null_ratio"
    )


def column_cosines(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cosine between numeric columns seen as vectors of rows (missing counts as 0); one scan for all pairs."""
    cols = list(cols or numeric_columns(df))
    sums = _named_pairs(pair_sums(df, cols), cols)
    squares = sums.where("a = b").select("a", "saa")
    size = lambda i: squares.select(F.col("a").alias(i), F.sqrt("saa").alias(f"size_{i}"))
    both = sums.join(size("a"), "a").join(size("b"), "b")
    return both.select("column_a", "column_b", ratio(F.col("sab"), F.col("size_a") * F.col("size_b")).alias("cosine"))


def full_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The dataset profile in long form (column, metric, value)."""
    cols = list(cols or scalar_columns(df))
    nums = [c for c in cols if c in numeric_columns(df)]
    q = quality(df, cols).withColumn("completeness_pct", 100.0 - F.col("missing_pct"))
    q = q.withColumn("mostly_missing", (F.col("missing_pct") > 50).cast("int")).withColumn(
        "nearly_unique", (F.col("n_unique") > 0.9 * F.col("n_rows")).cast("int")
    )
    names = [
        "n_rows", "n_missing", "missing_pct", "n_unique", "completeness_pct",
        "mostly_missing", "is_constant", "nearly_unique",
    ]
    out = q.select("column", *[F.col(n).cast("double") for n in names]).unpivot(
        ["column"], names, "metric", "value"
    )
    if nums:
        s = statistics(df, nums)
        keep = ["mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurtosis"]
        out = out.unionByName(s.select("column", *keep).unpivot(["column"], keep, "metric", "value"))
    return out


def dataset_card(types: DataFrame, n_rows: DataFrame, target: str | None = None) -> DataFrame:
    """(item, value): rows, features, target flag and number of features per semantic type.

    `types` holds one row per column, `n_rows` is a one-row frame with `n_rows`.
    """
    feats = types.where(F.col("column") != F.lit(target)) if target else types
    total = n_rows.select(F.lit("n_rows").alias("item"), F.col("n_rows").cast("long").alias("value"))
    k = feats.agg(F.count("*").alias("value")).select(F.lit("n_features").alias("item"), "value")
    has = types.agg(F.count_if(F.col("column") == F.lit(target or "")).alias("value")).select(
        F.lit("has_target").alias("item"), "value"
    )
    per = feats.groupBy("semantic_type").agg(F.count("*").alias("value")).select(
        F.concat(F.lit("type_"), "semantic_type").alias("item"), "value"
    )
    return total.unionByName(k).unionByName(has).unionByName(per)
