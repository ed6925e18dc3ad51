"""Column semantics: domains, name features, profile vectors and schema matching. Work on data goes
through the profile aggregates; what follows has one row per column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions.bisect import edges_passed
from gridwright.functions.columns import as_number, numeric_columns, present, scalar_columns
from gridwright.operators import profile
from gridwright.operators.encode import uniform_edges
from gridwright.operators.types import parse_any, tokenizer_types, type_facts
from gridwright.plans.blocks import block_pairs, packed

# Domain words, in the order in which ties are broken.
DOMAINS = {
    "finance": (
        "price", "cost", "amount", "revenue", "profit", "loss", "balance", "account", "transaction",
        "payment", "invoice", "budget", "expense", "income", "salary", "wage", "tax", "fee", "rate",
        "interest", "loan", "debt", "credit", "debit", "currency", "dollar", "euro",
    ),
    "healthcare": (
        "patient", "diagnosis", "treatment", "medication", "dose", "symptom", "disease", "condition",
        "therapy", "hospital", "clinic", "doctor", "nurse", "medical", "health", "blood", "pressure",
        "temperature", "heart", "pulse", "weight", "height", "bmi", "age", "gender",
    ),
    "ecommerce": (
        "product", "item", "sku", "category", "brand", "model", "size", "color", "quantity", "stock",
        "inventory", "order", "customer", "user", "rating", "review", "cart", "checkout", "shipping",
        "delivery", "return", "refund", "discount", "coupon", "promotion",
    ),
    "temporal": (
        "date", "time", "timestamp", "year", "month", "day", "hour", "minute", "second", "created",
        "updated", "modified", "start", "end", "duration", "period", "interval", "schedule",
        "deadline", "expiry", "birth", "anniversary", "event", "occurrence",
    ),
    "geographic": (
        "address", "street", "city", "state", "country", "zip", "postal", "location", "latitude",
        "longitude", "coordinate", "region", "area", "district", "neighborhood", "place", "venue", "site",
    ),
    "identity": (
        "id", "identifier", "key", "code", "number", "serial", "reference", "name", "title", "first",
        "last", "middle", "full", "username", "email", "phone", "contact", "profile", "account", "user",
    ),
}
# Name patterns. A word boundary does not split at an underscore.
NAME_PATTERNS = {
    "id": r"\b(id|identifier|key|code|number|serial|ref)\b",
    "name": r"\b(name|title|label|description)\b",
    "date": r"\b(date|time|timestamp|created|updated|modified)\b",
    "amount": r"\b(amount|price|cost|value|total|sum|balance)\b",
    "count": r"\b(count|quantity|number|num|qty|size|length)\b",
    "rate": r"\b(rate|ratio|percentage|percent|score|rating)\b",
    "status": r"\b(status|state|condition|flag|active|enabled)\b",
    "category": r"\b(category|type|class|group|kind|genre)\b",
}
# What counts as an e-mail address and as an amount.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
CURRENCY = r"^\$?\d+\.?\d*$"


def columns_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column), one row per column of the given tables."""
    rows = [(t, c) for t, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table string, column string")


def name_scores(name: Column) -> dict[str, Column]:
    """Share of each domain's words that occur in the name."""
    low = F.lower(name)
    return {
        d: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))) / len(words)
        for d, words in DOMAINS.items()
    }


def best_domain(scores: dict[str, Column]) -> Column:
    """Highest score, the first domain on ties, 'unknown' when all are 0."""
    top = F.greatest(*scores.values())
    out = F.when(top <= 0, F.lit("unknown"))
    for d, s in scores.items():
        out = out.when(s == top, F.lit(d))
    return out


def with_domain(columns: DataFrame, bonus: DataFrame | None = None) -> DataFrame:
    """Adds domain and its score; `bonus` is the frame of `data_bonus`."""
    scores = name_scores(F.col("column"))
    if bonus is not None:
        columns = columns.join(bonus, "column", "left")
        scores = {
            d: s + (F.coalesce(F.col(f"bonus_{d}"), F.lit(0.0)) if d in ("identity", "finance", "temporal") else F.lit(0.0))
            for d, s in scores.items()
        }
    # scores first, so that the choice reads them and does not repeat the word tests
    scored = columns.select("*", *[s.alias(f"__{d}") for d, s in scores.items()])
    cols = {d: F.col(f"__{d}") for d in scores}
    out = scored.select("*", best_domain(cols).alias("domain"), F.greatest(*cols.values()).alias("domain_score"))
    return out.drop("bonus_identity", "bonus_finance", "bonus_temporal", *[f"__{d}" for d in scores])


def pattern_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null values that look like an e-mail, a number or a date, over all rows: one aggregate, no text is
    shuffled."""
    def share(c, test):
        v = present(df, c).cast("string")
        return F.avg(F.when(v.isNotNull(), F.coalesce(test(v), F.lit(False)).cast("int")))

    return profile.column_rows(df, list(cols or scalar_columns(df)), {
        "email": lambda c: share(c, lambda v: v.rlike(EMAIL)), "currency": lambda c: share(c, lambda v: v.rlike(CURRENCY)),
        "date": lambda c: share(c, lambda v: parse_any(v).isNotNull()),
    })


def data_bonus(shares: DataFrame) -> DataFrame:
    """e-mail > 50%: identity +0.5; number > 30%: finance +0.3; date > 50%: temporal +0.4."""
    return shares.select(
        "column", F.when(F.col("email") > 0.5, 0.5).otherwise(0.0).alias("bonus_identity"),
        F.when(F.col("currency") > 0.3, 0.3).otherwise(0.0).alias("bonus_finance"),
        F.when(F.col("date") > 0.5, 0.4).otherwise(0.0).alias("bonus_temporal"),
    )


def name_features(columns: DataFrame, split_underscore: bool = False) -> DataFrame:
    c = F.col("column")
    low = F.translate(F.lower(c), "_", " ") if split_underscore else F.lower(c)
    return columns.select(
        "*", F.contains(c, F.lit("_")).cast("int").alias("has_underscore"), c.rlike("^.+[A-Z]").cast("int").alias("has_camelcase"),
        F.regexp_count(c, F.lit(r"\w+")).alias("word_count"), c.rlike(r"\d+$").cast("int").alias("numeric_suffix"),
        ((F.length(c) <= 5) & (F.upper(c) == c) & c.rlike("[A-Z]")).cast("int").alias("is_abbreviation"),
        *[low.rlike(p).cast("int").alias(f"{n}_pattern") for n, p in NAME_PATTERNS.items()],
    )


def schema_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(item, value): columns, domains, types, mean distinct count and missing rate, and counts per
    domain and type; the most frequent domain comes as primary_domain:<name>."""
    cols = list(cols or scalar_columns(df))
    facts = type_facts(df, cols)
    kinds = tokenizer_types(facts)
    dom = with_domain(columns_frame(df.sparkSession, {"t": df.select(*cols)}))
    rows = facts.join(kinds.select("column", "semantic_type"), "column").join(dom.select("column", "domain"), "column")
    missing = (F.col("n_rows") - F.col("n_present")) / F.col("n_rows")
    head = rows.agg(
        F.count("*").cast("double").alias("n_columns"), F.count_distinct("domain").cast("double").alias("n_domains"),
        F.count_distinct("semantic_type").cast("double").alias("n_types"), F.avg("n_unique").alias("mean_distinct"),
        F.avg(missing).alias("mean_missing_rate"),
    )
    names = head.columns
    out = head.unpivot([], names, "item", "value")
    per_d = rows.groupBy("domain").agg(F.count("*").cast("double").alias("value"))
    per_t = rows.groupBy("semantic_type").agg(F.count("*").cast("double").alias("value"))
    main = per_d.agg(F.min_by("domain", F.struct(-F.col("value"), F.col("domain"))).alias("d"), F.max("value").alias("value"))
    return (
        out.unionByName(per_d.select(F.concat(F.lit("domain:"), "domain").alias("item"), "value"))
        .unionByName(per_t.select(F.concat(F.lit("type:"), "semantic_type").alias("item"), "value"))
        .unionByName(main.select(F.concat(F.lit("primary_domain:"), "d").alias("item"), "value"))
    )


def statistical_vectors(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, stats[8]): moments for numbers, only missing rate and log distinct count for others."""
    meta = profile.column_metadata(df, cols)
    kinds = tokenizer_types(type_facts(df, cols)).select("column", "semantic_type")
    num = F.col("semantic_type") == "numerical"
    z = lambda c: F.when(num, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    cells = [z(c) for c in ("mean", "std", "min", "max", "skew", "kurtosis")]
    return meta.join(kinds, "column").select(
        "column", "semantic_type", F.array(*cells, F.col("missing_rate"), F.log1p(F.col("n_unique").cast("double"))).alias("stats")
    )


def distribution_vectors(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 32) -> DataFrame:
    """(column, dist[bins]): density histogram for numbers, top value shares for others."""
    cols = list(cols or scalar_columns(df))
    nums = [c for c in cols if c in numeric_columns(df)]
    cats = [c for c in cols if c not in nums]
    filled = lambda pairs: F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit(0.0))
    )
    parts = []
    if nums:
        edges = uniform_edges(df, nums, bins)
        cells = []
        for c in nums:
            e = edges[c]
            if e[0] == e[-1]:
                step = 1.0 / bins
                e = [e[0] - 0.5 + i * step for i in range(bins + 1)]
            x = as_number(df, c)
            bin_ = F.least(edges_passed(x, e) - 1, F.lit(bins - 1))
            cells.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("column"), bin_.alias("b"), F.lit((e[-1] - e[0]) / bins).alias("w"))))
        counts = df.select(F.explode(F.array(*cells)).alias("s")).where("s is not null").groupBy("s.column", "s.b", "s.w").agg(F.count("*").alias("n"))
        tot = counts.groupBy("column").agg(F.sum("n").alias("t"))
        dens = counts.join(tot, "column").select("column", "b", (F.col("n") / F.col("t") / F.col("w")).alias("v"))
        pairs = F.map_from_entries(F.collect_list(F.struct("b", "v")))  # at most `bins` entries
        parts.append(dens.groupBy("column").agg(filled(pairs).alias("dist")))
    if cats:
        top = profile.top_values(df, cats, bins, texts=False)
        tot = top.groupBy("column").agg(F.sum("count").alias("t"))
        shares = top.join(tot, "column").select("column", (F.col("rank") - 1).alias("b"), (F.col("count") / F.col("t")).alias("v"))
        pairs = F.map_from_entries(F.collect_list(F.struct("b", "v")))
        parts.append(shares.groupBy("column").agg(filled(pairs).alias("dist")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def name_vector(name: Column, width: int = 64) -> Column:
    """16 md5 bytes scaled to [-1, 1], padded with zeros."""
    h = F.md5(name)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("double")
    cells = [(byte(i) - 127.5) / 127.5 for i in range(16)]
    return F.array(*cells, *[F.lit(0.0)] * (width - 16))


TYPES = ("categorical", "numerical", "datetime", "boolean", "text")


def column_blocks(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Name, statistics, type and distribution blocks, domain and name patterns per column."""
    stats = statistical_vectors(df, cols)
    dist = distribution_vectors(df, cols)
    joined = stats.join(dist, "column", "left").select(
        "column", name_vector(F.col("column")).alias("name_block"), F.col("stats").alias("stats_block"),
        F.array(*[(F.col("semantic_type") == t).cast("double") for t in TYPES]).alias("type_block"),
        F.coalesce("dist", F.array_repeat(F.lit(0.0), 32)).alias("dist_block"),
    )
    low = F.lower("column")
    return with_domain(joined).withColumn("patterns", F.array(*[low.rlike(p).cast("int") for p in NAME_PATTERNS.values()]))


_VECTORS = ("name_block", "stats_block", "type_block", "dist_block")
_SCORES = ("name_similarity", "statistical_similarity", "type_similarity", "distribution_similarity", "overall_similarity", "domain_similarity", "pattern_similarity", "combined_similarity")


def _side(items: pa.Array) -> dict[str, np.ndarray]:
    """The columns of a block as arrays."""
    get = lambda c: items.field(items.type.get_field_index(c))
    wide = lambda c: get(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(items), -1)
    return {"column": get("column").to_numpy(zero_copy_only=False), "domain": get("domain").to_numpy(zero_copy_only=False)} | {c: wide(c) for c in (*_VECTORS, "patterns")}


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of equal texts."""
    codes = pd.factorize(np.concatenate([a, b]))[0]
    return codes[: len(a), None] == codes[None, len(a) :]


def _cosines(dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
    return np.clip(np.divide(dots, size, out=np.zeros_like(dots), where=size > 0), -1.0, 1.0)


def _compared(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> list[np.ndarray]:
    """All scores of two blocks, as matrices in the order of ``_SCORES``: cosines of the parts, of all parts together, same domain,
    share of equal patterns, and 0.6 overall + 0.3 domain + 0.1 patterns."""
    dots, left, right = ([f(c) for c in _VECTORS] for f in (lambda c: a[c] @ b[c].T, lambda c: (a[c] ** 2).sum(axis=1), lambda c: (b[c] ** 2).sum(axis=1)))
    scores = [_cosines(d, x, y) for d, x, y in zip(dots, left, right, strict=True)]
    overall = _cosines(sum(dots), sum(left), sum(right))
    same = _same(a["domain"], b["domain"]).astype(float)
    p, q = a["patterns"], b["patterns"]  # 0 or 1
    agree = (p @ q.T + (1 - p) @ (1 - q).T) / p.shape[1]
    return [*scores, overall, same, agree, 0.6 * overall + 0.3 * same + 0.1 * agree]


def _all_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = _side(batch.column("a")[i].values), _side(batch.column("b")[i].values)
            for at in range(0, len(a["column"]), 64):
                part = {k: v[at : at + 64] for k, v in a.items()}
                row, col = np.nonzero(~_same(part["column"], b["column"]))
                cells = [pa.array(m[row, col]) for m in _compared(part, b)]
                yield pa.RecordBatch.from_arrays([pa.array(part["column"][row], pa.string()), pa.array(b["column"][col], pa.string()), *cells], ["column_a", "column_b", *_SCORES])


def _best_scores(k: int, score: str):
    """Of each left column the k best of a right block: by score (12 digits), then name."""
    at = _SCORES.index(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = _side(batch.column("a")[i].values), _side(batch.column("b")[i].values)
                scores = np.where(_same(a["column"], b["column"]), -np.inf, np.round(_compared(a, b)[at], 12))
                last = max(scores.shape[1] - k, 0)
                row, col = np.nonzero((scores >= np.partition(scores, last, axis=1)[:, last, None]) & (scores > -np.inf))
                order = np.lexsort([b["column"][col].astype(str), -scores[row, col], row])
                row, col = row[order], col[order]
                top = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                row, col = row[top], col[top]
                yield pa.RecordBatch.from_arrays([pa.array(a["column"][row], pa.string()), pa.array(b["column"][col], pa.string()), pa.array(scores[row, col])], ["column_a", "column_b", score])

    return run


def _met(blocks: DataFrame, other: DataFrame | None) -> DataFrame:
    cols = ["column", "domain", "patterns", *_VECTORS]
    left, n = packed(blocks, "column", cols)
    right, m = (left, n) if other is None else packed(other, "column", cols)
    return block_pairs(left, right, m)


def similarities(blocks: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Similarity of all pairs of differently named columns: cosines of the blocks, of all blocks together, and the combined
    score 0.6 overall + 0.3 same domain + 0.1 pattern agreement."""
    return _met(blocks, other).mapInArrow(_all_scores, ", ".join(["column_a string", "column_b string", *[f"{c} double" for c in _SCORES]]))


def most_similar(blocks: DataFrame, k: int, other: DataFrame | None = None, score: str = "overall_similarity") -> DataFrame:
    """column_a, rank, column_b and the score of each column's k best partners, ties by name. Each pair of blocks gives at most k
    partners a column, and a task keeps k of those before they are shuffled: all pairs are never there at once."""
    best = _met(blocks, other).mapInArrow(_best_scores(k, score), f"column_a string, column_b string, {score} double")
    return top_similar(best, k, score)


def top_similar(pairs: DataFrame, k: int, score: str = "overall_similarity") -> DataFrame:
    w = Window.partitionBy("column_a").orderBy(F.col(score).desc(), "column_b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column_a", "rank", "column_b", score)
