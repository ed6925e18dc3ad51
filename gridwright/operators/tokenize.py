"""Rows to tokens: typed feature tokens, a shared vocabulary, special tokens, padding, batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.columns import as_number, present
from gridwright.operators import encode
from gridwright.operators.scale import fit_scaler
from gridwright.operators.types import tokenizer_types, type_facts
from gridwright.plans.ordered import order_position, prefix_sums

# Special tokens and their ids.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[MISSING]")
PAD, UNK, CLS, SEP, MASK, MISSING = range(6)


# ---------------------------------------------------------------- feature tokens


@dataclass
class FeatureTokenizer:
    """Fitted per column: kind, bin edges and scaler of numbers, vocabulary of categories, year scaler
    of dates. Vocabularies are DataFrames of at most `max_vocab` rows."""

    kinds: dict[str, str]
    edges: dict[str, list[float]]
    scaler: dict[str, tuple[float, float]]
    vocab: dict[str, DataFrame]
    years: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame, out: str = "tokens") -> DataFrame:
        """Adds an array of (token_id, values, present) in fitted feature order; a feature that the
        table lacks gets present = false."""
        work = df
        for c, v in self.vocab.items():
            if c in df.columns:
                work = encode.encode_vocabulary(work, c, v, f"__id_{c}")
        empty = F.array().cast("array<double>")

        def token(c: str) -> Column:
            if c not in df.columns:
                return F.struct(F.lit(0).alias("token_id"), empty.alias("values"), F.lit(False).alias("present"))
            kind = self.kinds[c]
            if kind == "numerical":
                a, s = self.scaler[c]
                x = as_number(df, c)
                tid, vals = encode.bin_id(x, self.edges[c]), F.array(F.coalesce((x - a) / s, F.lit(0.0)))
            elif kind == "datetime":
                tid, vals = F.lit(0), encode.cyclic_datetime(F.col(c), self.years[c])
            elif kind == "boolean":
                tid, vals = encode.boolean_code(F.col(c)), empty
            else:
                tid, vals = F.col(f"__id_{c}").cast("int"), empty
            return F.struct(tid.cast("int").alias("token_id"), vals.alias("values"), F.lit(True).alias("present"))

        return work.select(*df.columns, F.array(*[token(c) for c in self.kinds]).alias(out))


def fit_tokenizer(
    df: DataFrame, cols: Sequence[str], n_bins: int = 100, max_vocab: int = 10_000, normalization: str = "standard"
) -> FeatureTokenizer:
    if not cols:
        raise ValueError("no columns to tokenize")
    found = {r["column"]: r["semantic_type"] for r in tokenizer_types(type_facts(df, cols)).collect()}
    kinds = {c: found[c] for c in cols}
    nums = [c for c in cols if kinds[c] == "numerical"]
    return FeatureTokenizer(
        kinds,
        encode.quantile_edges(df, nums, n_bins),
        fit_scaler(df, nums, normalization),
        {c: encode.vocabulary(df, c, max_vocab) for c in cols if kinds[c] == "categorical"},
        {c: encode.fit_year_scaler(df, c) for c in cols if kinds[c] == "datetime"},
    )


# ---------------------------------------------------------------- shared vocabulary


def text_token(df: DataFrame, c: str, edges: dict[str, list[float]]) -> Column:
    """col=value, or col#bin for a binned number; null when the cell is missing."""
    x = present(df, c)
    if c in edges:
        return F.when(x.isNotNull(), F.concat(F.lit(f"{c}#"), encode.bin_id(x.cast("double"), edges[c]).cast("string")))
    return F.when(x.isNotNull(), F.concat(F.lit(f"{c}="), x.cast("string")))


@dataclass
class TableVocabulary:
    """One vocabulary for all columns: specials 0..5, then the learned tokens in sorted order."""

    cols: list[str]
    edges: dict[str, list[float]]
    tokens: DataFrame  # (token, token_id)

    def encode(
        self, df: DataFrame, max_length: int, add_special: bool = True, padding: bool = True, truncation: bool = True
    ) -> DataFrame:
        """input_ids, attention_mask and token_type_ids per row."""
        work = df
        for i, c in enumerate(self.cols):
            work = work.withColumn(f"__t{i}", text_token(df, c, self.edges))
            m = self.tokens.select(F.col("token").alias("key"), F.col("token_id").alias("value"))
            work = encode.lookup(work, f"__t{i}", m, f"__i{i}", UNK)
        ids = F.array(*[F.when(F.col(f"__t{i}").isNull(), F.lit(MISSING)).otherwise(F.col(f"__i{i}")).cast("int") for i in range(len(self.cols))])
        if truncation:
            ids = F.slice(ids, 1, max_length - (2 if add_special else 0))
        if add_special:
            ids = with_special_tokens(ids)
        if padding:
            ids = pad(ids, F.lit(max_length), PAD)
        out = work.select(*df.columns, ids.alias("input_ids"))
        return out.select("*", attention_mask(F.col("input_ids")).alias("attention_mask"), F.transform("input_ids", lambda _: F.lit(0)).alias("token_type_ids"))

    def save(self, path: str) -> None:
        """(column, token, token_id); the column is what stands before the first = or #."""
        self.tokens.select(F.regexp_extract("token", "^(.*?)[=#]", 1).alias("column"), "token", "token_id").write.parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("token", "token_id")


def fit_vocabulary(df: DataFrame, cols: Sequence[str], binned: Sequence[str] = (), n_bins: int = 100, max_size: int = 10_000) -> TableVocabulary:
    """Values below the `max_size` most frequent ones become the UNK token, as in the original vocabulary."""
    edges = encode.quantile_edges(df, list(binned), n_bins) if binned else {}
    texts = df.select(F.explode(F.array(*[text_token(df, c, edges) for c in cols])).alias("token")).where("token is not null")
    top = texts.groupBy("token").count().orderBy(F.col("count").desc(), "token").limit(max_size - len(SPECIALS)).select("token")
    learned = prefix_sums(top, [], ["token"], {"r": F.lit(1)}).select("token", (F.col("r") + len(SPECIALS) - 1).cast("int").alias("token_id"))
    special = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, token_id int")
    return TableVocabulary(list(cols), edges, special.unionByName(learned))


# ---------------------------------------------------------------- id arrays


def with_special_tokens(ids: Column, pair: Column | None = None) -> Column:
    out = F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)))
    return out if pair is None else F.concat(out, pair, F.array(F.lit(SEP)))


def special_tokens_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: x.isin(PAD, UNK, CLS, SEP, MASK, MISSING).cast("int"))


def pair_type_ids(ids: Column, pair: Column) -> Column:
    """0 for CLS, the first sequence and its SEP; 1 for the second and its SEP."""
    return F.concat(F.array_repeat(F.lit(0), F.size(ids) + 2), F.array_repeat(F.lit(1), F.size(pair) + 1))


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != PAD).cast("int"))


def pad(arr: Column, length: Column, value) -> Column:
    """Cut or right-pad to the length."""
    cut = F.slice(arr, F.lit(1), length)
    return F.concat(cut, F.array_repeat(F.lit(value), F.greatest(length - F.size(cut), F.lit(0))))


def length_mask(length: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.least(length, width)), F.array_repeat(F.lit(0), F.greatest(width - length, F.lit(0))))


def lengths_from_mask(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda s, x: s + x)


def masked_fill(arr: Column, mask: Column, value) -> Column:
    return F.zip_with(arr, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(value)))


def pad_to_group(df: DataFrame, arr: str, by: Sequence[str], value=0) -> DataFrame:
    """Pad to the longest array of the group; the group maximum is an aggregate joined back."""
    widths = df.groupBy(*by).agg(F.max(F.size(arr)).alias("__w"))
    out = df.join(widths, list(by))
    return out.select(
        *[c for c in df.columns if c != arr], pad(F.col(arr), F.col("__w"), value).alias(arr),
        length_mask(F.size(arr), F.col("__w")).alias("attention_mask"),
    )


def ids_to_tokens(df: DataFrame, key_cols: Sequence[str], ids: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """Tokens of an id array joined by blanks; an unknown id becomes the UNK token. The vocabulary, whose ids run from 0 and
    whose size has a documented maximum, travels as one array; the rows are not shuffled."""
    names = vocab.agg(F.array_sort(F.collect_list(F.struct("token_id", "token"))).alias("__v")).select(F.col("__v.token").alias("__names"))
    word = lambda i: F.coalesce(F.get("__names", i), F.lit(SPECIALS[UNK]))
    named = df.select(*key_cols, ids).join(F.broadcast(names))
    return named.select(*key_cols, F.array_join(F.transform(ids, word), " ").alias(out))


def batches(df: DataFrame, shard: str, order_cols: Sequence[str], fields: Sequence[str], size: int) -> DataFrame:
    """(shard, batch_id, n, one array per field): `size` consecutive rows per batch within a shard."""
    placed = order_position(df, [shard], order_cols, "__p")
    b = placed.withColumn("batch_id", F.floor((F.col("__p") - 1) / size).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("__p", *fields)))
    got = b.groupBy(shard, "batch_id").agg(rows.alias("r"))
    return got.select(shard, "batch_id", F.size("r").alias("n"), *[F.col("r")[f].alias(f) for f in fields])
