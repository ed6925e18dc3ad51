"""Samples, splits, folds and shards. Every draw is a rank in hash order of the row key, so the
same rows are chosen whatever the partitioning, and no stratum is gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.hashing import key_hash, uniform
from gridwright.plans.ordered import hash_parts, hash_rank, prefix_sums
from gridwright.plans.storage import written


def sample(
    df: DataFrame, key_cols: Sequence[str], n: int | None = None, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """Exactly n rows (or the fraction) without replacement: the lowest hashes."""
    if n is None:
        n = int(df.count() * fraction)
    return hash_parts(df, key_cols, lambda _: [F.lit(n)], seed, out="__p").where("__p = 0").drop("__p")


def allocation(df: DataFrame, strata: str, n: int) -> DataFrame:
    """(stratum, take): proportional sizes that add up to n by largest remainder, ties by value."""
    counts = df.groupBy(F.col(strata).alias("stratum")).agg(F.count("*").alias("size"))
    total = counts.agg(F.sum("size")).first()[0] or 0
    n = min(n, total)
    share = F.col("size") * F.lit(n)
    base = counts.select(
        "stratum", "size", F.floor(share / F.lit(total)).cast("long").alias("base"),
        F.pmod(share, F.lit(total)).alias("rest"),
    )
    left = n - (base.agg(F.sum("base")).first()[0] or 0)
    extra = base.orderBy(F.col("rest").desc(), "stratum").limit(int(left)).select(
        F.col("stratum").alias("__s"), F.lit(1).alias("one")
    )
    return base.join(extra, F.col("stratum").eqNullSafe(F.col("__s")), "left").select(
        "stratum", (F.col("base") + F.coalesce("one", F.lit(0))).alias("take")
    )


def first_rows(df: DataFrame, key_cols: Sequence[str], groups: Sequence[str], take: DataFrame, seed: int = 42, digits: int = 3) -> DataFrame:
    """The first ``take`` rows of each group in hash order; ``take`` has the group's columns and a number.

    Rows are counted by hash prefix. A prefix beyond the cut is left out where it is read, one before it is taken whole, and only
    the prefixes that a cut goes through are ranked.
    """
    names = list(groups)
    work = df.withColumn("__cut", F.substring(key_hash(key_cols, "", seed), 1, digits))
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** digits rows a group
    counts = work.groupBy(*names, "__cut").agg(F.count("*").alias("__c")).withColumn("__start", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    if names:
        wanted = take.select(*[F.col(g).alias(f"__g_{g}") for g in names], F.col("take").alias("__take"))
        side = counts.join(wanted, reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in names]))
    else:
        side = counts.withColumn("__take", F.lit(take.first()["take"]))
    side = side.where(F.col("__start") < F.col("__take"))
    side = side.select(*[F.col(g).alias(f"__s_{g}") for g in names], F.col("__cut").alias("__p"), "__c", "__start", "__take")
    meet = [F.col("__cut") == F.col("__p"), *[F.col(g).eqNullSafe(F.col(f"__s_{g}")) for g in names]]
    met = work.join(side, reduce(lambda x, y: x & y, meet)).drop("__p", *[f"__s_{g}" for g in names])
    whole = F.col("__start") + F.col("__c") <= F.col("__take")
    edge = hash_rank(met.where(~whole), key_cols, seed, [*names, "__cut"], "__k")
    return met.where(whole).select(*df.columns).unionByName(edge.where(F.col("__start") + F.col("__k") <= F.col("__take")).select(*df.columns))


def stratified_sample(df: DataFrame, key_cols: Sequence[str], strata: str, n: int, seed: int = 42) -> DataFrame:
    return first_rows(df, key_cols, [strata], allocation(df, strata, n).select(F.col("stratum").alias(strata), "take"), seed)


def split(
    df: DataFrame, key_cols: Sequence[str], train: float = 0.7, val: float = 0.15, test: float = 0.15,
    stratify: str | None = None, seed: int = 42, out: str = "split",
) -> DataFrame:
    """Adds the split name: the first int(train * n) ranks, then int(val * n), then the rest."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("train, val and test must sum to 1")
    def bounds(n):
        a = F.floor(n * F.lit(float(train)))
        return [a, a + F.floor(n * F.lit(float(val)))]

    parts = hash_parts(df, key_cols, bounds, seed, [stratify] if stratify else [], "__p")
    name = F.when(F.col("__p") == 0, "train").when(F.col("__p") == 1, "val").otherwise("test")
    return parts.select(*df.columns, name.alias(out))


def split_by_hash(
    df: DataFrame, key_cols: Sequence[str], train: float = 0.7, val: float = 0.15, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Approximate sizes, no shuffle: the hash itself decides. Also works on a stream."""
    u = uniform(key_cols, "split", seed)
    return df.withColumn(out, F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def train_eval(
    df: DataFrame, key_cols: Sequence[str], eval_share: float = 0.2, stratify: str | None = None, seed: int = 42
) -> DataFrame:
    """Two parts, 'train' and 'eval'; the evaluation part takes ceil(share * n)."""
    bounds = lambda n: [F.ceil(n * F.lit(eval_share))]
    parts = hash_parts(df, key_cols, bounds, seed, [stratify] if stratify else [], "__p")
    return parts.select(*df.columns, F.when(F.col("__p") == 0, "eval").otherwise("train").alias("split"))


def folds(df: DataFrame, key_cols: Sequence[str], k: int = 5, stratify: str | None = None, seed: int = 42) -> DataFrame:
    ranked = hash_rank(df, key_cols, seed, [stratify] if stratify else [], "__r")
    return ranked.select(*df.columns, F.pmod(F.col("__r") - 1, F.lit(k)).cast("int").alias("fold"))


def time_folds(
    df: DataFrame, order_cols: Sequence[str], k: int = 5, max_train: int | None = None
) -> DataFrame:
    """Expanding folds over time order: (row, fold, role). Test size is n // (k + 1)."""
    ranked = prefix_sums(df, [], order_cols, {"__r": F.lit(1)}, totals={"__r": "__n"})
    size = F.floor(F.col("__n") / (k + 1))
    start = F.col("__n") - (F.lit(k) - F.col("fold")) * size  # 0-based first test row of the fold
    at = F.col("__r") - 1
    each = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    in_train = at < start
    if max_train is not None:
        in_train = in_train & (at >= start - max_train)
    role = F.when((at >= start) & (at < start + size), "test").when(in_train, "train")
    return each.withColumn("role", role).where(F.col("role").isNotNull()).select(*df.columns, "fold", "role")


def nested_subsets(
    df: DataFrame, key_cols: Sequence[str], sizes: Sequence[int] = (100, 500, 1000, 2000, 5000),
    stratify: str | None = None, seed: int = 42,
) -> DataFrame:
    """Growing subsets for a learning curve, one copy of a row per subset it belongs to; sizes above
    the row count are skipped. Stratified: the i-th row of a stratum of size s comes at (i - 1/2)/s."""
    spark, groups = df.sparkSession, [stratify] if stratify else []
    counts = written(df.groupBy(*groups).agg(F.count("*").alias("__size")), "strata")
    total, strata = counts.agg(F.sum("__size"), F.count("*")).first()
    fits = [int(s) for s in sizes if s <= (total or 0)]
    if not fits:
        return df.limit(0).withColumn("subset", F.lit(0))
    most = max(fits)
    if not stratify:
        kept = first_rows(df, key_cols, [], spark.createDataFrame([(most,)], "take long"), seed)
        ranked = hash_rank(kept, key_cols, seed, out="__r")
    else:
        # the row of rank `most` comes no later than (most + strata / 2) / total, which bounds each stratum's part
        take = F.floor((F.lit(most) + strata / 2) * F.col("__size") / total + 0.5) + 1
        kept = first_rows(df, key_cols, groups, counts.select(stratify, take.cast("long").alias("take")), seed)
        ranked = hash_rank(kept, key_cols, seed, groups, "__i")
        by = counts.select(F.col(stratify).alias("__g"), "__size")
        ranked = ranked.join(by, F.col(stratify).eqNullSafe(F.col("__g"))).withColumn("__q", (F.col("__i") - 0.5) / F.col("__size")).drop("__g", "__i", "__size")
        ranked = prefix_sums(ranked, [], ["__q", stratify, *key_cols], {"__r": F.lit(1)})
    inside = F.filter(F.array(*[F.lit(s) for s in fits]), lambda s: F.col("__r") <= s)
    return ranked.select(*df.columns, F.explode(inside).alias("subset"))


def shards_by_size(df: DataFrame, order_cols: Sequence[str], shard_size: int) -> DataFrame:
    """Shards of a fixed number of consecutive rows."""
    ranked = prefix_sums(df, [], order_cols, {"__r": F.lit(1)})
    return ranked.select(*df.columns, F.floor((F.col("__r") - 1) / shard_size).cast("long").alias("shard_id"))


def hash_shards(df: DataFrame, key_cols: Sequence[str], n_shards: int, seed: int = 42) -> DataFrame:
    """Shards of about equal size without ranking (no shuffle)."""
    return df.withColumn("shard_id", F.floor(uniform(key_cols, "shard", seed) * n_shards).cast("long"))


def balance_shards(shards: DataFrame, world_size: int, shard_id: str = "shard_id") -> DataFrame:
    """Round-robin of shards to workers; workers short of a shard get an empty slot (-1)."""
    ids = shards.select(F.col(shard_id).alias("shard_id")).distinct()
    n = (ids.agg(F.max("shard_id")).first()[0] or 0) + 1
    slots = -(-n // world_size)
    grid = ids.sparkSession.range(slots * world_size).select(
        (F.col("id") % world_size).cast("int").alias("rank"),
        F.floor(F.col("id") / world_size).cast("long").alias("slot"),
        F.col("id").alias("__i"),
    )
    return grid.join(ids, F.col("__i") == F.col("shard_id"), "left").select(
        "rank", "slot", F.coalesce("shard_id", F.lit(-1)).cast("long").alias("shard_id")
    )


def distributed_sample(
    df: DataFrame, key_cols: Sequence[str], world_size: int, drop_last: bool = False, seed: int = 42
) -> DataFrame:
    """Seeded permutation dealt to workers; padded by wrap-around (or cut) to a multiple."""
    ranked = hash_rank(df, key_cols, seed, out="__r", total="__n")
    n, w = F.col("__n"), F.lit(world_size)
    size = (F.floor(n / w) if drop_last else F.ceil(n / w)) * w
    places = F.when(F.col("__r") <= size, F.sequence(F.col("__r"), size, n))
    dealt = ranked.withColumn("__p", F.explode(places))
    return dealt.select(
        *df.columns, F.pmod(F.col("__p") - 1, w).cast("int").alias("rank"),
        F.floor((F.col("__p") - 1) / w).cast("long").alias("position"),
    )


def write_ranks(df: DataFrame, path: str, rank: str = "rank") -> None:
    """One folder per worker; files inside a folder are written by many tasks."""
    df.write.partitionBy(rank).parquet(path)


