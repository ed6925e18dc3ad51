"""Masking and augmentation of feature arrays. Every draw is a hash of (row key, feature, seed), so
the output is the same after repartitioning, and all work is array expressions in the JVM.

A row has a key, `x` (array of numbers) and `m` (array of 0/1: the feature is valid).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.hashing import gaussian, hex_uniform, key_hash, pick, uniform
from gridwright.functions.vectors import fold_sum
from gridwright.plans.ordered import hash_rank
from gridwright.operators.scale import normalize_row

Step = Callable[[DataFrame], DataFrame]


def _cell_hash(keys: Sequence[str], i: Column, salt: str, seed: int) -> Column:
    return key_hash([*keys, i], salt, seed)


def _valid(m: Column) -> Column:
    """Indices of the valid features."""
    return F.filter(F.transform(m, lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())


def chosen(keys: Sequence[str], m: Column, n: Column, salt: str, seed: int) -> Column:
    """The n valid indices with the lowest hashes."""
    order = F.array_sort(F.transform(_valid(m), lambda i: F.struct(_cell_hash(keys, i, salt, seed).alias("h"), i.alias("i"))))
    return F.transform(F.slice(order, F.lit(1), n), lambda s: s["i"])


def _rewrite(x: str, picked: Column, value: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.col(x), lambda v, i: F.when(F.array_contains(picked, i), value(v, i)).otherwise(v))


def row_gate(keys: Sequence[str], probability: float, salt: str, seed: int) -> Column:
    return uniform(keys, f"gate-{salt}", seed) < F.lit(probability)


# ---------------------------------------------------------------- masking


def mask_cells(
    df: DataFrame, keys: Sequence[str], p: float = 0.15, replace: float = 0.8, random: float = 0.1, seed: int = 42
) -> DataFrame:
    """max(1, int(valid * p)) cells per row: 80% become 0, 10% a random number, 10% stay. Adds masked,
    mask and original."""
    n_valid = F.size(_valid(F.col("m")))
    n = F.when(n_valid > 0, F.greatest(F.lit(1), F.floor(n_valid * F.lit(p)).cast("int"))).otherwise(0)
    work = df.withColumn("__pick", chosen(keys, F.col("m"), n, "cell", seed))

    def value(v, i):
        u = hex_uniform(_cell_hash(keys, i, "act", seed))
        noise = gaussian([*keys, i], "rnd", seed)
        return F.when(u < replace, F.lit(0.0)).when(u < replace + random, noise).otherwise(v)

    return work.select(
        *df.columns, _rewrite("x", F.col("__pick"), value).alias("masked"),
        F.transform("x", lambda _, i: F.array_contains("__pick", i).cast("int")).alias("mask"), F.col("x").alias("original"),
    )


def mask_independent(df: DataFrame, keys: Sequence[str], p: float = 0.15, seed: int = 42) -> DataFrame:
    """Every valid cell is masked with probability p, independently."""
    mask = F.zip_with(
        F.transform("x", lambda _, i: (hex_uniform(_cell_hash(keys, i, "ind", seed)) < p).cast("int")), "m", lambda a, b: a * b
    )
    out = df.withColumn("mask", mask)
    return out.withColumn("masked", F.zip_with("x", "mask", lambda v, k: F.when(k == 1, F.lit(0.0)).otherwise(v)))


def mask_columns(df: DataFrame, keys: Sequence[str], n_features: int, p: float = 0.15, seed: int = 42) -> DataFrame:
    """The same max(1, int(n * p)) columns for every row, chosen by the hash of their index."""
    n = max(1, int(n_features * p))
    index = F.sequence(F.lit(0), F.lit(n_features - 1))
    order = F.array_sort(F.transform(index, lambda i: F.struct(key_hash([i], "column", seed).alias("h"), i.alias("i"))))
    work = df.withColumn("__pick", F.transform(F.slice(order, 1, n), lambda s: s["i"]))
    return work.select(
        *df.columns, _rewrite("x", F.col("__pick"), lambda v, i: F.lit(0.0)).alias("masked"),
        F.transform("x", lambda _, i: F.array_contains("__pick", i).cast("int")).alias("mask"),
    )


def mask_columns_per_row(df: DataFrame, keys: Sequence[str], p: float = 0.15, minimum: int = 1, seed: int = 42) -> DataFrame:
    """Per row each valid feature with probability p, at least `minimum` (the lowest hashes)."""
    hits = F.filter(_valid(F.col("m")), lambda i: hex_uniform(_cell_hash(keys, i, "colrow", seed)) < p)
    low = chosen(keys, F.col("m"), F.lit(minimum), "colrow", seed)
    work = df.withColumn("__pick", F.when(F.size(hits) >= minimum, hits).otherwise(low))
    return work.select(
        *df.columns, _rewrite("x", F.col("__pick"), lambda v, i: F.lit(0.0)).alias("masked"),
        F.transform("x", lambda _, i: F.array_contains("__pick", i).cast("int")).alias("mask"),
    )


# ---------------------------------------------------------------- augmentation


def _gated(df: DataFrame, keys, probability: float, salt: str, seed: int, cells: dict[str, Column]) -> DataFrame:
    gate = row_gate(keys, probability, salt, seed)
    return df.select(*[F.when(gate, cells[c]).otherwise(F.col(c)).alias(c) if c in cells else F.col(c) for c in df.columns])


def noise(df, keys, std=0.1, probability=0.5, features: Sequence[int] | None = None, salt="noise", seed=42) -> DataFrame:
    """Gaussian noise on valid (optionally only numeric) features."""
    on = F.lit(True) if features is None else None

    def cell(v, i):
        ok = on if on is not None else i.isin(*[int(f) for f in features])
        return F.when(ok, v + F.lit(std) * gaussian([*keys, i], salt, seed)).otherwise(v)

    x = F.transform("x", cell)
    return _gated(df, keys, probability, salt, seed, {"x": F.zip_with(F.arrays_zip(x.alias("a"), F.col("x").alias("b")), "m", lambda z, k: F.when(k == 1, z["a"]).otherwise(z["b"]))})


def dropout(df, keys, p=0.1, probability=0.5, min_features=1, salt="dropout", seed=42) -> DataFrame:
    """int(n * p) valid features become 0 and invalid, keeping at least `min_features`."""
    n = F.size(_valid(F.col("m")))
    k = F.greatest(F.least(F.floor(n * F.lit(p)).cast("int"), n - min_features), F.lit(0))
    work = df.withColumn("__pick", chosen(keys, F.col("m"), k, salt, seed))
    return _gated(work, keys, probability, salt, seed, {
        "x": _rewrite("x", F.col("__pick"), lambda v, i: F.lit(0.0)), "m": _rewrite("m", F.col("__pick"), lambda v, i: F.lit(0)),
    }).drop("__pick")


def shuffle_features(df, keys, ratio=0.5, probability=0.3, salt="shuffle", seed=42) -> DataFrame:
    """Values (with validity) of max(2, int(n * ratio)) features change places by hash order."""
    every = F.transform("x", lambda _: F.lit(1))
    n = F.least(F.greatest(F.lit(2), F.floor(F.size("x") * F.lit(ratio)).cast("int")), F.size("x"))
    work = df.withColumn("__to", chosen(keys, every, n, salt, seed))
    order = F.array_sort(F.transform("__to", lambda i: F.struct(_cell_hash(keys, i, salt + "-2", seed).alias("h"), i.alias("i"))))
    work = work.withColumn("__from", F.transform(order, lambda s: s["i"]))

    def moved(c):
        return F.transform(
            F.col(c), lambda v, i: F.when(
                F.array_contains("__to", i), F.element_at(F.col(c), F.element_at("__from", F.array_position("__to", i).cast("int")) + 1)
            ).otherwise(v)
        )

    return _gated(work, keys, probability, salt, seed, {"x": moved("x"), "m": moved("m")}).drop("__to", "__from")


def cutmix(df, keys, ratio=0.3, probability=0.2, salt="cutmix", seed=42) -> DataFrame:
    """int(n * ratio) features come from a partner row: the next in hash order, the first for the last row. Only rows
    that the gate lets through look for their partner."""
    names = df.columns
    ranked = hash_rank(df, keys, seed, [], "__r", "__n")
    partner = ranked.select(F.when(F.col("__r") == 1, F.col("__n")).otherwise(F.col("__r") - 1).alias("__r"), F.struct("x", "m").alias("__o"))
    gate = row_gate(keys, probability, salt, seed)
    work = ranked.where(gate).join(partner, "__r")
    every = F.transform("x", lambda _: F.lit(1))
    n = F.greatest(F.lit(1), F.floor(F.size("x") * F.lit(ratio)).cast("int"))
    work = work.withColumn("__pick", chosen(keys, every, n, salt, seed))
    take = lambda c: _rewrite(c, F.col("__pick"), lambda v, i: F.element_at(F.col("__o")[c], i + 1)).alias(c)
    mixed = work.select(*[take(c) if c in ("x", "m") else c for c in names])
    return df.where(~gate).unionByName(mixed)


def scaling(df, keys, low=0.9, high=1.1, probability=0.3, feature_probability=1.0, salt="scaling", seed=42) -> DataFrame:
    """A random factor per feature, on a share of the features."""
    def cell(v, i):
        h = _cell_hash(keys, i, salt, seed)
        factor = F.lit(low) + F.lit(high - low) * hex_uniform(h)
        return F.when(hex_uniform(h, 17) < feature_probability, v * factor).otherwise(v)

    return _gated(df, keys, probability, salt, seed, {"x": F.transform("x", cell)})


def simulate_missing(df, keys, p=0.1, method="mean", probability=0.3, salt="missing", seed=42) -> DataFrame:
    """Hide cells with probability p and fill them again from the row: mean, median, zero or forward."""
    hidden = F.transform("x", lambda _, i: hex_uniform(_cell_hash(keys, i, salt, seed)) < p)
    work = df.withColumn("__hide", hidden)
    kept = F.transform(F.filter(F.arrays_zip(F.col("x").alias("v"), F.col("__hide").alias("h")), lambda z: ~z["h"]), lambda z: z["v"])
    n = F.size(kept)
    if method == "forward":
        fill = F.aggregate(
            F.arrays_zip(F.col("x").alias("v"), F.col("__hide").alias("h")), F.array().cast("array<double>"),
            lambda acc, z: F.concat(acc, F.array(F.when(z["h"], F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))).otherwise(z["v"]))),
        )
        return _gated(work, keys, probability, salt, seed, {"x": fill}).drop("__hide")
    if method == "mean":
        value = F.when(n > 0, fold_sum(kept) / F.when(n > 0, n)).otherwise(0.0)
    elif method == "median":
        s = F.array_sort(kept)
        mid = (F.try_element_at(s, (F.floor((n - 1) / 2) + 1).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
        value = F.when(n > 0, mid).otherwise(0.0)
    else:
        value = F.lit(0.0)
    work = work.withColumn("__fill", value)
    x = F.zip_with("x", "__hide", lambda v, h: F.when(h, F.col("__fill")).otherwise(v))
    return _gated(work, keys, probability, salt, seed, {"x": x}).drop("__hide", "__fill")


def perturb_numbers(df, keys, std=0.05, probability=0.4, features=None, salt="perturb", seed=42) -> DataFrame:
    return noise(df, keys, std, probability, features, salt, seed)


def swap_category(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], p: float = 0.1, seed: int = 42) -> DataFrame:
    """With probability p the category becomes one drawn from the vocabulary."""
    pool = F.array(*[F.lit(v) for v in values])
    drawn = F.element_at(pool, pick(keys, len(values), f"swap-{column}", seed) + 1)
    return df.withColumn(column, F.when(uniform(keys, f"swapgate-{column}", seed) < p, drawn).otherwise(F.col(column)))


def temporal_shift(df: DataFrame, keys: Sequence[str], sequence: str, max_shift: int = 2, probability: float = 0.5, seed: int = 42) -> DataFrame:
    """Shift a sequence by -k..k places with zero padding; only sequences longer than 2k."""
    s = pick(keys, 2 * max_shift + 1, "shift", seed) - max_shift
    x = F.col(sequence)
    n = F.size(x)
    ahead = F.concat(F.slice(x, s + 1, n), F.array_repeat(F.lit(0.0), s))
    back = F.concat(F.array_repeat(F.lit(0.0), -s), F.slice(x, F.lit(1), F.greatest(n + s, F.lit(0))))
    moved = F.when(s > 0, ahead).when(s < 0, back).otherwise(x)
    go = (n > 2 * max_shift) & row_gate(keys, probability, "shift", seed)
    return df.withColumn(sequence, F.when(go, moved).otherwise(x))


def normalize(df: DataFrame, method: str = "standard") -> DataFrame:
    return df.withColumn("x", normalize_row(F.col("x"), method))


# ---------------------------------------------------------------- compositions


def compose(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for s in steps:
        df = df.transform(s)
    return df


def train_steps(keys: Sequence[str], strength: str = "medium", seed: int = 42) -> list[Step]:
    """Light, medium and strong presets."""
    norm: Step = normalize
    if strength == "light":
        return [lambda d: noise(d, keys, 0.05, 0.3, seed=seed), lambda d: dropout(d, keys, 0.05, 0.2, seed=seed), norm]
    if strength == "medium":
        return [
            lambda d: noise(d, keys, 0.1, 0.5, seed=seed), lambda d: dropout(d, keys, 0.1, 0.4, seed=seed),
            lambda d: shuffle_features(d, keys, probability=0.3, seed=seed), lambda d: scaling(d, keys, 0.9, 1.1, 0.3, seed=seed), norm,
        ]
    if strength == "strong":
        return [
            lambda d: noise(d, keys, 0.15, 0.6, seed=seed), lambda d: dropout(d, keys, 0.15, 0.5, seed=seed),
            lambda d: shuffle_features(d, keys, probability=0.4, seed=seed), lambda d: cutmix(d, keys, probability=0.3, seed=seed),
            lambda d: scaling(d, keys, 0.8, 1.2, 0.4, seed=seed), lambda d: simulate_missing(d, keys, 0.1, probability=0.3, seed=seed), norm,
        ]
    raise ValueError(f"unknown strength {strength}")


def validation_steps() -> list[Step]:
    return [normalize]


def contrastive_steps(keys: Sequence[str], seed: int = 42) -> list[Step]:
    """Default strategies of the contrastive objective."""
    return [
        lambda d: noise(d, keys, 0.1, 0.6, seed=seed), lambda d: dropout(d, keys, 0.15, 0.5, seed=seed),
        lambda d: perturb_numbers(d, keys, 0.05, 0.4, seed=seed), lambda d: shuffle_features(d, keys, 0.2, 0.3, seed=seed),
        lambda d: cutmix(d, keys, 0.3, 0.2, seed=seed),
    ]


def two_views(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Anchor and positive view of each row: the same plan with two seeds, joined by key."""
    a = compose(df, contrastive_steps(keys, seed)).select(*keys, F.col("x").alias("anchor"), F.col("m").alias("anchor_mask"))
    b = compose(df, contrastive_steps(keys, seed + 1)).select(*keys, F.col("x").alias("positive"), F.col("m").alias("positive_mask"))
    return a.join(b, list(keys))
