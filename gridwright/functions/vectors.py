"""Array expressions: dot products, norms, softmax, pooling. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return fold_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _each(a: Column, whole, cell) -> Column:
    """``cell(x, w)`` of every entry x, with w = ``whole(a)``. What a lambda takes from outside is computed for every entry, so the
    array and w are bound first and computed once."""
    bound = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), whole(v).alias("w")))
    return F.flatten(F.transform(bound, lambda s: F.transform(s["v"], lambda x: cell(x, s["w"]))))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    return _each(a, lambda v: F.greatest(norm(v), F.lit(eps)), lambda x, n: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; 0 when a vector is all zeros."""
    d = norm(a) * norm(b)
    c = F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(d != 0, d))
    return F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    e = _each(a, F.array_max, lambda x, top: F.exp((x - top) / F.lit(temperature)))
    return _each(e, fold_sum, lambda x, total: x / total)


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_k_indices(a: Column, k: int) -> Column:
    """0-based indices of the k largest entries, ties by lower index."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["i"])


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log(x + F.lit(1e-8)))


def mean_pool(vectors: Column) -> Column:
    """Mean of an array of equal-length vectors."""
    n = F.size(vectors).cast("double")
    total = F.aggregate(
        F.slice(vectors, 2, F.size(vectors)),
        F.element_at(vectors, 1),
        lambda s, v: F.zip_with(s, v, lambda x, y: x + y),
    )
    return F.transform(total, lambda x: x / n)


def max_pool(vectors: Column) -> Column:
    return F.aggregate(
        F.slice(vectors, 2, F.size(vectors)),
        F.element_at(vectors, 1),
        lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y)),
    )


def masked_mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean over the vectors whose mask entry is true; null when none is."""
    kept = F.transform(
        F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"]
    )
    return F.when(F.size(kept) > 0, mean_pool(kept))
