"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become whole numbers, so the scatter matrix is exact: tasks add X'X in doubles that stay below 2**53 and Spark adds
their whole-number pieces. Its characteristic polynomial is computed modulo many primes, one Hessenberg reduction each, dealt
over the cluster, and put together by Chinese remaindering. All roots of it are real, so Descartes' rule counts the roots
above any rational number exactly, with multiplicity; bisection by that count isolates the k-th largest root, one component a
task. A component is the null space of the scatter less the root, found by inverse iteration in fixed-point numbers of 256
bits; equal roots share a null space and get an orthonormal basis of it. Rows are projected in one last pass.

On the driver are only numbers that depend on the dimensions: the matrix, the polynomial, the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.storage import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Larger entries are cut here, so that every one fits in 63 bits.
LARGEST = 2**62
_LIMB, _ROWS, _PIECE = 21, 2048, 40
#: Bits after the point of roots, of fixed-point numbers, and below which roots count as one.
ROOT_BITS, FIXED_BITS, SAME_BITS = 64, 256, 48
_TASKS = 64


def scaled(column: str) -> Column:
    """floor(64 * c) of each entry; the constant that the fixed form adds on top changes no deviation and stays out."""
    most = F.lit(float(LARGEST // SCALE))
    return F.transform(column, lambda x: F.floor(F.lit(float(SCALE)) * F.least(F.greatest(x.cast("double"), -most), most)).cast("bigint"))


def usable(column: str) -> Column:
    """Not null, not empty, all entries finite numbers."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & fine


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("y")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


# --- the exact scatter


def _gram(block: np.ndarray, largest: int) -> np.ndarray:
    """Exact block' block as Python numbers: in doubles where sums stay below 2**53, else limb by limb."""
    if largest * largest * len(block) < 1 << 53:
        x = block.astype(np.float64)
        return (x.T @ x).astype(np.int64).astype(object)
    low = (1 << _LIMB) - 1
    limbs = [(block & low).astype(np.float64), ((block >> _LIMB) & low).astype(np.float64), (block >> 2 * _LIMB).astype(np.float64)]
    total = 0
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total = total + ((a.T @ b).astype(np.int64).astype(object) << _LIMB * (i + j))
    return total


def _sums(dims: int, largest: int):
    """(i, j, k, v): pieces of the entries of X'X, X with a column of ones, over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _matrix(batch, dims)
            for at in range(0, len(y), _ROWS):
                block = np.column_stack([y[at : at + _ROWS], np.ones(len(y[at : at + _ROWS]), np.int64)])
                got = _gram(block, max(largest, 1))
                total = got if total is None else total + got
        if total is None:
            return
        i, j = np.triu_indices(dims + 1)
        v, k = total[i, j], 0
        while True:
            last = not any(abs(x) >= 1 << _PIECE for x in v)
            piece = v if last else v & ((1 << _PIECE) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), k, np.int32)), pa.array(piece.astype(np.int64))], ["i", "j", "k", "v"])
            if last:
                return
            v, k = v >> _PIECE, k + 1

    return run


def scatter(rows: DataFrame, dims: int, largest: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n * X'X - S S') of the rows ``y``, exact."""
    parts = rows.select("y").mapInArrow(_sums(dims, largest), "i int, j int, k int, v bigint").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    gram = [[0] * (dims + 1) for _ in range(dims + 1)]
    for r in parts.collect():  # bounded by the square of the dimensions
        gram[r["i"]][r["j"]] += r["v"] << _PIECE * r["k"]
    for i in range(dims + 1):
        for j in range(i):
            gram[i][j] = gram[j][i]
    n, s = gram[dims][dims], gram[dims][:dims]
    return n, s, [[n * gram[i][j] - s[i] * s[j] for j in range(dims)] for i in range(dims)]


# --- the characteristic polynomial


def _is_prime(x: int) -> bool:
    if x % 2 == 0:
        return x == 2
    d, r = x - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for base in (2, 3, 5, 7):  # enough below 3.2e9
        y = pow(base, d, x)
        if y in (1, x - 1):
            continue
        for _ in range(r - 1):
            y = y * y % x
            if y == x - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than ``bits`` bits."""
    out, x, product = [], (1 << 31) - 1, 1
    while product.bit_length() <= bits:
        if _is_prime(x):
            out.append(x)
            product *= x
        x -= 2
    return out


def charpoly_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x I - A) modulo p, from x**0 up: reduction to Hessenberg form, then its recurrence."""
    a = np.array([[x % p for x in row] for row in matrix], np.int64)
    n = len(a)
    for m in range(1, n - 1):
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        i = m + below[0]
        if i != m:
            a[[i, m]] = a[[m, i]]
            a[:, [i, m]] = a[:, [m, i]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m][None, :] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u[None, :] % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        new = np.zeros(n + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        factors, t = np.zeros(k, np.int64), 1
        factors[k - 1] = a[k - 1, k - 1]
        for i in range(1, k):
            t = t * int(a[k - i, k - i - 1]) % p
            factors[k - 1 - i] = t * int(a[k - 1 - i, k - 1]) % p
        polys[k] = (new - (factors[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[n]


def _residues(matrix: list[list[int]], moduli: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([charpoly_mod(matrix, moduli[i]).tolist() for i in at], pa.list_(pa.int64()))], ["id", "c"])

    return run


def charpoly(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x I - A), from x**0 up, of a symmetric matrix without negative roots."""
    n, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = -(-trace // n) + 1  # the k-th elementary symmetric sum is at most comb(n, k) * mean**k
    bits = max((math.comb(n, k) * mean**k).bit_length() for k in range(n + 1)) + 2
    moduli = primes(bits)
    rows = spark.range(0, len(moduli), 1, min(len(moduli), _TASKS)).mapInArrow(_residues(matrix, moduli), "id bigint, c array<bigint>").collect()
    out, product = [0] * (n + 1), 1
    for r in sorted(rows, key=lambda r: r["id"]):
        p = moduli[r["id"]]
        inverse = pow(product, -1, p)
        out = [x + product * ((c - x) * inverse % p) for x, c in zip(out, r["c"], strict=True)]
        product *= p
    return [x if 2 * x <= product else x - product for x in out]


# --- roots


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots, with multiplicity, are greater than num / 2**bits: the sign changes of the shifted polynomial. Exact, as all
    roots are real."""
    n = len(poly) - 1
    c = [x << bits * (n - i) for i, x in enumerate(poly)]
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], num: int, bits: int) -> int:
    """Of the polynomial at num / 2**bits."""
    total, n = 0, len(poly) - 1
    for i in range(n, -1, -1):
        total = total * num + (poly[i] << bits * (n - i))
    return (total > 0) - (total < 0)


def isolate(poly: list[int], k: int, bits: int = ROOT_BITS) -> int:
    """num with the k-th largest root in (num, num + 1] / 2**bits. Counts until one root is left in the interval, then signs."""
    low, high, at = -1, 1 - poly[-2], 0  # the sum of all roots
    above_low, above_high, sign_high = len(poly) - 1, 0, 0
    while at < bits or high - low > 1:
        if high - low <= 1:
            low, high, at = low * 2, high * 2, at + 1
            continue
        mid = (low + high) // 2
        if above_low - above_high == 1:
            sign_high = sign_high or _sign(poly, high, at)
            if sign_high == 0:  # the root itself
                return (high << bits - at) - 1
            s = _sign(poly, mid, at)
            if s == 0:
                return (mid << bits - at) - 1
            if s == sign_high:
                high = mid
            else:
                low = mid
            continue
        above = roots_above(poly, mid, at)
        if above >= k:
            low, above_low = mid, above
        else:
            high, above_high = mid, above
    return low


def _isolated(poly: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([str(isolate(poly, k)) for k in at])], ["id", "num"])

    return run


def largest_roots(spark: SparkSession, poly: list[int], count: int) -> list[int]:
    """The ``count`` largest roots, falling, in units of 2**-ROOT_BITS, to less than one unit; roots of 0 are exact."""
    zeros = next(i for i, x in enumerate(poly) if x)
    rest = poly[zeros:]
    k = min(count, len(rest) - 1)
    found = spark.range(1, k + 1, 1, max(1, min(k, _TASKS))).mapInArrow(_isolated(rest), "id bigint, num string").collect() if k else []
    return [int(r["num"]) + 1 for r in sorted(found, key=lambda r: r["id"])] + [0] * (min(count, len(poly) - 1) - k)


# --- components


def _solved(a: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Solutions of a x = b in fixed-point numbers, by elimination with pivots; a pivot of 0 becomes the least number."""
    n, a = len(a), a.copy()
    b = np.array(columns, dtype=object).T.copy()
    for k in range(n):
        i = max(range(k, n), key=lambda r: abs(a[r, k]))
        if i != k:
            a[[k, i]], b[[k, i]] = a[[i, k]], b[[i, k]]
        a[k, k] = a[k, k] or 1
        f = (a[k + 1 :, k] << FIXED_BITS) // a[k, k]
        a[k + 1 :, k + 1 :] -= (f[:, None] * a[k, k + 1 :][None, :]) >> FIXED_BITS
        b[k + 1 :] -= (f[:, None] * b[k][None, :]) >> FIXED_BITS
    x = np.zeros(b.shape, dtype=object)
    for k in range(n - 1, -1, -1):
        rest = b[k] - (((a[k, k + 1 :][:, None] * x[k + 1 :]).sum(axis=0) >> FIXED_BITS) if k + 1 < n else 0)
        x[k] = (rest << FIXED_BITS) // a[k, k]
    return [x[:, j] for j in range(b.shape[1])]


def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in vectors:
        for _ in range(2):
            most = max(abs(x) for x in v) or 1
            v = (v << FIXED_BITS) // most
            for u in out:
                v = v - ((u * (int((u * v).sum()) >> FIXED_BITS)) >> FIXED_BITS)
        norm = math.isqrt(int((v * v).sum())) or 1
        out.append((v << FIXED_BITS) // norm)
    return out


def null_space(matrix: list[list[int]], root: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors that the matrix less root / 2**ROOT_BITS sends to 0, each with its greatest entry positive."""
    n = len(matrix)
    a = np.array([[x << FIXED_BITS for x in row] for row in matrix], dtype=object)
    for i in range(n):
        a[i, i] -= root << FIXED_BITS - ROOT_BITS
    draws = np.random.default_rng(7).integers(1 << 40, 1 << 41, (count, n)) * np.random.default_rng(8).choice([-1, 1], (count, n))
    vectors = [np.array([int(x) << FIXED_BITS - 40 for x in row], dtype=object) for row in draws]
    for _ in range(3):
        vectors = _orthonormal(_solved(a, vectors))
    out = []
    for v in vectors:
        v = v if v[max(range(n), key=lambda i: abs(v[i]))] > 0 else -v
        out.append([int(x) / (1 << FIXED_BITS) for x in v])
    return out


def _spaces(matrix: list[list[int]], groups: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([null_space(matrix, *groups[i]) for i in at], pa.list_(pa.list_(pa.float64())))], ["id", "v"])

    return run


def components(spark: SparkSession, matrix: list[list[int]], roots: list[int]) -> list[list[float]]:
    """Unit vectors, one for each positive root, orthogonal to one another."""
    groups: list[list[int]] = []
    for root in roots:
        if root > 0 and groups and groups[-1][0] - root < 1 << ROOT_BITS - SAME_BITS:
            groups[-1][1] += 1
        elif root > 0:
            groups.append([root, 1])
    if not groups:
        return []
    parts = spark.range(0, len(groups), 1, min(len(groups), _TASKS)).mapInArrow(_spaces(matrix, [tuple(g) for g in groups]), "id bigint, v array<array<double>>").collect()
    return [list(v) for r in sorted(parts, key=lambda r: r["id"]) for v in r["v"]]


# --- rows


@dataclass
class Whitening:
    """n rows with sums ``s`` of the whole numbers; ``vectors[k]`` has eigenvalue ``values[k]`` of the covariance (0: no vector)."""

    n: int
    dims: int
    largest: int
    s: list[int]
    values: list[float]
    explained: list[float | None]
    vectors: list[list[float]]

    def _project(self, y: np.ndarray) -> np.ndarray:
        centred = y.astype(np.float64) - np.array([float(Fraction(x, self.n)) for x in self.s])
        return centred @ (np.array(self.vectors).T / np.sqrt(self.values[: len(self.vectors)]))

    def identity_error(self, rows: DataFrame) -> float | None:
        """Largest absolute entry of the whitened rows' covariance less the identity; null without a component."""
        if not self.vectors:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                y = _matrix(batch, self.dims)
                for at in range(0, len(y), _ROWS):
                    w = self._project(y[at : at + _ROWS])
                    w = np.column_stack([w, np.ones(len(w))])
                    total = total + w.T @ w
            if np.ndim(total):
                i, j = np.triu_indices(len(total))
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

        k = len(self.vectors)
        gram = np.zeros((k + 1, k + 1))
        for r in rows.select("y").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
        mean = gram[k, :k] / self.n  # of rows that are centred already: rounding alone
        return float(np.abs(gram[:k, :k] / self.n - np.outer(mean, mean) - np.eye(k)).max())

    def whiten(self, rows: DataFrame, identity_error: float | None) -> DataFrame:
        """The contract's rows of (vec_id, y)."""
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        names, k = [f.split()[0] for f in schema.split(", ")], len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, y = batch.column("vec_id"), _matrix(batch, self.dims)
                for at in range(0, len(y), _ROWS):
                    block = y[at : at + _ROWS]
                    m = len(block)
                    white = np.full((m, k), np.nan)
                    if self.vectors:
                        white[:, : len(self.vectors)] = self._project(block)
                    flat = white.ravel()
                    explained = pa.array(self.explained, pa.float64()).take(pa.array(np.tile(np.arange(k), m)))
                    error = pa.nulls(m * k, pa.float64()) if identity_error is None else pa.array(np.full(m * k, identity_error))
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, self.n)),
                        self._deviation(block).take(pa.array(np.repeat(np.arange(m), k))), pa.array(flat, mask=np.isnan(flat)), explained, error,
                    ], names)

        return rows.select("vec_id", "y").mapInArrow(run, schema)

    def _deviation(self, block: np.ndarray) -> pa.Array:
        """Exact sums of (n * x - S)**2; null where one does not fit in 63 bits."""
        if (2 * self.n * max(self.largest, 1)) ** 2 * self.dims < 1 << 63:
            d = block * self.n - np.array(self.s, np.int64)
            return pa.array((d * d).sum(axis=1))
        d = block.astype(object) * self.n - np.array(self.s, dtype=object)
        return pa.array([int(x) if x < 1 << 63 else None for x in (d * d).sum(axis=1)], pa.int64())


def fit_whitening(rows: DataFrame, dims: int, largest: int, count: int = COMPONENTS) -> Whitening:
    """From rows (vec_id, y) of one length, entries of at most ``largest`` in size."""
    spark = rows.sparkSession
    n, s, matrix = scatter(rows, dims, largest)
    trace = sum(matrix[i][i] for i in range(dims))
    if not trace:
        k = min(count, dims)
        return Whitening(n, dims, largest, s, [0.0] * k, [None] * k, [])
    roots = largest_roots(spark, charpoly(spark, matrix), count)
    values = [float(Fraction(r, n * n << ROOT_BITS)) for r in roots]
    explained = [float(Fraction(r, trace << ROOT_BITS)) for r in roots]
    return Whitening(n, dims, largest, s, values, explained, components(spark, matrix, roots))


def prepared(embeddings: DataFrame) -> tuple[DataFrame, int, int]:
    """(vec_id, y) of the vectors that take part, their length, and the greatest size of an entry (0, 0 if there is none)."""
    rows = embeddings.where(usable("embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled("embedding").alias("y"))
    sizes = rows.groupBy(F.size("y").alias("dims")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("y", lambda x: F.abs(x)))).alias("largest"))
    head = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    return (rows, 0, 0) if head is None else (rows.where(F.size("y") == head["dims"]), head["dims"], head["largest"])


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row that takes part and each component.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor, where lengths differ, those of another than
    the most frequent length (of equally frequent ones the greatest). Null and repeated ids are rows like any other. Entries beyond 2**56
    in size are cut there. A component without variance has a null whitened value; without any variance explained and
    identity_error are null as well. A deviation beyond 63 bits is null. An empty table gives an empty table.
    """
    rows, dims, largest = prepared(embeddings)
    if not dims:
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = stored(rows, "vectors")
    model = fit_whitening(rows, dims, largest, count)
    return model.whiten(rows, model.identity_error(rows))
