"""Outlier flags, clipping and anomaly scores. Bounds are fitted once and applied as literals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import as_number, present
from gridwright.functions.hashing import uniform
from gridwright.functions.statistics import ratio
from gridwright.plans.ordered import hash_rank
from gridwright.plans.quantiles import fit_quantiles

Bounds = dict[str, tuple[float | None, float | None]]


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5, approx: bool = False) -> Bounds:
    out: Bounds = {}
    for c, (a, b) in fit_quantiles(df, cols, [0.25, 0.75], approx=approx).items():
        out[c] = (None, None) if a is None else (a - factor * (b - a), b + factor * (b - a))
    return out


def zscore_bounds(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> Bounds:
    """mean +- threshold * sample std; no bounds when the std is 0 or unknown."""
    row = df.agg(
        *[F.avg(as_number(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(as_number(df, c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    out: Bounds = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m - threshold * s, m + threshold * s) if s else (None, None)
    return out


def percentile_bounds(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> Bounds:
    tail = (1.0 - threshold) / 2.0
    return {c: (a, b) for c, (a, b) in fit_quantiles(df, cols, [tail, 1.0 - tail]).items()}


def minmax_bounds(df: DataFrame, cols: Sequence[str]) -> Bounds:
    row = df.agg(
        *[F.min(as_number(df, c)).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.max(as_number(df, c)).alias(f"b{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}


def fit_bounds(df: DataFrame, cols: Sequence[str], method: str = "iqr", **kw) -> Bounds:
    fns = {"iqr": iqr_bounds, "zscore": zscore_bounds, "percentile": percentile_bounds, "minmax": minmax_bounds}
    return fns[method](df, cols, **kw)


def outside(df: DataFrame, c: str, bounds: Bounds) -> Column:
    """True when out of bounds; a missing value or missing bounds are never outliers."""
    lo, hi = bounds.get(c, (None, None))
    if lo is None:
        return F.lit(False)
    x = present(df, c)
    return F.coalesce((x < lo) | (x > hi), F.lit(False))


def flag(df: DataFrame, bounds: Bounds, suffix: str = "_outlier") -> DataFrame:
    return df.select("*", *[outside(df, c, bounds).cast("int").alias(c + suffix) for c in bounds])


def clip(df: DataFrame, bounds: Bounds) -> DataFrame:
    def one(c):
        lo, hi = bounds.get(c, (None, None))
        if lo is None:
            return F.col(c)
        x = as_number(df, c)
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).alias(c)

    return df.select(*[one(c) for c in df.columns])


def remove_outside(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Keep rows inside all bounds; missing values stay."""
    bad = F.lit(False)
    for c in bounds:
        bad = bad | outside(df, c, bounds)
    return df.where(~bad)


def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p for the columns whose values are all positive."""
    row = df.agg(*[F.min(as_number(df, c)).alias(c) for c in cols]).first()
    ok = {c for c in cols if row[c] is not None and row[c] > 0}
    return df.select(*[F.log1p(as_number(df, c)).alias(c) if c in ok else F.col(c) for c in df.columns])


def remove_multi_outliers(
    df: DataFrame, bounds: Bounds, key_cols: Sequence[str], max_share: float = 0.2
) -> DataFrame:
    """Drop rows flagged in more than ``max(1, n_cols // 2)`` columns, at most `max_share` of rows.

    When the limit is hit, the rows with the highest flag counts go first. Whole flag levels are
    cut by their counts; only the level on the edge is ranked, by the hash of the key.
    """
    score = F.lit(0)
    for c in bounds:
        score = score + outside(df, c, bounds).cast("int")
    cut = max(1, len(bounds) // 2)
    scored = df.withColumn("__flags", score)
    levels = {r["__flags"]: r["count"] for r in scored.groupBy("__flags").count().collect()}
    total = sum(levels.values())
    limit = int(max_share * total)
    if sum(n for f, n in levels.items() if f > cut) <= limit:
        return scored.where(F.col("__flags") <= cut).drop("__flags")
    left, edge = limit, cut
    for f in sorted((f for f in levels if f > cut), reverse=True):
        if levels[f] > left:
            edge = f
            break
        left -= levels[f]
    below = scored.where(F.col("__flags") < edge)
    ranked = hash_rank(scored.where(F.col("__flags") == edge), key_cols, out="__r")
    return below.unionByName(ranked.where(F.col("__r") > left).drop("__r")).drop("__flags")


# ---------------------------------------------------------------- multivariate scores


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance (d x d numbers) from one aggregate; missing counts as 0."""
    x = {c: F.coalesce(as_number(df, c), F.lit(0.0)) for c in cols}
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(
        *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(x[cols[i]], x[cols[j]]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return np.array([row[f"m{i}"] for i in range(len(cols))]), cov


def mahalanobis(df: DataFrame, cols: Sequence[str], out: str = "score", fit_on: DataFrame | None = None) -> DataFrame:
    """Squared Mahalanobis distance to the mean (of `fit_on`) as one SQL expression."""
    mean, cov = covariance(df if fit_on is None else fit_on, cols)
    return df.withColumn(out, distance(df, cols, mean, cov))


def distance(df: DataFrame, cols: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance to a mean under a covariance; missing counts as 0."""
    inv = np.linalg.pinv(cov)
    d = [F.coalesce(as_number(df, c), F.lit(0.0)) - F.lit(float(m)) for c, m in zip(cols, mean)]
    total = F.lit(0.0)
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            w = float(inv[i, j]) * (1.0 if i == j else 2.0)
            total = total + F.lit(w) * d[i] * d[j]
    return total


def centre_distance(df: DataFrame, vector: str, out: str = "score") -> DataFrame:
    """Squared distance of each vector to the mean vector (dimension-many numbers on the driver)."""
    dims = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = [r["m"] for r in dims.orderBy("i").collect()]
    c = F.array(*[F.lit(m) for m in centre])
    sq = F.zip_with(F.col(vector), c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return df.withColumn(out, F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))


def score_threshold(df: DataFrame, score: str, percentile: float | None = 95.0) -> float:
    """Cut at a percentile, or at the median when none is given."""
    p = 0.5 if percentile is None else percentile / 100.0
    return fit_quantiles(df, [score], [p])[score][0]


def predict_anomaly(df: DataFrame, score: str, threshold: float, out: str = "is_anomaly") -> DataFrame:
    return df.withColumn(out, (F.col(score) > threshold).cast("int"))


def anomaly_report(df: DataFrame, score: str, y_true: str, y_pred: str) -> DataFrame:
    """Score summary and confusion metrics in one aggregate."""
    t, p, s = F.col(y_true) == 1, F.col(y_pred) == 1, F.col(score)
    base = df.agg(
        F.avg(s).alias("score_mean"), F.stddev_samp(s).alias("score_std"),
        F.max(s).alias("score_max"), F.min(s).alias("score_min"),
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"),
    )
    prec = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    all_ = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return base.select(
        "*", ratio(F.col("tp") + F.col("tn"), all_).alias("accuracy"), prec.alias("precision"),
        rec.alias("recall"), ratio(2 * prec * rec, prec + rec).alias("f1"),
    )


# ---------------------------------------------------------------- isolation forest


class IsolationForest:
    """Trees are grown by Spark tasks on hash-chosen subsamples and kept as rows; scoring walks
    them in Arrow batches. The model is bounded: trees x 2 x subsample nodes."""

    def __init__(self, cols: Sequence[str], key_cols: Sequence[str], trees: int = 100,
                 subsample: int = 256, contamination: float = 0.1, seed: int = 42):
        self.cols, self.key_cols = list(cols), list(key_cols)
        self.trees, self.subsample = trees, subsample
        self.contamination, self.seed = contamination, seed
        self.nodes: pd.DataFrame | None = None
        self.size = subsample
        self.threshold: float | None = None

    def _values(self, df: DataFrame) -> list[Column]:
        return [F.coalesce(as_number(df, c), F.lit(0.0)) for c in self.cols]

    def fit(self, df: DataFrame) -> "IsolationForest":
        n = df.count()
        self.size = min(self.subsample, n)
        rate = min(1.0, 2.0 * self.subsample / max(n, 1))
        # each row draws a hash per tree inside the row; only the hits are exploded, so nothing is multiplied per tree
        span = 1 << 40
        draw = lambda t: F.pmod(F.xxhash64(*self.key_cols, F.lit(self.seed), t), F.lit(span)) / F.lit(float(span))
        every = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("u")))
        drawn = df.select(F.explode(F.filter(every, lambda s: s["u"] < rate)).alias("d"), F.array(*self._values(df)).alias("x"))
        drawn = drawn.select("d.tree", "d.u", "x")
        size, seed = self.size, self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iloc[0])
            pdf = pdf.sort_values("u").head(size)
            data = np.stack(pdf["x"].to_numpy()).astype(float)
            rng = np.random.default_rng([seed, t])
            depth_limit = int(np.ceil(np.log2(max(len(data), 2))))
            rows, todo = [], [(1, np.arange(len(data)), 0)]
            while todo:
                node, idx, depth = todo.pop()
                part = data[idx]
                lo, hi = part.min(axis=0), part.max(axis=0)
                open_dims = np.flatnonzero(hi > lo)
                if depth >= depth_limit or len(idx) <= 1 or not len(open_dims):
                    rows.append((t, node, -1, 0.0, len(idx)))
                    continue
                f = int(rng.choice(open_dims))
                at = float(rng.uniform(lo[f], hi[f]))
                rows.append((t, node, f, at, len(idx)))
                left = part[:, f] < at
                todo.append((2 * node, idx[left], depth + 1))
                todo.append((2 * node + 1, idx[~left], depth + 1))
            return pd.DataFrame(rows, columns=["tree", "node", "feature", "at", "n"])

        # one group per tree, about 2 x subsample rows each
        grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, at double, n int")
        self.nodes = grown.toPandas()
        scores = self.score(df)
        self.threshold = fit_quantiles(scores, ["score"], [1.0 - self.contamination])["score"][0]
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Anomaly score 2^(-E(h)/c(size)); higher is more isolated."""
        size = self.size
        spark = df.sparkSession
        packed = []
        for _, g in self.nodes.groupby("tree"):
            top = int(g["node"].max()) + 1
            feature = np.full(2 * top + 2, -1, dtype=np.int32)
            at = np.zeros(2 * top + 2)
            count = np.ones(2 * top + 2)
            feature[g["node"]] = g["feature"]
            at[g["node"]] = g["at"]
            count[g["node"]] = g["n"]
            packed.append((feature, at, count))
        shared = spark.sparkContext.broadcast(packed)

        def norm(n):
            n = np.asarray(n, dtype=float)
            with np.errstate(divide="ignore", invalid="ignore"):
                c = 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
            return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))

        @F.pandas_udf("double")
        def walk(x: pd.Series) -> pd.Series:
            data = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))
            total = np.zeros(len(data))
            for feature, at, count in shared.value:
                node = np.ones(len(data), dtype=np.int64)
                depth = np.zeros(len(data))
                while True:
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    rows = np.flatnonzero(inner)
                    right = data[rows, f[rows]] >= at[node[rows]]
                    node[rows] = 2 * node[rows] + right
                    depth[rows] += 1
                total += depth + norm(count[node])
            mean = total / len(shared.value)
            return pd.Series(np.power(2.0, -mean / max(float(norm(size)), 1e-12)))

        return df.withColumn(out, walk(F.array(*self._values(df))))

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_anomaly(self.score(df), "score", self.threshold)


# ---------------------------------------------------------------- reconstruction error


def reconstruction_error(df: DataFrame, cols: Sequence[str], k: int = 2, kind: str = "mse") -> DataFrame:
    """Error after projecting standardized rows on the first k principal axes.

    The axes come from the d x d covariance of one aggregate; the projection is an expression.
    """
    mean, cov = covariance(df, cols)
    std = np.sqrt(np.diag(cov))
    std[std == 0] = 1.0
    corr = cov / np.outer(std, std)
    _, vec = np.linalg.eigh(corr)
    axes = vec[:, ::-1][:, :k]
    keep = np.eye(len(cols)) - axes @ axes.T
    z = [
        (F.coalesce(as_number(df, c), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s))
        for c, m, s in zip(cols, mean, std)
    ]
    total = F.lit(0.0)
    for i in range(len(cols)):
        r = F.lit(0.0)
        for j in range(len(cols)):
            r = r + F.lit(float(keep[i, j])) * z[j]
        total = total + (r * r if kind == "mse" else F.abs(r))
    return df.withColumn("score", total / F.lit(float(len(cols))))
