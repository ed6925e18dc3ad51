"""Robust covariance: the minimum covariance determinant by concentration steps (Rousseeuw and Van Driessen 1999).

Starts come from small random subsets, tried on a sample whose size is a parameter. The best go on over the whole table: a step
takes the h rows nearest to the present centre, found by an exact quantile of their distances, and the mean and covariance of
those rows from one aggregate. Their determinant never grows, so the steps end. Reweighting takes all rows within a chi-square
bound of the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import as_number
from gridwright.operators.outlier import covariance, distance
from gridwright.plans.quantiles import fit_quantiles
from gridwright.plans.storage import written

#: Rows that starts are tried on, number of starts, those that go on over all rows, steps at most, and the share by which the
#: determinant over all rows must fall for another step.
SAMPLE_ROWS, STARTS, KEPT, STEPS, GAIN = 1500, 200, 1, 30, 1e-4
TAIL = 0.025


def chi_square_quantile(p: float, k: int) -> float:
    """Where a chi-square variable of k degrees lies below with probability p: bisection of its series."""

    def below(x: float) -> float:
        a, half = k / 2, x / 2
        term = total = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        for i in range(1, 10_000):
            term *= half / (a + i)
            total += term
            if term < total * 1e-17:
                break
        return total

    low, high = 1e-12, 10.0 * k + 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


@dataclass
class RobustFit:
    """``raw_*`` of the h rows, ``mean`` and ``cov`` after reweighting; ``support`` rows were kept then."""

    n: int
    h: int
    raw_mean: np.ndarray
    raw_cov: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    support: int

    @property
    def raw_determinant(self) -> float:
        return float(np.linalg.det(self.raw_cov))


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])


def _step(x: np.ndarray, h: int, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
    return _moments(x[np.argsort(d, kind="stable")[:h]])


def _starts(x: np.ndarray, share: float, starts: int, kept: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best of the starts on a sample: random subsets of one row more than there are columns, two steps each, then the best ones to
    their end."""
    n, d = x.shape
    h, r = min(n, max(d + 1, math.ceil(share * n))), np.random.default_rng(seed)
    found = []
    for _ in range(starts):
        size = min(n, d + 1)
        pick = r.choice(n, size, replace=False)
        while size < n and np.linalg.matrix_rank(np.cov(x[pick].T, bias=True).reshape(d, d)) < d:
            size = min(n, size + max(1, size // 2))
            pick = r.choice(n, size, replace=False)
        state = _moments(x[pick])
        for _ in range(2):
            state = _step(x, h, *state)
        found.append((np.linalg.det(state[1]), state))
    best = []
    for _, state in sorted(found, key=lambda f: f[0])[: 4 * kept]:
        det = np.linalg.det(state[1])
        for _ in range(STEPS):
            state = _step(x, h, *state)
            now = np.linalg.det(state[1])
            if now >= det:
                break
            det = now
        best.append((det, state))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, state in sorted(best, key=lambda f: f[0]):
        if not any(np.allclose(state[1], o[1]) for o in out):
            out.append(state)
    return out[:kept]


def fit_robust_covariance(
    df: DataFrame, cols: Sequence[str], support: float | None = None, sample: int = SAMPLE_ROWS, starts: int = STARTS, kept: int = KEPT, seed: int = 42
) -> RobustFit:
    """Of all choices of h rows, those of least covariance determinant, as far as the starts find it. ``support``: h as a share of the
    rows, by default (rows + columns + 1) / 2. Missing values count as 0. The sample is the first rows by a hash of their
    values, equal rows by chance of their place."""
    x = written(df.select(*[F.coalesce(as_number(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)]), "robust")
    names, n = x.columns, x.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    h = min(n, (n + len(cols) + 1) // 2 if support is None else max(len(cols) + 1, math.ceil(support * n)))
    picked = np.array(x.orderBy(F.xxhash64(*names, F.lit(seed)), *names).limit(sample).collect(), float).reshape(-1, len(cols))  # ``sample`` rows
    best = None
    for mean, cov in _starts(picked, h / n, starts, kept, seed):
        previous = math.inf
        for _ in range(STEPS):
            scored = x.withColumn("d", distance(x, names, mean, cov))
            bound = fit_quantiles(scored, ["d"], [(h - 1) / max(n - 1, 1)])["d"][0]
            near = scored.where(F.col("d") <= bound * (1 + 1e-12))
            new_mean, new_cov = covariance(near, names)
            det = float(np.linalg.det(new_cov))
            if det >= previous:
                break
            last, previous = previous, det
            mean, cov = new_mean, new_cov
            if det <= 0 or det > last * (1 - GAIN):
                break
        if best is None or previous < best[0]:
            best = (previous, mean, cov)
    _, mean, cov = best
    scored = x.withColumn("d", distance(x, names, mean, cov))
    centre = fit_quantiles(scored, ["d"], [0.5])["d"][0]
    # the h nearest rows spread less than all; the median distance of normal rows sets the scale
    factor = centre / chi_square_quantile(0.5, len(cols)) if centre > 0 else 1.0
    kept_rows = scored.where(F.col("d") <= factor * chi_square_quantile(1 - TAIL, len(cols)))
    final_mean, final_cov = covariance(kept_rows, names)
    return RobustFit(n, h, mean, cov, final_mean, final_cov, kept_rows.count())


def robust_envelope(df: DataFrame, cols: Sequence[str], contamination: float = 0.1, out: str = "score", **fit) -> DataFrame:
    """Squared robust distance ``out``, and ``is_anomaly`` for the ``contamination`` share of the rows with the greatest."""
    fitted = fit_robust_covariance(df, cols, **fit)
    scored = df.withColumn(out, distance(df, cols, fitted.mean, fitted.cov))
    bound = fit_quantiles(scored, [out], [1 - contamination])[out][0]
    return scored.withColumn("is_anomaly", (F.col(out) > bound).cast("int"))
