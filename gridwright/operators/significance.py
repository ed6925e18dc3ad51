"""Paired tests and bootstrap intervals over a frame of paired scores (a, b)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.hashing import uniform
from gridwright.functions.special import normal_two_sided, student_two_sided
from gridwright.plans.ordered import prefix_sums
from gridwright.plans.quantiles import fit_quantiles


def paired_t(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict:
    d = F.col(a) - F.col(b)
    r = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")).first()
    t = r["mean"] / (r["sd"] / math.sqrt(r["n"])) if r["sd"] else float("nan")
    p = student_two_sided(t, r["n"] - 1)
    return {"statistic": t, "p_value": p, "significant": p < alpha, "mean_difference": r["mean"], "n": r["n"]}


def paired_t_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_difference"),
        (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("statistic"),
    )


def wilcoxon_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums without zeros; equal |d| share their average rank, taken from the counts of
    distinct |d| and their prefix sums. `ties` is sum(t^3 - t)."""
    d = (F.col(a) - F.col(b)).alias("d")
    counts = df.select(d).where("d <> 0").groupBy(F.abs("d").alias("m")).agg(
        F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up")
    )
    cum = prefix_sums(counts, [], ["m"], {"hi": F.col("n")})
    rank = F.col("hi") - (F.col("n") - 1) / 2.0
    return cum.agg(
        F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * (F.col("n") - F.col("up"))).alias("w_minus"),
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    ).withColumn("statistic", F.least("w_plus", "w_minus"))


#: Up to so many differences, none of them 0 and none tied, p is exact.
EXACT_DIFFERENCES = 50


def signed_rank_tail(n: int, w: int) -> float:
    """P(W <= w) of the signed-rank sum of n differences: of all 2**n choices of signs, those whose ranks sum to w at most, counted
    by adding one rank after the other."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return sum(ways[: w + 1]) / 2**n


def wilcoxon(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict:
    """p from the exact distribution for few differences without ties and zeros, else by the normal approximation with tie
    correction."""
    r = wilcoxon_statistic(df, a, b).first()
    n = r["n"] or 0
    if n == 0:
        return {"statistic": 0.0, "p_value": 1.0, "significant": False, "n": 0}
    if n <= EXACT_DIFFERENCES and r["ties"] == 0 and df.where(F.col(a) == F.col(b)).isEmpty():
        p = min(1.0, 2 * signed_rank_tail(n, int(r["statistic"])))
    else:
        mean = n * (n + 1) / 4
        var = n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48
        p = normal_two_sided((r["statistic"] - mean) / math.sqrt(var)) if var > 0 else 1.0
    return {"statistic": r["statistic"], "p_value": p, "significant": p < alpha, "n": n}


def poisson_weight(u: Column, top: int = 12) -> Column:
    """Poisson(1) draw from a uniform by the inverse distribution."""
    out, cdf, term = None, 0.0, math.exp(-1.0)
    for k in range(top):
        cdf += term
        term /= k + 1
        out = F.when(u < cdf, k) if out is None else out.when(u < cdf, k)
    return out.otherwise(top)


def bootstrap_means(df: DataFrame, value: str, key: str, n: int = 1000, seed: int = 42, blocks: int = 1000) -> DataFrame:
    """(replicate, mean). The units that are drawn again are `blocks` blocks of rows by a hash of the key, at every
    table size, so a replicate re-weights at most `blocks` sums and never the raw rows."""
    unit = F.floor(uniform([key], "block", seed) * blocks).cast("string")
    sums = df.groupBy(unit.alias("unit")).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    reps = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = poisson_weight(uniform(["unit", "replicate"], "boot", seed))
    return reps.groupBy("replicate").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("c"))).alias("mean"))


def bootstrap_interval(df: DataFrame, value: str, key: str, level: float = 0.95, n: int = 1000, seed: int = 42) -> DataFrame:
    means = bootstrap_means(df, value, key, n, seed)
    tail = (1 - level) / 2
    lo, hi = fit_quantiles(means, ["mean"], [tail, 1 - tail])["mean"]
    return df.agg(F.avg(value).alias("mean")).select("mean", F.lit(lo).alias("lower"), F.lit(hi).alias("upper"))
