"""Survival metrics over (key, time, event, risk) without comparing rows pairwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.special import erfc
from gridwright.plans.ordered import prefix_sums
from gridwright.plans.quantiles import fit_median

EPS = 1e-8


def concordance(df: DataFrame, time: str = "time", event: str = "event", risk: str = "risk") -> DataFrame:
    """Concordance index: among pairs where the earlier row has an event, the share in which it also
    has the higher risk (equal risks do not count). 0.5 when no pair is comparable.

    Pairs are counted, never listed. Distinct risks get dense ranks; for a pair with risk a > b
    there is exactly one binary digit at which the ranks first differ, a having 1 and b having 0.
    So at every digit, rows that share the higher digits form a group, and one prefix sum over
    falling time counts the later rows with digit 0. n rows become n x log2(ranks) rows.
    """
    rows = df.groupBy(F.col(time).alias("t"), F.col(risk).alias("r")).agg(
        F.count("*").alias("n"), F.count_if(F.col(event) == 1).alias("e")
    )
    # comparable pairs: events times the rows with a later time
    times = rows.groupBy("t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    later = prefix_sums(times, [], [F.col("t").desc()], {"later": F.col("n")}, inclusive=False)
    comparable = later.agg(F.coalesce(F.sum(F.col("e") * F.col("later")), F.lit(0)).alias("comparable")).first()[0]
    ranks = prefix_sums(rows.select("r").distinct(), [], ["r"], {"k": F.lit(1)})
    top = ranks.agg(F.max("k")).first()[0] or 1
    digits = max(1, int(top).bit_length())
    ranked = rows.join(ranks.select(F.col("r").alias("__r"), (F.col("k") - 1).cast("long").alias("k")), F.col("r") == F.col("__r"))
    each = ranked.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))))
    shifted = F.expr("shiftright(k, d)")
    one = F.pmod(shifted, F.lit(2)) == 1
    cells = each.groupBy("d", F.expr("shiftright(k, d + 1)").alias("prefix"), "t").agg(
        F.sum(F.when(~one, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(one, F.col("e")).otherwise(0)).alias("ones")
    )
    counted = prefix_sums(cells, ["d", "prefix"], [F.col("t").desc()], {"later": F.col("zeros")}, inclusive=False)
    value = F.lit(0.5) if not comparable else F.coalesce(F.sum(F.col("ones") * F.col("later")), F.lit(0)) / F.lit(float(comparable))
    return counted.agg(F.max(value).alias("c_index") if not comparable else value.alias("c_index"))


def cox_loss(df: DataFrame, key: str = "key", time: str = "time", event: str = "event", risk: str = "risk") -> DataFrame:
    """Negative Cox partial log-likelihood; the risk set is a running sum of exp(risk) in falling
    time (ties by key)."""
    scored = prefix_sums(
        df.select(key, time, event, risk), [], [F.col(time).desc(), F.col(key)], {"__set": F.exp(F.col(risk))}
    )
    ll = (F.col(risk) - F.log(F.col("__set") + EPS)) * F.col(event)
    return scored.agg((-F.sum(ll) / (F.sum(event) + EPS)).alias("cox_loss"))


def survival_curve(hazard: Column) -> Column:
    """Running product of (1 - hazard) as an array."""
    return F.aggregate(
        hazard, F.array().cast("array<double>"),
        lambda acc, h: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1.0)) * (1.0 - h))),
    )


def time_bin(time: Column, max_time: float, bins: int) -> Column:
    return F.least(F.greatest((time / F.lit(max_time) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))


def discrete_nll(df: DataFrame, hazard: str, bins: int, max_time: float | None = None, time: str = "time", event: str = "event") -> DataFrame:
    """Discrete-time negative log-likelihood; max_time defaults to the largest time."""
    if max_time is None:
        max_time = df.agg(F.max(time)).first()[0]
    b = time_bin(F.col(time), max_time, bins)
    last = F.when(F.col(event) == 1, b - 1).otherwise(b)
    logs = F.transform(F.col(hazard), lambda h, i: F.when(i <= last, -F.log(1 - h + EPS)).otherwise(0.0))
    base = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x)
    hit = F.when(F.col(event) == 1, -F.log(F.element_at(hazard, b + 1) + EPS)).otherwise(0.0)
    return df.agg(F.avg(base + hit).alias("nll"))


def parametric_nll(df: DataFrame, distribution: str, time: str = "time", event: str = "event") -> DataFrame:
    """Mean negative log-likelihood: weibull (shape, scale), exponential (rate), log_normal (mu, sigma)."""
    t = F.col(time)
    if distribution == "weibull":
        k, s = F.col("shape"), F.col("scale")
        surv = -F.pow(t / s, k)
        dens = F.log(k) - F.log(s) + (k - 1) * (F.log(t) - F.log(s)) + surv
    elif distribution == "exponential":
        surv = -F.col("rate") * t
        dens = F.log(F.col("rate")) + surv
    elif distribution == "log_normal":
        mu, sg = F.col("mu"), F.col("sigma")
        lt = F.log(t + EPS)
        dens = -F.log(sg) - F.log(t) - 0.5 * math.log(2 * math.pi) - 0.5 * F.pow((lt - mu) / sg, F.lit(2.0))
        surv = F.log(0.5 * erfc((lt - mu) / (sg * math.sqrt(2.0))) + EPS)
    else:
        raise ValueError(distribution)
    ll = F.when(F.col(event) == 1, dens).otherwise(surv)
    return df.agg((-F.avg(ll)).alias("nll"))


def parametric_survival(df: DataFrame, distribution: str, max_time: float, points: int) -> DataFrame:
    """One row per input row and time of an even grid, with S(t)."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.lit(max_time / (points - 1)))
    out = df.withColumn("t", F.explode(grid))
    t = F.col("t")
    if distribution == "weibull":
        s = F.exp(-F.pow(t / F.col("scale"), F.col("shape")))
    elif distribution == "exponential":
        s = F.exp(-F.col("rate") * t)
    else:
        s = 0.5 * erfc((F.log(t + EPS) - F.col("mu")) / (F.col("sigma") * math.sqrt(2.0)))
    return out.withColumn("survival", s)


def brier(df: DataFrame, curve: str, bins: int, max_time: float | None = None, time: str = "time") -> DataFrame:
    """Squared error of the survival probability at the middle bin against being alive at mid time."""
    mid = max_time * 0.5 if max_time else fit_median(df, [time])[time]
    alive = (F.col(time) > mid).cast("double")
    p = F.element_at(curve, bins // 2 + 1)
    return df.agg(F.avg((p - alive) * (p - alive)).alias("brier"))
