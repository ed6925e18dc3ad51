"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated a Poisson-distributed number of times; the mean is the source's target share of the
mixed rows over its present share, ``weight * total / rows``. The number comes from inverting the distribution at a
uniform number hashed from the seed, the document's id and its text, so retries and partitions change nothing. Copies are
then dealt over all partitions by a hash and ordered by it within each: a global shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gridwright.llm.storage import stored

#: Without weights, a source's weight is its number of rows to this power: small sources are raised, large ones lowered.
TEMPER = 0.5
SALTS = 16


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts; a null part counts as the text ``null``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def document_key() -> Column:
    """The md5 of a document's id and text, null parts as the text ``null``."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "text")]))


def _distribution(mean: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... up to where no 52-bit number lies above."""
    out, total, k = [], 0.0, 0
    while k <= mean + 12 * math.sqrt(mean) + 40:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
        out.append(min(total, 1.0))
        k += 1
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def poisson_distribution(mean: pd.Series) -> pd.Series:
    return mean.map(_distribution)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: int | None = None) -> DataFrame:
    """(source, n, rate, cdf), one row a source that is present. Given weights need not sum to one; a source without a
    weight gets none. A null source is a source of its own, which only the default weights reach."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPER))
    else:
        given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, weight double")
        counts = counts.join(given, "source", "left")
        weight = F.coalesce("weight", F.lit(0.0))
    counts = stored(counts.select("source", "n", weight.alias("weight")), "sources")
    total, mass = counts.agg(F.sum("n"), F.sum("weight")).first()
    target = float(total or 0) if rows is None else float(rows)
    rate = F.col("weight") / F.lit(mass or 1.0) * F.lit(target) / F.col("n")
    return stored(counts.select("source", "n", rate.alias("rate")).withColumn("cdf", poisson_distribution("rate")), "rates")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: int | None = None, seed: int = 1) -> DataFrame:
    """Rows of ``docs`` as often as drawn, with ``copies`` (how often), ``copy`` (from 1) and ``position`` (the hash that
    orders the shuffle) besides all columns of ``docs``; a column of one of these names is replaced.

    ``rows``: expected rows of the result, by default as many as there are. A source with a weight of 0 gives nothing.
    Rows of one doc_id with different texts are drawn apart, whether the id is null or not; rows that repeat id and text are
    drawn alike. A null doc_id, text or source is a value like any other. An empty table gives an empty table.
    """
    rates = source_rates(docs, weights, rows)
    salted = rates.select(F.col("source").alias("_source"), F.col("cdf").alias("_cdf"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    names = [c for c in docs.columns if c not in ("copies", "copy", "position")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("_key", document_key())
    kept = kept.withColumn("_pick", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    drawn = kept.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_pick") == F.col("_salt")))
    u = uniform(F.lit(seed), F.col("_key"))
    drawn = drawn.withColumn("_u", u).withColumn("copies", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))))
    copies = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    copies = copies.withColumn("position", uniform(F.lit(seed), F.lit("shuffle"), F.col("_key"), F.col("copy")))
    spread = copies.select(*names, "copies", "copy", "position").repartition(F.col("position"))
    return spread.sortWithinPartitions("position", "doc_id", "copy")
