"""A bounded sample of labelled texts, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.storage import stored
from gridwright.llm.textblocks import held_out_ids

#: Labelled rows a classifier learns from at most; the first by a hash of their id, the same in every run.
SAMPLE_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label, part) of at most ``rows`` labelled ids that are not held out; one row for copies of a text with one
    label, so that a group of copies counts once. part: 0 to 4 by a hash of the text. Null labels and ids are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out_ids("doc_id", modulus, remainder))
    ids = known.select("doc_id", F.col(label).cast("int").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    ids = stored(ids, "ids")  # bounded by ``rows``, hence broadcast
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    picked = picked.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"))
    return stored(picked.select("text", "label", F.pmod("h", F.lit(5)).cast("int").alias("part")), "sample")
