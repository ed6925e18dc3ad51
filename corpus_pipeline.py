"""The training-data pipeline: toxic documents go, repeated runs of lines go, near-duplicates go, documents with benchmark
items go, and the rest is mixed to target weights. Each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.decontam import clean_documents
from gridwright.llm.linededup import dedup_lines
from gridwright.llm.mixing import mix
from gridwright.llm.neardup import without_near_duplicates
from gridwright.llm.storage import stored
from gridwright.llm.toxicity import fit_toxicity

#: Learned and iterative stages have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model learned from the labels."""
    return fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that earlier documents hold; those of which nothing is left go."""
    cut = dedup_lines(docs).where("not _emptied")
    changed = F.size("_removed") > 0
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at a similarity of 0.8."""
    return without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
