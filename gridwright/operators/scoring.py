"""Batch scoring: validate, normalize, predict, post-process; each distinct input once; fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.operators.validate import Report, Rules, validate
from gridwright.plans.prepare import RobustNormalizer


@dataclass
class Scorer:
    """A fitted normalizer and model. `score` returns the scored rows and the validation report."""

    normalizer: RobustNormalizer | None
    model: PipelineModel
    key_cols: Sequence[str]
    rules: Rules = Rules()

    def transform(self, df: DataFrame, probabilities: bool = False) -> DataFrame:
        """Row-wise part, lazy; also used on micro-batches."""
        out = self.normalizer.transform(df) if self.normalizer else df
        out = self.model.transform(out)
        cols = [*self.key_cols, "prediction"]
        if probabilities and "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
            cols.append("probabilities")
        return out.select(*cols)

    def score(self, df: DataFrame, probabilities: bool = False) -> tuple[DataFrame, Report]:
        return self.transform(df, probabilities), validate(df, self.rules)


def score_with_function(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Custom model as Arrow batches of a partition."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(apply, schema)


def score_distinct(df: DataFrame, feature_cols: Sequence[str], score: Callable[[DataFrame], DataFrame], out_cols: Sequence[str]) -> DataFrame:
    """Score every distinct feature row once and join the result back.

    The join is on the row's hash and on all feature values, so a hash collision cannot mix rows up;
    a feature row that very many rows share is split by AQE's skew join.
    """
    scored = score(df.select(*feature_cols).dropDuplicates())
    right = scored.select(
        F.xxhash64(*feature_cols).alias("__h"), *[F.col(c).alias(f"__f_{c}") for c in feature_cols], *out_cols
    )
    left = df.withColumn("__h", F.xxhash64(*feature_cols))
    cond = left["__h"] == right["__h"]
    for c in feature_cols:
        cond = cond & left[c].eqNullSafe(right[f"__f_{c}"])
    return left.join(right, cond).select(*[left[c] for c in df.columns], *out_cols)


def with_fallback(df: DataFrame, primary: Column, fallback: Column, constant: float = 0.0) -> DataFrame:
    """Prediction from the first source that has one, and which it was."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
    return df.select(
        "*", F.when(ok(primary), primary).when(ok(fallback), fallback).otherwise(F.lit(constant)).alias("prediction"),
        F.when(ok(primary), "primary").when(ok(fallback), "fallback").otherwise("constant").alias("source"),
    )
