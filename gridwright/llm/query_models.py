"""Queries of the operators that fit a model."""

from __future__ import annotations

from gridwright.llm.queries import query, table


@query("op7_quality_classifier")
def op7(spark, sf):
    from gridwright.llm.quality import quality

    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_toxicity_segments")
def op9(spark, sf):
    from gridwright.llm.toxicity import toxicity

    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_backoff_automaton")
def op8(spark, sf):
    from gridwright.llm.lm import language_model

    return language_model(table(spark, sf, "documents"))
