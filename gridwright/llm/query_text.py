"""Queries of the operators on texts and pages."""

from __future__ import annotations

from gridwright.llm.queries import query, table


@query("op10_minhash_neardup")
def op10(spark, sf):
    from gridwright.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf, "documents")).drop("k")


@query("op5_pigeonhole_decontamination")
def op5(spark, sf):
    from gridwright.llm.decontam import decontaminate

    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_line_winnowing")
def op3(spark, sf):
    from gridwright.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf, "documents")).withColumnsRenamed({"_removed": "removed", "_emptied": "emptied"})


OP1_SQL = """
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
total AS (SELECT sum(n)::DOUBLE AS n, sum(weight) AS weight FROM counts),
rates AS (SELECT c.source, c.weight / t.weight * t.n / c.n AS rate FROM counts c, total t),
steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k)),
cdfs AS (SELECT source, list(least(cdf, 1.0) ORDER BY k) AS cdf FROM steps GROUP BY source),
keyed AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, 'null')) AS key FROM documents),
drawn AS (
  SELECT d.*, len(list_filter(c.cdf, lambda x: x <= CAST(CAST('0x' || substr(md5('1|' || d.key), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)) AS copies
  FROM keyed d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source),
copied AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, CAST(copies AS INTEGER) AS copies, CAST(copy AS INTEGER) AS copy,
  CAST(CAST('0x' || substr(md5('1|shuffle|' || key || '|' || CAST(copy AS VARCHAR)), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS position
FROM copied
"""


@query("op1_poisson_mixing", OP1_SQL)
def op1(spark, sf):
    from gridwright.llm.mixing import mix

    return mix(table(spark, sf, "documents"))


@query("op2_weak_supervision_pii")
def op2(spark, sf):
    from gridwright.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf, "documents"))


@query("op6_boosted_dom_text")
def op6(spark, sf):
    from gridwright.llm.htmltext import main_text

    return main_text(table(spark, sf, "pages"))


@query("op13_imatch_fingerprints")
def op13(spark, sf):
    from gridwright.llm.imatch import edited_fingerprints

    return edited_fingerprints(table(spark, sf, "documents"))
