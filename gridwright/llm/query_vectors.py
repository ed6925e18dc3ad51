"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.llm.queries import query, table

OP4_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT vec_id, min(v) AS v FROM whole WHERE vec_id % 20 = 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM queries q, whole c WHERE q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


@query("op4_histogram_topk", OP4_SQL)
def op4(spark, sf):
    from gridwright.llm.topk import top_k, usable, whole

    rows = table(spark, sf, "embeddings").where(usable("embedding")).select(F.col("vec_id").alias("id"), whole("embedding").alias("v"))
    return top_k(rows, rows.where(F.col("id") % 20 == 0))


@query("op12_embedding_whitening")
def op12(spark, sf):
    from gridwright.llm.whitening import whiten

    return whiten(table(spark, sf, "embeddings"))
