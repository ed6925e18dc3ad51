"""Queries on conversations."""

from __future__ import annotations

from gridwright.llm.queries import query, table

_ROUND = "CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
  lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: {_ROUND})), 4294967295)"""

OP11_SQL = f"""
WITH rows AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT c, turn, md5(length(role) || ':' || role || text) AS digest, strlen(text) AS bytes FROM rows),
own AS (SELECT c, digest, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos FROM hashed),
convs AS (SELECT c, n, c - c % 5 AS b, CAST({_CRC} % 9 AS BIGINT) AS h FROM (SELECT c, count(*) AS n FROM own GROUP BY c)),
turns AS (
  SELECT v.c, o.pos, o.digest, o.bytes FROM convs v JOIN own o ON o.c = v.b AND o.pos <= v.h
  UNION ALL
  SELECT v.c, least(v.h, coalesce(w.n, 0)) + o.pos - v.h, o.digest, o.bytes FROM convs v JOIN own o ON o.c = v.c AND o.pos > v.h LEFT JOIN convs w ON w.c = v.b),
paths AS (
  SELECT c, pos AS d, md5(string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos)) AS p, bytes FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT d, p, min(c) AS m, count(*) AS n, max(bytes) AS bytes FROM paths GROUP BY d, p),
linked AS (
  SELECT x.d, x.p, x.m, x.n, x.bytes, y.p AS parent, z.m AS parent_m FROM nodes x
  LEFT JOIN paths y ON y.c = x.m AND y.d = x.d - 1 LEFT JOIN nodes z ON z.d = y.d AND z.p = y.p),
kids AS (SELECT d - 1 AS d, parent AS p, count(*) AS k FROM linked WHERE d > 0 GROUP BY 1, 2),
sums AS (
  SELECT a.d, a.p, count(*) FILTER (WHERE k.k IS NULL) AS leaves, sum((x.n - 1) * x.bytes) AS saved
  FROM nodes x JOIN paths a ON a.c = x.m AND a.d <= x.d LEFT JOIN kids k ON k.d = x.d AND k.p = x.p GROUP BY a.d, a.p),
ends AS (
  SELECT d, p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM paths q
  WHERE d = (SELECT max(d) FROM paths r WHERE r.c = q.c) GROUP BY d, p)
SELECT x.m AS conv_id, x.d AS depth, x.parent_m AS parent_conv_id, x.n AS n_convs, coalesce(k.k, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM linked x JOIN sums s ON s.d = x.d AND s.p = x.p LEFT JOIN kids k ON k.d = x.d AND k.p = x.p LEFT JOIN ends e ON e.d = x.d AND e.p = x.p
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf):
    from gridwright.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf, "conversations"))
