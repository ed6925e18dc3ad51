"""Samples, splits, folds and shards."""

from __future__ import annotations


from gridwright.operators import split
from gridwright.queries.base import hash_sql, query, table, uniform_sql

_H = hash_sql("o_orderkey")


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("spl1_sample", f"SELECT o_orderkey FROM orders ORDER BY {_H}, o_orderkey LIMIT 1000")
def spl1(spark, sf):
    return split.sample(_orders(spark, sf), ["o_orderkey"], n=1000).select("o_orderkey")


@query(
    "spl1_fraction",
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_H}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
    WHERE r <= floor(n * 0.5::DOUBLE)""",
)
def spl1_fraction(spark, sf):
    return split.sample(_orders(spark, sf), ["o_orderkey"], fraction=0.5).select("o_orderkey")


@query(
    "spl2_stratified_sample",
    f"""WITH c AS (SELECT o_orderstatus AS s, count(*) AS n, 1000 AS k, (sum(count(*)) OVER ())::BIGINT AS t FROM orders GROUP BY 1),
    b AS (SELECT s, (n * k) // t AS base, (n * k) % t AS rest FROM c),
    a AS (SELECT s, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, s) <= 1000 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS take FROM b),
    r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) AS r FROM orders)
    SELECT o_orderkey, o_orderstatus FROM r JOIN a ON o_orderstatus = s WHERE r <= take""",
)
def spl2(spark, sf):
    return split.stratified_sample(_orders(spark, sf), ["o_orderkey"], "o_orderstatus", 1000).select("o_orderkey", "o_orderstatus")


@query(
    "spl3_split",
    f"""SELECT o_orderkey, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders
    WINDOW w AS (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey))""",
)
def spl3(spark, sf):
    return split.split(_orders(spark, sf), ["o_orderkey"], stratify="o_orderstatus").select("o_orderkey", "split")


@query(
    "spl3_split_by_hash",
    f"""SELECT o_orderkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, {uniform_sql("o_orderkey", "split")} AS u FROM orders)""",
)
def spl3_hash(spark, sf):
    return split.split_by_hash(_orders(spark, sf), ["o_orderkey"]).select("o_orderkey", "split")


@query(
    "spl4_train_eval",
    f"""SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'eval' ELSE 'train' END AS split
    FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) AS r,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def spl4(spark, sf):
    return split.train_eval(_orders(spark, sf), ["o_orderkey"], stratify="o_orderstatus").select("o_orderkey", "split")


@query(
    "spl5_folds",
    f"""SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""",
)
def spl5(spark, sf):
    return split.folds(_orders(spark, sf), ["o_orderkey"], 5, "o_orderstatus").select("o_orderkey", "fold")


@query(
    "spl6_time_folds",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
    f AS (SELECT r.*, k::INTEGER AS fold, n // 6 AS size, n - (5 - k) * (n // 6) AS start FROM r, range(5) t(k))
    SELECT o_orderkey, fold, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role FROM f
    WHERE i < start + size AND (i >= start OR i >= start - 5000)""",
)
def spl6(spark, sf):
    return split.time_folds(_orders(spark, sf), ["o_orderdate", "o_orderkey"], 5, max_train=5000).select("o_orderkey", "fold", "role")


@query(
    "spl7_nested_subsets",
    f"""SELECT o_orderkey, subset FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_H}, o_orderkey) AS r, count(*) OVER () AS n FROM orders),
    (SELECT unnest([100, 500, 1000, 2000, 5000, 100000000])::INTEGER AS subset) WHERE r <= subset AND subset <= n""",
)
def spl7(spark, sf):
    return split.nested_subsets(_orders(spark, sf), ["o_orderkey"], (100, 500, 1000, 2000, 5000, 100_000_000)).select("o_orderkey", "subset")


@query(
    "spl7_nested_stratified",
    f"""WITH a AS (SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus) AS q FROM orders),
    b AS (SELECT *, row_number() OVER (ORDER BY q, o_orderstatus, o_orderkey) AS r, count(*) OVER () AS n FROM a)
    SELECT o_orderkey, subset FROM b, (SELECT unnest([100, 500, 1000])::INTEGER AS subset) WHERE r <= subset AND subset <= n""",
)
def spl7_stratified(spark, sf):
    return split.nested_subsets(_orders(spark, sf), ["o_orderkey"], (100, 500, 1000), "o_orderstatus").select("o_orderkey", "subset")


@query("spl8_shards", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 1024 AS shard_id FROM events")
def spl8(spark, sf):
    t = table(spark, sf, "events").select("event_id", "ts")
    return split.shards_by_size(t, ["ts", "event_id"], 1024).select("event_id", "shard_id")


@query(
    "spl8_hash_shards",
    f"SELECT event_id, CAST(floor({uniform_sql('event_id', 'shard')} * 16) AS BIGINT) AS shard_id FROM events",
)
def spl8_hash(spark, sf):
    return split.hash_shards(table(spark, sf, "events").select("event_id"), ["event_id"], 16)


@query(
    "spl9_balance",
    """WITH s AS (SELECT (max(r) - 1) // 1024 + 1 AS n FROM (SELECT row_number() OVER () AS r FROM events)),
    g AS (SELECT unnest(range(((n + 3) // 4 * 4)::BIGINT)) AS i, n FROM s)
    SELECT CAST(i % 4 AS INTEGER) AS rank, i // 4 AS slot, CASE WHEN i < n THEN i ELSE -1 END AS shard_id FROM g""",
)
def spl9(spark, sf):
    return split.balance_shards(spl8(spark, sf), 4)


@query(
    "spl10_distributed_sampler",
    f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {hash_sql("event_id")}, event_id) AS r, count(*) OVER () AS n FROM events),
    p AS (SELECT event_id, r AS pos, n FROM r UNION ALL SELECT event_id, r + n, n FROM r WHERE r + n <= (n + 6) // 7 * 7)
    SELECT event_id, CAST((pos - 1) % 7 AS INTEGER) AS rank, (pos - 1) // 7 AS position FROM p""",
)
def spl10(spark, sf):
    return split.distributed_sample(table(spark, sf, "events").select("event_id"), ["event_id"], 7)


@query(
    "spl10_drop_last",
    f"""SELECT event_id, CAST((r - 1) % 7 AS INTEGER) AS rank, (r - 1) // 7 AS position FROM (
    SELECT event_id, row_number() OVER (ORDER BY {hash_sql("event_id")}, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r <= n // 7 * 7""",
)
def spl10_drop(spark, sf):
    return split.distributed_sample(table(spark, sf, "events").select("event_id"), ["event_id"], 7, drop_last=True)


