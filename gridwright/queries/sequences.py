"""Sequences, moving statistics, metric histories and operation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import logs, sequence
from gridwright.plans.storage import scratch_path
from gridwright.queries.base import query, rounded, table, union_sql


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query(
    "seq1_sequences",
    """SELECT * FROM (SELECT event_id, user_id, row_number() OVER w - 5 AS start,
      array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS ids,
      lead(value, 2) OVER w AS target FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE start >= 0 AND target IS NOT NULL""",
)
def seq1(spark, sf):
    out = sequence.sequences(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id", "value"], "value", 5, 2)
    return out.select("event_id", "user_id", "start", F.array_join(F.col("sequence.event_id").cast("array<string>"), ",").alias("ids"), "target")


@query(
    "seq2_next_row",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS start,
      list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS l FROM events)
    SELECT user_id, start, repeat('_,', 6 - len(l)) || array_to_string(l[1:len(l) - 1], ',') AS input,
      repeat('0', 6 - len(l)) || repeat('1', len(l) - 1) AS mask,
      repeat('0', 6 - len(l)) || array_to_string(range(len(l) - 1), '') AS positions, l[len(l)] AS target FROM r WHERE len(l) >= 3""",
)
def seq2(spark, sf):
    out = sequence.next_row_windows(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id"], 6, 3)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "")
    ids = F.transform("input", lambda s: F.coalesce(s["event_id"].cast("string"), F.lit("_")))
    return out.select("user_id", "start", F.array_join(ids, ",").alias("input"), text("mask").alias("mask"),
                      text("positions").alias("positions"), F.col("target.event_id").alias("target"))


@query(
    "seq3_detect_time",
    """SELECT unnest(['events', 'orders', 'lineitem', 'customer', 'late']) AS name, unnest(['ts', 'o_orderdate', 'l_shipdate', '', 'big']) AS time_column
    FROM (SELECT min(event_id) FROM events)""",
)
def seq3(spark, sf):
    big = table(spark, sf, "events").select("user_id", (F.col("event_id") + 2_000_000_000).alias("big"))
    frames = {n: table(spark, sf, n) for n in ("events", "orders", "lineitem", "customer")} | {"late": big}
    rows = [(n, sequence.detect_time_column(d) or "") for n, d in frames.items()]
    return spark.createDataFrame(rows, "name string, time_column string")


@query("seq4_group_order", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq_pos FROM events")
def seq4(spark, sf):
    return sequence.with_sequence_position(_events(spark, sf), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "seq_pos")


@query(
    "seq5_ordering",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS auto_pos,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS index_pos FROM events""",
)
def seq5(spark, sf):
    df = _events(spark, sf)
    auto = sequence.ordering_columns(df, "auto", ["event_id"])
    index = sequence.ordering_columns(df, "row_index", ["event_id"])
    out = sequence.with_sequence_position(df, ["user_id"], auto).withColumnRenamed("seq_pos", "auto_pos")
    out = sequence.with_sequence_position(out, ["user_id"], index).withColumnRenamed("seq_pos", "index_pos")
    return out.select("event_id", "auto_pos", "index_pos")


_NAIVE = """(SELECT event_type, value, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_NRP = f"""SELECT 'event_type' AS "column", 'accuracy' AS metric, avg((event_type = pt)::INT::DOUBLE) AS value FROM {_NAIVE}
  UNION ALL SELECT 'value', 'mse', avg((value - pv) * (value - pv)) FROM {_NAIVE}
  UNION ALL SELECT 'value', 'mae', avg(abs(value - pv)) FROM {_NAIVE}
  UNION ALL SELECT 'value', 'rmse', sqrt(avg((value - pv) * (value - pv))) FROM {_NAIVE}"""


@query(
    "seq6_naive_baseline",
    f"""SELECT "column", metric, round(value, 6) AS value FROM ({_NRP})
    UNION ALL SELECT 'average', metric, round(avg(value), 6) FROM ({_NRP}) GROUP BY metric""",
)
def seq6(spark, sf):
    pred = sequence.naive_next_row(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    return rounded(sequence.next_row_errors(pred, ["event_type"], ["value"]))


@query(
    "win1_moving",
    """SELECT event_id, round(avg(value) OVER w, 6) AS value_avg, max(value) OVER w AS value_max, min(value) OVER w AS value_min FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def win1(spark, sf):
    out = sequence.moving_statistics(_events(spark, sf), ["user_id"], ["ts", "event_id"], "value", 10)
    return rounded(out.select("event_id", "value_avg", "value_max", "value_min"))


@query(
    "win2_history",
    """SELECT user_id, event_type, arg_max(value, event_id) AS latest, min(value) AS best, min(event_id) FILTER (value = low) AS best_step
    FROM (SELECT *, min(value) OVER (PARTITION BY user_id, event_type) AS low FROM events) GROUP BY ALL""",
)
def win2(spark, sf):
    return sequence.metric_summary(_events(spark, sf), "user_id", "event_type", "event_id", "value")


@query(
    "win2_table",
    union_sql(["""SELECT user_id, day, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error,
    max(value) FILTER (event_type = 'view') AS "view" FROM (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, max(value) AS value FROM events GROUP BY ALL) GROUP BY ALL"""]),
)
def win2_table(spark, sf):
    log = _events(spark, sf).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max("value").alias("value"))
    return sequence.metric_table(log, ["user_id", "day"], "event_type", "value", ["click", "error", "view"])


@query(
    "win3_early_stop",
    """WITH p AS (SELECT user_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n,
      min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY user_id ORDER BY i), n + 1) AS nxt FROM p WHERE low IS NULL OR value < low)
    SELECT user_id, coalesce(min(i + 5) FILTER (nxt - i > 5), -1) AS stop_at FROM r GROUP BY 1""",
)
def win3(spark, sf):
    out = sequence.early_stops(_events(spark, sf), "user_id", ["ts", "event_id"], "value", 5)
    return out.select("user_id", F.coalesce("stop_at", F.lit(-1)).alias("stop_at"))


@query(
    "win3_early_stop_delta",
    """WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, i, value AS best, i AS best_at, 0 AS wait FROM p WHERE i = 1
      UNION ALL SELECT p.user_id, p.i, CASE WHEN p.value < f.best - 1.0 THEN p.value ELSE f.best END,
        CASE WHEN p.value < f.best - 1.0 THEN p.i ELSE f.best_at END, CASE WHEN p.value < f.best - 1.0 THEN 0 ELSE f.wait + 1 END
      FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1 WHERE f.wait < 10)
    SELECT user_id, coalesce(min(i) FILTER (wait = 10), -1) AS stop_at, max(best_at) AS best_at, min(best) AS best FROM f GROUP BY 1""",
)
def win3_delta(spark, sf):
    out = sequence.early_stops(_events(spark, sf), "user_id", ["ts", "event_id"], "value", 10, min_delta=1.0)
    return out.select("user_id", F.coalesce("stop_at", F.lit(-1)).alias("stop_at"), "best_at", "best")


@query("ord4_group_order", "SELECT event_id, user_id, ts::VARCHAR AS ts FROM events")
def ord4(spark, sf):
    out = sequence.sorted_groups(_events(spark, sf), ["user_id"], ["ts", "event_id"])
    return out.select("event_id", "user_id", F.rtrim(F.rtrim(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")), F.lit(".")).alias("ts"))


# ---------------------------------------------------------------- logs

_BUCKETS = ["10", "50", "100", "500", "1000", "5000", "10000"]


@query(
    "log1_requests",
    """SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
    round(count(*) FILTER (event_type <> 'error')::DOUBLE / count(*), 6) AS success_rate, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate,
    round(avg(value), 6) AS mean_response_ms, round(avg(value * 0.6), 6) AS mean_inference_ms FROM events""",
)
def log1(spark, sf):
    return rounded(logs.request_summary(_requests(spark, sf)))


def _requests(spark, sf):
    return table(spark, sf, "events").select(
        "ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("response_ms"),
        (F.col("value") * 0.6).alias("inference_ms"), F.col("user_id"),
    )


@query(
    "log1_histogram",
    "SELECT bucket, count(*) AS n FROM (SELECT CASE "
    + " ".join(f"WHEN value <= {b} THEN '{b}'" for b in _BUCKETS)
    + " ELSE 'inf' END AS bucket FROM events) GROUP BY 1",
)
def log1_hist(spark, sf):
    return logs.response_histogram(_requests(spark, sf))


@query(
    "log2_latency",
    """SELECT batch_size, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
    round(batch_size * 1000.0 / avg(value), 6) AS throughput
    FROM (SELECT value, [1, 5, 10, 25, 50, 100][(user_id % 6 + 1)::INT]::INTEGER AS batch_size FROM events) GROUP BY 1""",
)
def log2(spark, sf):
    sizes = F.array(*[F.lit(b) for b in (1, 5, 10, 25, 50, 100)])
    df = table(spark, sf, "events").select(F.element_at(sizes, (F.col("user_id") % 6 + 1).cast("int")).alias("batch_size"), F.col("value").alias("latency_ms"))
    return rounded(logs.latency_statistics(df))


@query(
    "log3_training_log",
    """SELECT field, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM (
    SELECT 'loss' AS field, value AS v FROM events UNION ALL SELECT 'step', event_id::DOUBLE FROM events) GROUP BY 1""",
)
def log3(spark, sf):
    path = scratch_path(spark, "metrics")
    t = table(spark, sf, "events").select((F.col("user_id") % 4).alias("rank"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    t.write.partitionBy("rank").json(path)
    return rounded(logs.training_log_summary(logs.read_training_log(spark, path, ["step", "loss"]), ["step", "loss"]))


@query(
    "log4_communication",
    """WITH e AS (SELECT event_type AS type, value / 1000 AS d, user_id * 1024.0 AS b FROM events)
    SELECT type, count(*) AS n, round(sum(d), 4) AS total_duration, round(avg(d), 6) AS mean_duration, round(max(d), 6) AS max_duration, round(min(d), 6) AS min_duration,
      round(sum(b) / 1048576, 6) AS total_mb, round(avg(b / 1048576 / d), 6) AS mean_bandwidth, round(max(b / 1048576 / d), 6) AS max_bandwidth,
      round(sum(b) / 1048576 / greatest(sum(d), 1e-6), 6) AS efficiency FROM e GROUP BY type
    UNION ALL SELECT 'overall', count(*), round(sum(d), 4), round(avg(d), 6), round(max(d), 6), round(min(d), 6), round(sum(b) / 1048576, 6), round(avg(b / 1048576 / d), 6),
      round(max(b / 1048576 / d), 6), round(sum(b) / 1048576 / greatest(sum(d), 1e-6), 6) FROM e""",
)
def log4(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_type").alias("type"), (F.col("value") / 1000).alias("duration"), (F.col("user_id") * 1024.0).alias("bytes"))
    out = rounded(logs.communication_summary(df))
    return out.withColumn("total_duration", F.round("total_duration", 4))


@query(
    "log5_step_timing",
    """WITH s AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS dt FROM events)
    SELECT user_id AS run, count(*) AS steps, round(avg(dt), 6) AS mean_step, round(min(dt), 6) AS min_step, round(max(dt), 6) AS max_step,
    round(1 / avg(dt), 6) AS steps_per_second FROM s GROUP BY 1""",
)
def log5(spark, sf):
    return rounded(logs.step_timing(table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id"), "run", ["ts", "event_id"], "ts"))


@query(
    "log5_scaling",
    """WITH t AS (SELECT user_id % 8 + 1 AS world_size, avg(value) AS throughput FROM events GROUP BY 1)
    SELECT world_size, round(throughput, 6) AS throughput, round(throughput / ((SELECT throughput FROM t WHERE world_size = 1) * world_size), 6) AS efficiency FROM t""",
)
def log5_scaling(spark, sf):
    t = table(spark, sf, "events").groupBy((F.col("user_id") % 8 + 1).alias("world_size")).agg(F.avg("value").alias("throughput"))
    return rounded(logs.scaling_efficiency(t))
