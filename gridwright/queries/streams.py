"""Streaming queries over the events table, cut into files by day; each has a batch answer."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridwright.operators import encode, tokenize
from gridwright.plans import prepare
from gridwright.plans.storage import scratch_path
from gridwright.queries.base import query, rounded, table
from gridwright.streaming import streams as st

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
FILES = 2


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _slice(ts="ts"):
    return F.floor((F.dayofmonth(ts) - 1) / 8).cast("int")


def dripped(spark, sf, fmt="parquet"):
    """The events in four consecutive slices of days, written one after the other."""
    path = scratch_path(spark, "drip")
    df = _events(spark, sf)
    for i in range(4):
        part = df.where(_slice() == i).repartition(FILES, "user_id")
        w = part.write.mode("append")
        (w.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if fmt == "csv" else w).format(fmt).save(path)
    return path


@query(
    "str1_prepare_stream",
    """WITH p AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), t AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM
      (SELECT DISTINCT event_type AS token FROM events UNION SELECT '<UNK>' UNION SELECT '<MASK>'))
    SELECT event_id, round((value - m) / s, 6) AS value, id::INTEGER AS type_id FROM events JOIN t ON token = event_type, p""",
)
def str1(spark, sf):
    batch = _events(spark, sf).drop("ts")
    fitted = prepare.fit_prepare(batch, ["event_id", "user_id"])
    tok = tokenize.fit_tokenizer(batch, ["event_type"])
    stream = st.read_stream(spark, dripped(spark, sf, "csv"), SCHEMA, max_files=FILES)
    out = st.prepare_stream(stream.drop("ts"), fitted, tok)
    sink = scratch_path(spark, "out")
    st.to_parquet(out.select("event_id", "value", F.col("tokens")[0]["token_id"].alias("type_id")), sink, scratch_path(spark, "ckpt"))
    return rounded(spark.read.parquet(sink))


@query("str2_unfitted_refused", "SELECT count(*) AS n, 1 AS refused FROM events")
def str2(spark, sf):
    stream = st.read_stream(spark, dripped(spark, sf), SCHEMA, "parquet")
    try:
        st.prepare_stream(stream, None)
        refused = 0
    except ValueError:
        refused = 1
    return _events(spark, sf).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query(
    "str3_quarantine",
    "SELECT event_id, (event_id % 10 = 0)::INT AS bad, CASE WHEN event_id % 10 = 0 THEN 'oops' || event_id ELSE 'fine' END AS content FROM events",
)
def str3(spark, sf):
    path = scratch_path(spark, "dirty")
    v = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("oops"), "event_id")).otherwise(F.col("value").cast("string"))
    _events(spark, sf).select("event_id", v.alias("value")).write.option("header", True).csv(path)
    stream = st.read_stream(spark, path, "event_id long, value string, _corrupt_record string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    st.run_available(stream, scratch_path(spark, "ckpt"), st.quarantine_writer(good, bad, {"value": "double"}))
    a = st.read_batches(spark, good).select("event_id", F.lit(0).alias("bad"), F.lit("fine").alias("content"))
    b = st.read_batches(spark, bad).select("event_id", F.lit(1).alias("bad"), F.col("value").alias("content"))
    return a.unionByName(b)


@query(
    "str4_request_windows",
    """SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed,
    round(avg(value), 6) AS mean_response_ms FROM events GROUP BY 1""",
)
def str4(spark, sf):
    stream = st.read_stream(spark, dripped(spark, sf), SCHEMA, "parquet", FILES)
    req = stream.select("ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("response_ms"), (F.col("value") * 0.6).alias("inference_ms"))
    out = scratch_path(spark, "windows")
    st.run_available(st.request_windows(req, delay="40 days"), scratch_path(spark, "ckpt"), st.batch_writer(out), "update")
    last = st.latest_update(st.read_batches(spark, out), ["start"])
    return rounded(last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "total", "failed", "mean_response_ms"))


@query(
    "str5_rolling",
    """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, round(avg(value), 9) AS avg, max(value) AS max, min(value) AS min, count(*) AS n FROM (
    SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS s, event_type, value FROM events) GROUP BY 1, 2""",
)
def str5(spark, sf):
    stream = st.read_stream(spark, dripped(spark, sf), SCHEMA, "parquet", FILES)
    out = scratch_path(spark, "rolling")
    roll = st.rolling_metrics(stream, "ts", "event_type", "value", "12 hours", "6 hours", "40 days")
    st.run_available(roll, scratch_path(spark, "ckpt"), st.batch_writer(out), "update")
    last = st.latest_update(st.read_batches(spark, out), ["start", "event_type"])
    return rounded(last.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), 9)


@query(
    "str5_early_stop",
    """WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT user_id, i, n, value AS best, i AS best_at, 0 AS wait FROM p WHERE i = 1
      UNION ALL SELECT p.user_id, p.i, p.n, CASE WHEN p.value < f.best - 1.0 THEN p.value ELSE f.best END,
        CASE WHEN p.value < f.best - 1.0 THEN p.i ELSE f.best_at END, CASE WHEN p.value < f.best - 1.0 THEN 0 ELSE f.wait + 1 END
      FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1 WHERE f.wait < 10)
    SELECT user_id AS run, max(n) AS n, min(best) AS best, max(best_at) AS best_at, coalesce(min(i) FILTER (wait = 10), 0) AS stop_at FROM f GROUP BY 1""",
)
def str5_early(spark, sf):
    stream = st.read_stream(spark, dripped(spark, sf), SCHEMA, "parquet", FILES)
    out = scratch_path(spark, "stops")
    with st.state_store(spark):
        stops = st.early_stop_stream(stream, "user_id", "ts", "value", 10, 1.0, "40 days", timedelta(days=400))
        st.run_available(stops, scratch_path(spark, "ckpt"), st.batch_writer(out), "update")
    return st.latest_update(st.read_batches(spark, out), ["run"]).drop("late", "closed")


@query("str6_scoring", "SELECT event_id, round(value * 3 - 1, 6) AS prediction FROM events")
def str6(spark, sf):
    stream = st.read_stream(spark, dripped(spark, sf), SCHEMA, "parquet", FILES)
    out = scratch_path(spark, "scores")
    score = lambda b: b.select("event_id", (F.col("value") * 3 - 1).alias("prediction"))
    st.run_available(stream, scratch_path(spark, "ckpt"), st.scoring_writer(out, score))
    return rounded(st.read_batches(spark, out).drop("batch_id"))


@query("str6_model_scoring")
def str6_model(spark, sf):
    from gridwright.queries.models import fitted_scorer

    batch = _events(spark, sf).select("event_id", "event_type", F.hour("ts").alias("hour"), F.col("value").alias("o_totalprice"))
    scorer = fitted_scorer(batch, ["event_id"])
    stream = st.read_stream(spark, dripped(spark, sf), SCHEMA, "parquet", FILES)
    stream = stream.select("event_id", "event_type", F.hour("ts").alias("hour"), F.col("value").alias("o_totalprice"))
    out = scratch_path(spark, "scores")
    st.run_available(stream, scratch_path(spark, "ckpt"), st.scoring_writer(out, scorer.transform))
    return rounded(st.read_batches(spark, out).drop("batch_id"), 4)


_BINS = 10


@query(
    "str7_drift",
    f"""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*)::DOUBLE AS tot FROM events), b AS (SELECT (day(ts) - 1) // 8 AS batch_id, least(floor((value - lo) / (hi - lo) * {_BINS}), {_BINS - 1}) AS b FROM events, e),
    g AS (SELECT batch_id, bin, (SELECT count(*) FROM b WHERE b.batch_id = i.batch_id AND b.b <= bin) AS n, (SELECT count(*) FROM b WHERE b.b <= bin) / (SELECT tot FROM e) AS ref
      FROM (SELECT DISTINCT batch_id FROM b) i, (SELECT unnest(range({_BINS})) AS bin))
    SELECT batch_id::INTEGER AS batch_id, max(n) AS n, round(max(abs(n::DOUBLE / m - ref)), 6) AS score, (max(abs(n::DOUBLE / m - ref)) > 0.1)::INTEGER AS drifted
    FROM (SELECT *, max(n) OVER (PARTITION BY batch_id) AS m FROM g) GROUP BY 1""",
)
def str7(spark, sf):
    batch = _events(spark, sf)
    edges = encode.uniform_edges(batch, ["value"], _BINS)["value"]
    shares = st.reference_profile(batch, F.col("value"), edges)
    stream = st.read_stream(spark, dripped(spark, sf), SCHEMA, "parquet", FILES)
    out = scratch_path(spark, "drift")
    st.run_available(stream, scratch_path(spark, "ckpt"), st.drift_writer(out, F.col("value"), edges, shares))
    return rounded(st.read_batches(spark, out))
