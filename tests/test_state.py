"""State of running evaluations: order, late rows, expiry, and recovery from a checkpoint."""

import random
from datetime import datetime, timedelta

from test_skew import fold

from gridwright.streaming import streams as st

START = datetime(2024, 1, 1)
SCHEMA = "run string, ts timestamp, value double"


def put(spark, path, rows):
    spark.createDataFrame([(r, START + timedelta(minutes=m), v) for r, m, v in rows], SCHEMA).repartition(2).write.mode("append").parquet(path)


def run_all(spark, path, out, checkpoint, patience, delta, delay="10 minutes", idle=timedelta(hours=2)):
    with st.state_store(spark):
        stream = st.early_stop_stream(st.read_stream(spark, path, SCHEMA, "parquet"), "run", "ts", "value", patience, delta, delay, idle)
        st.run_available(stream, checkpoint, st.batch_writer(out), "update")
    return {r["run"]: r for r in st.latest_update(st.read_batches(spark, out), ["run"]).collect()}


def test_goes_on_from_a_checkpoint(spark, tmp_path):
    """Each round is a new query on the checkpoint of the one before; together they equal the fold."""
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    r = random.Random(1)
    values = {f"r{k}": [50 - 0.4 * i + r.uniform(-3, 3) for i in range(60)] for k in range(6)}
    for begin in range(0, 60, 20):
        put(spark, path, [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs) if begin <= i < begin + 20])
        got = run_all(spark, path, out, checkpoint, 6, 2.0, "1 day", timedelta(days=9))
        for k, vs in values.items():
            stop, at, best = fold(vs[: begin + 20], 6, 2.0)
            assert (got[k]["n"], got[k]["stop_at"], got[k]["best_at"], got[k]["best"], got[k]["late"]) == (begin + 20, stop or 0, at, best, 0)


def test_late_rows_and_expiry(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    put(spark, path, [("a", 0, 5.0), ("a", 10, 4.0), ("a", 20, 3.0), ("b", 20, 1.0)])
    first = run_all(spark, path, out, checkpoint, 5, 0.0, "1 hour")
    assert (first["a"]["n"], first["a"]["best"], first["a"]["closed"]) == (3, 3.0, 0)
    # Within the watermark, but before the last row of the run: counted, not folded.
    put(spark, path, [("a", 15, -9.0), ("a", 25, 2.0)])
    second = run_all(spark, path, out, checkpoint, 5, 0.0, "1 hour")
    assert (second["a"]["n"], second["a"]["best"], second["a"]["late"]) == (4, 2.0, 1)
    # Another run's rows move the watermark past a's idle time: a is closed.
    put(spark, path, [("b", 400, 1.0)])
    third = run_all(spark, path, out, checkpoint, 5, 0.0, "1 hour")
    assert (third["a"]["closed"], third["a"]["n"], third["a"]["best"]) == (1, 4, 2.0)
    # Behind the watermark: left out. After it: a begins anew.
    put(spark, path, [("a", 30, -99.0), ("a", 500, 7.0)])
    fourth = run_all(spark, path, out, checkpoint, 5, 0.0, "1 hour")
    assert (fourth["a"]["closed"], fourth["a"]["n"], fourth["a"]["best"], fourth["a"]["late"]) == (0, 1, 7.0, 0)
