"""Streams: files in, fitted row-wise transforms, windowed metrics, scoring and drift per micro-batch.

Anything fitted is fitted in batch and handed in as a parameter object; a stream never fits itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridwright.functions.statistics import ratio
from gridwright.operators.encode import bin_id
from gridwright.operators.logs import request_metrics
from gridwright.operators.sequence import accepted_chain
from gridwright.operators.tokenize import FeatureTokenizer
from gridwright.plans.prepare import Prepared


def read_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "csv", max_files: int = 100, **options
) -> DataFrame:
    """File stream with an explicit schema; `max_files` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        options = {"header": True, **options}
    return reader.options(**options).format(fmt).load(path)


def prepare_stream(stream: DataFrame, prepared: Prepared | None, tokenizer: FeatureTokenizer | None = None) -> DataFrame:
    """Apply fitted preparation (and tokens). Both steps are row-wise; row-level de-duplication and
    outlier removal need the whole table and stay in batch."""
    if prepared is None:
        raise ValueError("fit the preparation in batch first; a stream cannot fit itself")
    out = prepared.apply_row_wise(stream)
    return tokenizer.transform(out) if tokenizer else out


def drop_repeats(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Streaming form of de-duplication: repeats within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop."""
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    q.awaitTermination()


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Exactly-once file sink."""
    q = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink; a batch that is run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path)


# ---------------------------------------------------------------- bad input


def quarantine_writer(good: str, bad: str, wanted: dict[str, str], corrupt: str = "_corrupt_record") -> Callable[[DataFrame, int], None]:
    """Split each micro-batch into castable rows and quarantined rows; nothing stops the stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        failed = F.col(corrupt).isNotNull() if corrupt in batch.columns else F.lit(False)
        for c, t in wanted.items():
            failed = failed | (F.col(c).isNotNull() & F.col(c).try_cast(t).isNull())
        rows = batch.withColumn("__bad", failed).persist()
        try:
            ok = rows.where(~F.col("__bad")).drop("__bad", corrupt)
            ok = ok.select(*[F.col(c).try_cast(wanted[c]).alias(c) if c in wanted else F.col(c) for c in ok.columns])
            ok.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            rows.where("__bad").drop("__bad").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        finally:
            rows.unpersist()

    return write


# ---------------------------------------------------------------- windows and state


def request_windows(requests: DataFrame, ts: str = "ts", size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Live request metrics per time window."""
    return requests.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w")).agg(*request_metrics()).select(
        F.col("w.start").alias("start"), *[F.col(n) for n in ("total", "succeeded", "failed", "success_rate", "error_rate", "mean_response_ms", "mean_inference_ms")]
    )


def rolling_metrics(stream: DataFrame, ts: str, key: str, value: str, size: str = "10 minutes", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sliding averages, maxima and minima per key."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("w"), key).agg(
        F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.count("*").alias("n")
    ).select(F.col("w.start").alias("start"), key, "avg", "max", "min", "n")


def latest_update(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last update per key of a table written in update mode."""
    cols = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("r")).select(*keys, "r.*")


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk and as change logs in the checkpoint; `early_stop_stream` needs it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class EarlyStop(StatefulProcessor):
    """State per run: evaluations, best value, its place, the place of the stop, late rows, time of the last row (microseconds).

    A run without rows for `idle_ms` of event time is closed: its state is given out once more and removed.
    """

    names = ("n", "best", "best_at", "stop_at", "late")

    def __init__(self, patience: int, min_delta: float, idle_ms: int):
        self.patience, self.min_delta, self.idle_ms = patience, min_delta, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "n long, best double, best_at long, stop_at long, late long, last long")

    def handleInputRows(self, key, rows, timerValues):
        n, best, at, stop, late, last = tuple(self.state.get()) if self.state.exists() else (0, float("inf"), 0, 0, 0, -(2**62))
        frame = pd.concat(list(rows))  # bounded by the micro-batch
        frame = frame.assign(t=frame["t"].astype("datetime64[us]").astype("int64")).sort_values("t", kind="stable")
        new = frame[frame["t"] >= last]
        late += len(frame) - len(new)
        if len(new):
            n, best, at, stop = self._fold(new["v"].to_numpy(float), n, best, at, stop)
            last = int(new["t"].iloc[-1])
        self.state.update((n, best, at, stop, late, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, (n, best, at, stop, late), 0)

    def _fold(self, v: np.ndarray, n: int, best: float, at: int, stop: int) -> tuple[int, float, int, int]:
        """The rule over the next values; only those below all before can be accepted."""
        if not stop:
            low = np.fmin.accumulate(np.concatenate([[best], v]))[:-1]
            found = np.flatnonzero(v < low)
            x, p = v[found], found + n + 1
            enter = int(np.searchsorted(-x, -(best - self.min_delta), side="right")) if n else 0
            if enter < len(x) and not (at and p[enter] - at > self.patience):
                to, stops = accepted_chain(x, p, self.patience, self.min_delta)
                best, at, stop = float(x[to[enter]]), int(p[to[enter]]), int(stops[enter])
            if not stop and n + len(v) - at >= self.patience:
                stop = at + self.patience
        return n + len(v), best, at, stop

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = tuple(self.state.get())
        self.state.clear()
        yield self._row(key, state[:-1], 1)

    def _row(self, key, state, closed: int) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], **{c: [x] for c, x in zip(self.names, state)}, "closed": [closed]})

    def close(self) -> None:
        pass


def early_stop_stream(
    stream: DataFrame, run: str, ts: str, value: str, patience: int, min_delta: float = 0.0, delay: str = "1 hour", idle: timedelta = timedelta(days=1)
) -> DataFrame:
    """Live early stopping: run, n, best, best_at, stop_at (0: not yet), late, closed after each micro-batch that has rows of the run.

    A micro-batch holds the next evaluations of a run in any order; they are sorted by `ts` inside it. A row older than the last
    one already folded is late: it is counted and changes nothing; Spark leaves out rows behind the watermark (`delay`) altogether.
    Run it inside `state_store`.
    """
    dtype = stream.schema[run].dataType.simpleString()
    rows = stream.select(F.col(run).alias("run"), F.col(ts).alias("t"), F.col(value).cast("double").alias("v")).withWatermark("t", delay)
    return rows.groupBy("run").transformWithStateInPandas(
        EarlyStop(patience, min_delta, int(idle.total_seconds() * 1000)), f"run {dtype}, n long, best double, best_at long, stop_at long, late long, closed int",
        "Update", "EventTime",
    )


# ---------------------------------------------------------------- scoring and drift


def scoring_writer(path: str, score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    write = batch_writer(path)
    return lambda batch, batch_id: write(score(batch), batch_id)


def reference_profile(df: DataFrame, value: Column, edges: Sequence[float]) -> list[float]:
    """Share per bin of the reference table (one number per bin)."""
    n = len(edges) - 1
    rows = df.where(value.isNotNull()).groupBy(bin_id(value, edges).alias("b")).count().collect()
    total = sum(r["count"] for r in rows) or 1
    shares = {r["b"]: r["count"] / total for r in rows}
    return [shares.get(i, 0.0) for i in range(n)]


def binned_drift(batch: DataFrame, value: Column, edges: Sequence[float], shares: Sequence[float]) -> DataFrame:
    """(n, score): largest gap between the running bin shares of a batch and of the reference."""
    n = len(edges) - 1
    cells = [F.count_if(bin_id(value, edges) == i).alias(f"b{i}") for i in range(n)]
    wide = batch.where(value.isNotNull()).agg(F.count("*").alias("n"), *cells)
    gaps, run, ref = [], F.lit(0), 0.0
    for i in range(n):
        run = run + F.col(f"b{i}")
        ref += shares[i]
        gaps.append(F.abs(ratio(run, F.col("n")) - F.lit(ref)))
    return wide.select("n", F.greatest(*gaps).alias("score"))


def drift_writer(path: str, value: Column, edges: Sequence[float], shares: Sequence[float], threshold: float = 0.1) -> Callable[[DataFrame, int], None]:
    write = batch_writer(path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        out = binned_drift(batch, value, edges, shares)
        write(out.withColumn("drifted", (F.col("score") > threshold).cast("int")), batch_id)

    return apply
