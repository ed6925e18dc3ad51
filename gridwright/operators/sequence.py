"""Time-ordered sequences, moving statistics and metric histories."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import is_numeric, is_temporal
from gridwright.plans.ordered import MAX_GROUP_ROWS, carry_last, order_position, prefix_sums, row_frames
from gridwright.plans.storage import written

# Words that make a column name a time column, and the smallest epoch-like number.
TIME_WORDS = (
    "time", "date", "timestamp", "created", "updated", "modified", "occurred", "recorded",
    "logged", "when", "year", "month", "day", "hour", "minute", "second",
)
EPOCH_MIN = 1_000_000_000


def sequences(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_cols: Sequence[str],
    target: str, length: int, horizon: int = 1, max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Every run of `length` rows per group with the target `horizon` rows after its last row."""

    def compute(work: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order_cols)
        span = w.rowsBetween(-(length - 1), 0)
        return (
            work.withColumn("sequence", F.collect_list(F.struct(*value_cols)).over(span))
            .withColumn("target", F.lead(F.struct(F.col(target).alias("v")), horizon).over(w))
            .withColumn("seq_pos", F.col("__pos"))
        )

    out = row_frames(df, group_cols, order_cols, length - 1, horizon, compute, max_group)
    return out.where((F.col("seq_pos") >= length) & F.col("target").isNotNull()).select(
        *group_cols, *order_cols, (F.col("seq_pos") - length).alias("start"), "sequence",
        F.col("target")["v"].alias("target"),
    )


def next_row_windows(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_cols: Sequence[str],
    max_length: int, min_length: int = 2, max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Windows starting at every row, up to `max_length` long and at least `min_length`: all rows but
    the last are the input (left-padded to max_length - 1), the last row is the target."""

    def compute(work: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order_cols).rowsBetween(0, max_length - 1)
        return work.withColumn("__rows", F.collect_list(F.struct(*value_cols)).over(w)).withColumn(
            "start", F.col("__pos") - 1
        )

    out = row_frames(df, group_cols, order_cols, 0, max_length - 1, compute, max_group)
    out = out.where(F.size("__rows") >= min_length)
    n = F.size("__rows") - 1
    pad = F.lit(max_length - 1) - n
    blank = F.lit(None).cast(out.schema["__rows"].dataType.elementType)
    return out.select(
        *group_cols, "start",
        F.concat(F.array_repeat(blank, pad), F.slice("__rows", F.lit(1), n)).alias("input"),
        F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), n)).alias("mask"),
        F.concat(F.array_repeat(F.lit(0), pad), F.sequence(F.lit(0), n - 1)).alias("positions"),
        F.element_at("__rows", -1).alias("target"),
    )


def detect_time_column(df: DataFrame) -> str | None:
    """First column, in schema order, that is named like a time, is a time, or looks like an epoch."""
    nums = [
        f.name for f in df.schema
        if is_numeric(f.dataType) and not any(w in f.name.lower() for w in TIME_WORDS)
    ]
    low = df.agg(*[F.min(c).alias(c) for c in nums]).first() if nums else {}
    for f in df.schema:
        if any(w in f.name.lower() for w in TIME_WORDS) or is_temporal(f.dataType):
            return f.name
        if f.name in nums and low[f.name] is not None and low[f.name] > EPOCH_MIN:
            return f.name
    return None


def ordering_columns(
    df: DataFrame, strategy: str, index_cols: Sequence[str], timestamp: str | None = None
) -> list[str]:
    """Order columns of a strategy: row_index, timestamp or auto. The index columns break ties (a
    DataFrame has no row position, so they must be named); custom keeps the index order."""
    if strategy == "timestamp":
        if timestamp is None:
            raise ValueError("the timestamp strategy needs a column")
        return [timestamp, *index_cols]
    if strategy == "auto":
        found = detect_time_column(df)
        return [found, *index_cols] if found else list(index_cols)
    return list(index_cols)


def with_sequence_position(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    return order_position(df, group_cols, order_cols, out="seq_pos")


def sorted_groups(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    return df.orderBy(*group_cols, *order_cols)


def naive_next_row(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Previous row as prediction of the next: adds {col}_pred."""

    def compute(work: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order_cols)
        return work.select("*", *[F.lag(c).over(w).alias(f"{c}_pred") for c in cols])

    return row_frames(df, group_cols, order_cols, 1, 0, compute)


def with_next(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Adds {col}_next from the following row of the group."""

    def compute(work: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order_cols)
        return work.select("*", *[F.lead(c).over(w).alias(f"{c}_next") for c in cols])

    return row_frames(df, group_cols, order_cols, 0, 1, compute)


def next_row_errors(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(column, metric, value) over rows with a prediction, and averages over columns."""
    aggs = []
    for c in categorical:
        hit = (F.col(c) == F.col(f"{c}_pred")).cast("double")
        aggs.append(F.avg(hit).alias(f"{c}:accuracy"))
    for c in numeric:
        e = F.col(c).cast("double") - F.col(f"{c}_pred")
        aggs += [F.avg(e * e).alias(f"{c}:mse"), F.avg(F.abs(e)).alias(f"{c}:mae"),
                 F.sqrt(F.avg(e * e)).alias(f"{c}:rmse")]
    wide = df.agg(*aggs)
    cells = [
        F.struct(F.lit(n.split(":")[0]).alias("column"), F.lit(n.split(":")[1]).alias("metric"),
                 F.col(f"`{n}`").alias("value"))
        for n in wide.columns
    ]
    rows = wide.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    mean = rows.groupBy("metric").agg(F.avg("value").alias("value")).select(
        F.lit("average").alias("column"), "metric", "value"
    )
    return rows.unionByName(mean)


def moving_statistics(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value: str, size: int,
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """avg, max and min over the last `size` records."""

    def compute(work: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order_cols).rowsBetween(-(size - 1), 0)
        return work.select(
            "*", F.avg(value).over(w).alias(f"{value}_avg"), F.max(value).over(w).alias(f"{value}_max"),
            F.min(value).over(w).alias(f"{value}_min"),
        )

    return row_frames(df, group_cols, order_cols, size - 1, 0, compute, max_group)


def metric_summary(log: DataFrame, run: str, metric: str, step: str, value: str, lower_is_better: bool = True) -> DataFrame:
    """Latest and best value (with its step) per run and metric; one aggregate, no window."""
    best = F.col(value) if lower_is_better else -F.col(value)
    rank = F.struct(best, F.col(step))
    return log.groupBy(run, metric).agg(
        F.max_by(value, step).alias("latest"), F.min_by(value, rank).alias("best"),
        F.min_by(step, rank).alias("best_step"),
    )


def metric_table(log: DataFrame, keys: Sequence[str], metric: str, value: str, metrics: Sequence[str]) -> DataFrame:
    """Wide table, one column per metric."""
    return log.groupBy(*keys).pivot(metric, list(metrics)).agg(F.first(value))


#: Evaluations of a run that one task looks at together.
STOP_SEGMENT = 1_000_000


def accepted_chain(x: np.ndarray, p: np.ndarray, patience: int, min_delta: float) -> tuple[np.ndarray, np.ndarray]:
    """For falling values ``x`` at places ``p``: from each of them, taken as the best so far, the last value that is accepted in turn,
    and the place of the stop on the way there (0: none). A value is accepted if it is below the best less ``min_delta``."""
    after = np.searchsorted(-x, -(x - min_delta), side="right")
    inside = after < len(x)
    ahead = np.where(inside, after, np.arange(len(x)))
    stops = np.where(inside & (p[ahead] - p > patience), p + patience, 0)
    to = np.where(stops > 0, np.arange(len(x)), ahead)
    while True:
        further = to[to]
        if (further == to).all():
            return to, stops[to]
        to = further


def _segment_chains(patience: int, min_delta: float, size: int):
    """Rows in order of run, segment and place; a task holds one segment and a batch at a time."""
    names = ["run", "seg", "n", "p", "x", "t_p", "t_x", "stop"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, p = pdf["x"].to_numpy(float), pdf["p"].to_numpy(np.int64)
        to, stops = accepted_chain(x, p, patience, min_delta)
        out = pdf.assign(t_p=p[to], t_x=x[to], stop=stops)
        return out if out["n"].iloc[0] > size else out.head(1)  # of a run in one segment only its first value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            before = pdf[["run", "seg"]].shift()
            same = ((pdf["run"] == before["run"]) | (pdf["run"].isna() & before["run"].isna())) & (pdf["seg"] == before["seg"])
            starts = np.flatnonzero(~same.to_numpy(bool) | (np.arange(len(pdf)) == 0))
            done = [one(pdf.iloc[i:j]) for i, j in zip(starts, starts[1:], strict=False)]
            if done:
                yield pd.concat(done)[names]
            held = pdf.iloc[starts[-1] :].reset_index(drop=True) if len(starts) else None
        if held is not None and len(held):
            yield one(held)[names]

    return run


def _linked(chains: DataFrame, patience: int, min_delta: float, max_group: int) -> DataFrame:
    """(run, t_p, t_x, to_p, to_x, stop): from where a segment's chain ends to where it ends in the segment that takes it up; itself
    if none does or training stops before. What takes it up is the next value in falling order after its own less ``min_delta``."""
    value = F.struct(F.col("p"), F.col("t_p").alias("to_p"), F.col("t_x").alias("to_x"), "stop")
    ends = chains.where("stop = 0").select("run", "t_p", "t_x").distinct()
    values = chains.select("run", (-F.col("x")).alias("o"), F.lit(0).alias("asks"), F.col("p").alias("k"), value.alias("v"), F.lit(None).cast("long").alias("t_p"), F.lit(None).cast("double").alias("t_x"))
    asks = ends.select("run", (-(F.col("t_x") - F.lit(float(min_delta)))).alias("o"), F.lit(1).alias("asks"), F.col("t_p").alias("k"), F.lit(None).cast(values.schema["v"].dataType).alias("v"), "t_p", "t_x")
    met = carry_last(values.unionAll(asks), ["run"], ["o", "asks", "k"], {"ahead": F.col("v")}, backward=True, max_group=max_group).where("asks = 1")
    a = F.col("ahead")
    late = a.isNotNull() & (a["p"] - F.col("t_p") > patience)
    go = a.isNotNull() & ~late
    return met.select(
        "run", "t_p", "t_x", F.when(go, a["to_p"]).otherwise(F.col("t_p")).alias("to_p"), F.when(go, a["to_x"]).otherwise(F.col("t_x")).alias("to_x"),
        F.when(late, F.col("t_p") + patience).when(go, a["stop"]).otherwise(0).cast("long").alias("stop"),
    )


def early_stops(
    log: DataFrame, run: str, order_cols: Sequence[str], value: str, patience: int, min_delta: float = 0.0,
    lower_is_better: bool = True, max_group: int = MAX_GROUP_ROWS, segment: int = STOP_SEGMENT,
) -> DataFrame:
    """Per run the 1-based evaluation at which training stops (null: never), and the best one then.

    Only a new running minimum can be an accepted improvement, so the history is first reduced to those rows by a prefix
    minimum. A run is then cut in segments. A segment's rule is a function of the best value it is entered with, known from
    where the chains of accepted values that begin at each of its own values end; the ends are linked across segments and the
    links composed by doubling, so a run of any length takes a logarithmic number of joins. Missing values are no evaluations
    that improve; a run without any value is left out.
    """
    v = F.col(value).cast("double")
    signed = v if lower_is_better else -v
    placed = order_position(log.withColumn("__x", signed), [run], order_cols, "__p", "__n", max_group)
    scanned = prefix_sums(placed, [run], ["__p"], {"__low": F.col("__x")}, inclusive=False, how="min")
    records = scanned.where(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.col("__low").isNull() | (F.col("__x") < F.col("__low"))))
    records = records.select(F.col(run).alias("run"), F.floor((F.col("__p") - 1) / segment).alias("seg"), F.col("__p").cast("long").alias("p"), F.col("__x").alias("x"), F.col("__n").cast("long").alias("n"))
    dtype = log.schema[run].dataType.simpleString()
    chains = records.repartition("run", "seg").sortWithinPartitions("run", "seg", "p").mapInPandas(
        _segment_chains(patience, min_delta, segment), f"run {dtype}, seg long, n long, p long, x double, t_p long, t_x double, stop long"
    )
    chains = written(chains, "chains")
    first = chains.groupBy("run").agg(F.max("n").alias("n"), F.min_by(F.struct("t_p", "t_x", "stop"), "p").alias("t")).select("run", "n", "t.*")
    longest = chains.agg(F.max("n")).first()[0] or 0
    if longest > segment:
        links = written(_linked(chains.where(F.col("n") > segment), patience, min_delta, max_group), "links")
        for _ in range(math.ceil(math.log2(longest / segment + 1)) + 1):
            ahead = links.select(F.col("run"), F.col("t_p").alias("to_p"), F.col("to_p").alias("far_p"), F.col("to_x").alias("far_x"), F.col("stop").alias("far_stop"))
            met = links.join(ahead, ["run", "to_p"], "left")
            go = (F.col("stop") == 0) & F.col("far_p").isNotNull()
            links = written(met.select(
                "run", "t_p", "t_x", F.when(go, F.col("far_p")).otherwise(F.col("to_p")).alias("to_p"), F.when(go, F.col("far_x")).otherwise(F.col("to_x")).alias("to_x"),
                F.when(go, F.col("far_stop")).otherwise(F.col("stop")).alias("stop"),
            ), "links")
        reached = first.join(links.select("run", "t_p", "to_p", "to_x", F.col("stop").alias("far_stop")), ["run", "t_p"], "left")
        go = (F.col("stop") == 0) & F.col("to_p").isNotNull()
        first = reached.select(
            "run", "n", F.when(go, F.col("to_p")).otherwise(F.col("t_p")).alias("t_p"), F.when(go, F.col("to_x")).otherwise(F.col("t_x")).alias("t_x"),
            F.when(go, F.col("far_stop")).otherwise(F.col("stop")).alias("stop"),
        )
    end = F.when(F.col("stop") > 0, F.col("stop")).when(F.col("t_p") + patience <= F.col("n"), F.col("t_p") + patience)
    return first.select(
        F.col("run").alias(run), end.cast("long").alias("stop_at"), F.col("t_p").alias("best_at"), (F.col("t_x") * F.lit(1.0 if lower_is_better else -1.0)).alias("best")
    )
