"""Ranks, prefix sums and row frames that survive a hot group.

A plain ``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task. Here a group is cut
into ordered segments, each segment is worked on by its own task, and the segments are stitched
with totals of one row per (group, segment).

* Hash order (splits, samples, shards): the segment is a prefix of the hash, no sorting pass.
* Value order (time, score): Spark's range partitioner cuts (group, order) and a reliable
  checkpoint fixes the cut. The order columns must identify a row, so that a run of equal values
  can be cut as well.

Frames measured against a limit (`max_group`) take the single-shuffle window when every group is
small, which one cheap count per group decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.hashing import key_hash
from gridwright.plans.storage import checkpointed

ROWS_PER_SEGMENT = 2_000_000
MAX_GROUP_ROWS = 2_000_000
SEG = "__seg"


def _attach(df: DataFrame, side: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys; no hint, so AQE broadcasts the side only when it is small."""
    right = side.select(*[F.col(k).alias(f"__j_{k}") for k in keys], *cols)
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(right[f"__j_{k}"])
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left").drop(*[f"__j_{k}" for k in keys])


def largest_group(df: DataFrame, group_cols: Sequence[str]) -> int:
    """Row count of the biggest group (partial counts first, so a hot key is no problem)."""
    if not group_cols:
        return df.count()
    row = df.groupBy(*group_cols).count().agg(F.max("count")).first()
    return row[0] or 0


def _before(order: str, keys: Sequence[str]):
    # One row per segment and group: the frame is bounded by the number of segments.
    return (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def hash_rank(
    df: DataFrame,
    key_cols: Sequence[str],
    seed: int = 42,
    group_cols: Sequence[str] = (),
    out: str = "rank",
    total: str | None = None,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """1-based rank in md5 order inside each group, and optionally the group's row count.

    Segments are hash prefixes, long enough that even a group holding all rows is cut into pieces
    of about `rows_per_segment`.
    """
    n = df.count()
    digits = max(1, min(12, math.ceil(math.log(max(n / rows_per_segment, 1.0001), 16))))
    groups = list(group_cols)
    work = df.withColumn("__h", key_hash(key_cols, "", seed)).withColumn(
        SEG, F.substring("__h", 1, digits)
    )
    counts = work.groupBy(*groups, SEG).agg(F.count("*").alias("__n"))
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__n").over(_before(SEG, groups)), F.lit(0))
    )
    cols = ["__off"]
    if total:
        offsets = offsets.withColumn(
            "__tot", F.sum("__n").over(Window.partitionBy(*(groups or [F.lit(0)])))
        )
        cols.append("__tot")
    joined = _attach(work, offsets, [*groups, SEG], cols)
    local = Window.partitionBy(*groups, SEG).orderBy("__h", *key_cols)
    ranked = joined.withColumn(out, F.col("__off") + F.row_number().over(local))
    if total:
        ranked = ranked.withColumn(total, F.col("__tot"))
    return ranked.drop("__h", SEG, "__off", "__tot")


def hash_parts(
    df: DataFrame,
    key_cols: Sequence[str],
    bounds: Callable[[Column], list[Column]],
    seed: int = 42,
    group_cols: Sequence[str] = (),
    out: str = "part",
    digits: int = 3,
) -> DataFrame:
    """Part number (0, 1, ...) of each row when its group, in hash order, is cut at the given ranks.

    `bounds(n)` gives the last rank of every part but the final one, from the group size. The rows
    are counted per hash prefix; a prefix that lies inside one part decides its rows at once, and
    only the few prefixes that a cut goes through are ranked. So the bulk is never shuffled.
    """
    groups = list(group_cols)
    pre = "__cut"

    def part(rank: Column, total: Column) -> Column:
        p = F.lit(0)
        for b in bounds(total):
            p = p + (rank > b).cast("int")
        return p

    work = df.withColumn(pre, F.substring(key_hash(key_cols, "", seed), 1, digits))
    counts = work.groupBy(*groups, pre).agg(F.count("*").alias("__n"))
    side = counts.withColumn("__cut_off", F.coalesce(F.sum("__n").over(_before(pre, groups)), F.lit(0)))
    side = side.withColumn("__cut_n", F.sum("__n").over(Window.partitionBy(*(groups or [F.lit(0)]))))
    side = side.withColumn("__cut_a", part(F.col("__cut_off") + 1, F.col("__cut_n"))).withColumn(
        "__cut_b", part(F.col("__cut_off") + F.col("__n"), F.col("__cut_n"))
    )
    joined = _attach(work, side, [*groups, pre], ["__cut_off", "__cut_n", "__cut_a", "__cut_b"])
    sure = joined.where(F.col("__cut_a") == F.col("__cut_b")).select(*df.columns, F.col("__cut_a").alias(out))
    edge = hash_rank(joined.where(F.col("__cut_a") != F.col("__cut_b")), key_cols, seed, [*groups, pre], "__k")
    edge = edge.select(*df.columns, part(F.col("__cut_off") + F.col("__k"), F.col("__cut_n")).alias(out))
    return sure.unionByName(edge)


def segmented(
    df: DataFrame, group_cols: Sequence[str], order: Sequence[Column | str], segments: int | None = None
) -> DataFrame:
    """Cut (group, order) into range segments of similar size; the cut is fixed by a checkpoint.

    Without a number, AQE merges neighbouring ranges of a small input, which keeps their order.
    """
    cols = [F.col(g) for g in group_cols] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(segments, *cols) if segments else df.repartitionByRange(*cols)
    return checkpointed(ranged.withColumn(SEG, F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column],
    inclusive: bool = True,
    totals: dict[str, str] | None = None,
    segments: int | None = None,
    how: str = "sum",
) -> DataFrame:
    """Running sums (or minima, maxima, exclusive-ors: `how`) in the given order without a one-task window.

    `sums` maps an output column to the expression to accumulate; `totals` optionally maps it to
    an output column with its group total. An exclusive minimum has no value on a group's first row.
    """
    groups = list(group_cols)
    totals = totals or {}
    agg = {"sum": F.sum, "min": F.min, "max": F.max, "xor": F.bit_xor}[how]
    zero = (lambda c: F.coalesce(c, F.lit(0))) if how in ("sum", "xor") else (lambda c: c)
    merge = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest, "xor": lambda a, b: a.bitwiseXOR(b)}[how]
    work = df
    for name, expr in sums.items():
        work = work.withColumn(f"__v_{name}", expr)
    seg = segmented(work, groups, order, segments)
    per = seg.groupBy(*groups, SEG).agg(*[agg(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    side = per
    for n in sums:
        side = side.withColumn(f"__o_{n}", zero(agg(f"__t_{n}").over(_before(SEG, groups))))
    carried = [f"__o_{n}" for n in sums]
    everything = Window.partitionBy(*(groups or [F.lit(0)]))
    for n, alias in totals.items():
        side = side.withColumn(alias, agg(f"__t_{n}").over(everything))
        carried.append(alias)
    joined = _attach(seg, side, [*groups, SEG], carried)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    end = Window.currentRow if inclusive else -1
    local = (
        Window.partitionBy(*groups, SEG)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    out = joined
    for n in sums:
        out = out.withColumn(n, merge(F.col(f"__o_{n}"), zero(agg(f"__v_{n}").over(local))))
    return out.drop(SEG, *[f"__v_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def order_position(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column | str],
    out: str = "pos",
    total: str | None = None,
    max_group: int = MAX_GROUP_ROWS,
    segments: int | None = None,
) -> DataFrame:
    """1-based position in each group; a window when groups are small, segments otherwise."""
    if group_cols and largest_group(df, group_cols) <= max_group:
        w = Window.partitionBy(*group_cols)
        res = df.withColumn(out, F.row_number().over(w.orderBy(*order)).cast("long"))
        return res.withColumn(total, F.count(F.lit(1)).over(w)) if total else res
    return prefix_sums(df, group_cols, order, {out: F.lit(1)}, totals={out: total} if total else None, segments=segments)


def row_frames(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    max_group: int = MAX_GROUP_ROWS,
    chunk_rows: int = 100_000,
    segments: int | None = None,
) -> DataFrame:
    """Apply a row-frame computation that looks at most `before` rows back and `after` ahead.

    `compute(df, partition_cols)` adds window columns using the partition columns it is given. A
    column ``__pos`` (1-based place in the group) is available. When some group exceeds
    `max_group`, groups are cut into chunks of consecutive rows and each chunk gets copies of the
    rows its frames reach into (the halo), which are dropped again afterwards.
    """
    groups = list(group_cols)
    if groups and largest_group(df, groups) <= max_group:
        w = Window.partitionBy(*groups).orderBy(*order)
        work = df.withColumn("__pos", F.row_number().over(w).cast("long"))
        return compute(work, groups).drop("__pos")
    size = max(chunk_rows, before + after + 1)
    work = prefix_sums(df, groups, order, {"__pos": F.lit(1)}, segments=segments)
    home = F.floor((F.col("__pos") - 1) / size)
    last = F.floor((F.col("__pos") - 1 + before) / size)
    first = F.floor(F.greatest(F.col("__pos") - 1 - after, F.lit(0)) / size)
    work = work.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(first, last)))
    res = compute(work, [*groups, "__chunk"])
    return res.where(F.col("__home") == F.col("__chunk")).drop("__pos", "__home", "__chunk")


def carry_last(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    backward: bool = False,
    max_group: int = MAX_GROUP_ROWS,
    segments: int | None = None,
) -> DataFrame:
    """Last non-null value at or before each row (or the next one at or after, `backward`)."""
    groups = list(group_cols)
    cols = [F.col(o) for o in order]
    keys = [c.desc() for c in cols] if backward else [c.asc() for c in cols]
    work = df
    for n, e in values.items():
        work = work.withColumn(f"__c_{n}", e)
    if groups and largest_group(df, groups) <= max_group:
        w = Window.partitionBy(*groups).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        for n in values:
            work = work.withColumn(n, F.last(f"__c_{n}", ignorenulls=True).over(w))
        return work.drop(*[f"__c_{n}" for n in values])
    seg = segmented(work, groups, order, segments)
    place = F.struct(*order)
    best = F.min_by if backward else F.max_by
    per = seg.groupBy(*groups, SEG).agg(
        *[
            best(F.col(f"__c_{n}"), F.when(F.col(f"__c_{n}").isNotNull(), place)).alias(f"__t_{n}")
            for n in values
        ]
    )
    seg_order = F.col(SEG).desc() if backward else F.col(SEG).asc()
    prev = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy(seg_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    side = per
    for n in values:
        side = side.withColumn(f"__o_{n}", F.last(f"__t_{n}", ignorenulls=True).over(prev))
    joined = _attach(seg, side, [*groups, SEG], [f"__o_{n}" for n in values])
    local = Window.partitionBy(*groups, SEG).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    for n in values:
        joined = joined.withColumn(
            n, F.coalesce(F.last(f"__c_{n}", ignorenulls=True).over(local), F.col(f"__o_{n}"))
        )
    drop = [f"__c_{n}" for n in values] + [f"__o_{n}" for n in values]
    return joined.drop(SEG, *drop)
