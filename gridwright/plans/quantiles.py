"""Exact quantiles (linear interpolation) in two scans of the table, for any number of columns and probabilities.

The first scan keeps a mergeable KLL sketch per column, from which every wanted rank gets a bracket of values. The second counts
the rows between the brackets and keeps, by distinct value, those inside: a few hundredths of the table. A rank is then looked up
in its bracket; brackets with many values are cut further by sketches of their own values first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.bisect import edges_passed, passed_in
from gridwright.functions.columns import as_number, number_array
from gridwright.plans.ordered import prefix_sums
from gridwright.plans.storage import written

MAX_DISTINCT = 1_000_000
#: Share of the rows that all brackets of a column may hold, and numbers the sketches of all columns hold in a task.
INSIDE, SKETCH_NUMBERS = 0.05, 1 << 22
#: Values the driver looks through at most, and pieces that a larger bracket is cut into.
COLLECTED, CUTS = 500_000, 512


def grouped_quantiles(counts: DataFrame, group_cols: Sequence[str], value: str, n: str, probs: Sequence[float]) -> DataFrame:
    """(groups, p, q) from a table of distinct values with counts: prefix-sum the counts and read
    off the two neighbours of each rank."""
    groups = list(group_cols)
    cum = prefix_sums(counts, groups, [value], {"__hi": F.col(n)}, totals={"__hi": "__tot"})
    wanted = cum.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probs))])))
    wanted = wanted.withColumn("__h", F.col("p") * (F.col("__tot") - 1))
    lo = F.floor("__h")
    covers = lambda r: (F.col("__hi") > r) & (F.col("__hi") - F.col(n) <= r)
    picked = wanted.groupBy(*groups, "p").agg(
        F.max(F.when(covers(lo), F.col(value))).alias("a"),
        F.max(F.when(covers(F.ceil("__h")), F.col(value))).alias("b"),
        F.first(F.col("__h") - lo).alias("w"),
    )
    return picked.select(*groups, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("q"))


def _sketch_size(n_probs: int, n_cols: int) -> tuple[int, float]:
    """k of the sketches and the error of a rank, as a share of the rows, that they exceed once in a hundred times."""
    wanted = INSIDE / (4 * n_probs)
    k = int(min((2.296 / wanted) ** (1 / 0.9021), 65535, max(200, SKETCH_NUMBERS // (3 * n_cols))))
    return max(k, 200), 2.296 / max(k, 200) ** 0.9021


def _brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], wide: float) -> dict[str, tuple[int, list[tuple[float, float]]]]:
    """Column -> rows with a value, disjoint closed intervals of values that hold the wanted ranks, most likely. One scan."""
    k, error = _sketch_size(len(probs), len(cols))
    numbers = df.select(*[as_number(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    aggs = []
    for i in range(len(cols)):
        x = F.col(f"x{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.kll_sketch_agg_double(x, k).alias(f"s{i}")]
    slack = 1.5 * wide * error
    ranks = number_array([min(max(p + sign * slack, 0.0), 1.0) for p in probs for sign in (-1, 1)])
    ends = [F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), ranks)).alias(f"q{i}") for i in range(len(cols))]
    row = numbers.agg(*aggs).select(*[f"{v}{i}" for i in range(len(cols)) for v in "nab"], *ends).first()
    out = {}
    for i, c in enumerate(cols):
        n, spans = row[f"n{i}"], []
        if n and 4 / n > slack:  # few rows: all of them
            spans = [(row[f"a{i}"], row[f"b{i}"])]
        elif n:
            for j, p in enumerate(probs):
                spans.append((row[f"a{i}"] if p <= slack else row[f"q{i}"][2 * j], row[f"b{i}"] if p >= 1 - slack else row[f"q{i}"][2 * j + 1]))
        merged: list[tuple[float, float]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        out[c] = (n, merged)
    return out


def _held(df: DataFrame, brackets: dict[str, tuple[int, list[tuple[float, float]]]]) -> DataFrame:
    """(c, cell, v, n): row counts of column number c. Cell 2 i + 1 is bracket i, by value; cell 2 i lies below it, without values."""
    # Places are columns of their own: computed once a row, although the cells use them several times.
    numbers = df.select(*[as_number(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(brackets)])
    places = [edges_passed(F.col(f"x{i}"), [lo for lo, _ in spans]).alias(f"at{i}") for i, (_, spans) in enumerate(brackets.values())]
    cells = []
    for i, (n, spans) in enumerate(brackets.values()):
        if n:
            x, at = F.col(f"x{i}"), F.col(f"at{i}")
            inside = x <= F.get(number_array([hi for _, hi in spans]), at - 1)
            cell = F.when(F.coalesce(inside, F.lit(False)), 2 * at - 1).otherwise(2 * at)
            cells.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("c"), cell.alias("cell"), x.alias("x"))))
    rows = numbers.select("*", *places).select(F.explode(F.array(*cells)).alias("e")).where("e is not null").select("e.c", "e.cell", F.when(F.col("e.cell") % 2 == 1, F.col("e.x")).alias("v"))
    return written(rows.groupBy("c", "cell", "v").agg(F.count("*").alias("n")), "brackets")


def _picked(held: DataFrame, wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int, int], float]:
    """(c, cell, rank in the cell) -> value. Cells that hold too many values together are cut first."""
    spark, offsets = held.sparkSession, {key: 0 for key in wanted}
    names = {key: key for key in wanted}  # present (c, cell) -> the one asked for
    ranks = {key: sorted(set(r)) for key, r in wanted.items()}
    while True:
        held = held.join(F.broadcast(spark.createDataFrame(list(ranks), "c int, cell int")), ["c", "cell"])  # two cells a probability and column
        if held.count() <= COLLECTED:
            break
        points = number_array([(i + 1) / CUTS for i in range(CUTS - 1)])
        cuts = held.groupBy("c", "cell").agg(F.kll_sketch_agg_double("v", 4096).alias("s")).select("c", "cell", F.array_sort(F.kll_sketch_get_quantile_double("s", points)).alias("cuts"))
        held = written(held.join(F.broadcast(cuts), ["c", "cell"]).select("c", F.col("cell").alias("was"), passed_in(F.col("v"), F.col("cuts"), CUTS).alias("sub"), "v", "n"), "cuts")
        sizes = held.groupBy("c", "was", "sub").agg(F.sum("n").alias("n")).orderBy("c", "was", "sub").collect()  # CUTS a cell
        below: dict[tuple[int, int], int] = {}
        more: dict[tuple[int, int], list[int]] = {}
        moved, starts = {}, {}
        for r in sizes:
            key = (r["c"], r["was"])
            lo = below.get(key, 0)
            below[key] = lo + r["n"]
            here = [x for x in ranks[key] if lo <= x < lo + r["n"]]
            if here:
                new = (r["c"], r["was"] * CUTS + r["sub"])
                more[new], moved[new], starts[new] = [x - lo for x in here], names[key], offsets[key] + lo
        ranks, names, offsets = more, moved, starts
        held = held.select("c", (F.col("was") * CUTS + F.col("sub")).cast("int").alias("cell"), "v", "n")
    out, below = {}, {}
    for r in held.orderBy("c", "cell", "v").collect():
        key = (r["c"], r["cell"])
        lo = below.get(key, 0)
        below[key] = lo + r["n"]
        for x in ranks[key]:
            if lo <= x < lo + r["n"]:
                out[(*names[key], offsets[key] + x)] = r["v"]
    return out


def bracketed_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], wide: float = 1.5) -> dict[str, list[float]]:
    """Exact quantiles: two scans; a rank outside its bracket, which is rare, has its column done again with wider ones."""
    found = _brackets(df, cols, probs, wide)
    out: dict[str, list[float]] = {c: [None] * len(probs) for c in cols}
    live = [c for c in cols if found[c][0]]
    if not live:
        return out
    held = _held(df, {c: found[c] for c in live})
    places = {c: [p * (found[c][0] - 1) for p in probs] for c in live}
    sizes = held.groupBy("c", "cell").agg(F.sum("n").alias("n")).orderBy("c", "cell").collect()
    wanted: dict[tuple[int, int], list[int]] = {}
    where: dict[tuple[str, int], tuple[int, int, int]] = {}
    missed = set()
    for i, c in enumerate(live):
        spans, at = [], 0
        for r in sizes:
            if r["c"] == i:
                spans.append((at, at + r["n"], r["cell"]))
                at += r["n"]
        for rank in {r for h in places[c] for r in (math.floor(h), math.ceil(h))}:
            lo, _, cell = next(s for s in spans if s[0] <= rank < s[1])
            if cell % 2 == 0:
                missed.add(c)
            else:
                wanted.setdefault((i, cell), []).append(rank - lo)
                where[c, rank] = (i, cell, rank - lo)
    values = _picked(held, wanted) if wanted else {}
    for c in live:
        if c not in missed:
            for j, h in enumerate(places[c]):
                a, b = values[where[c, math.floor(h)]], values[where[c, math.ceil(h)]]
                out[c][j] = a + (b - a) * (h - math.floor(h))
    return out | (bracketed_quantiles(df, sorted(missed), probs, 4 * wide) if missed else {})


def fit_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], approx: bool = False) -> dict[str, list[float]]:
    """Quantiles per column on the driver (columns x probabilities numbers)."""
    cols = list(cols)
    if not cols:
        return {}
    if approx:
        row = df.agg(
            *[F.percentile_approx(as_number(df, c), list(probs), 100_000).alias(c) for c in cols]
        ).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    return bracketed_quantiles(df, cols, probs)


def fit_median(df: DataFrame, cols: Sequence[str], **kw) -> dict[str, float]:
    return {c: q[0] for c, q in fit_quantiles(df, cols, [0.5], **kw).items()}
