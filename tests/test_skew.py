"""The segmented plans give the window plans' answer, with a group holding most rows, and the
result does not depend on the partitioning."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridwright.operators import classification, drift, impute, outlier, sequence, split, survival
from gridwright.plans import ordered, quantiles


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows; group 0 holds two thirds, with gaps and repeated times."""
    i = F.col("id")
    return spark.range(3000).select(
        i.alias("k"), F.when(i % 3 != 0, 0).otherwise(i % 17).alias("g"), F.floor(i * 7919 % 1000 / 2).alias("t"),
        F.when(i % 4 != 0, (i * 31 % 101).cast("double")).alias("v"),
    ).cache()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_sums(hot, parts):
    got = ordered.prefix_sums(hot.repartition(parts), ["g"], ["t", "k"], {"s": F.col("k")}, totals={"s": "tot"}, segments=6)
    w = Window.partitionBy("g").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumn("s", F.sum("k").over(w)).withColumn("tot", F.sum("k").over(Window.partitionBy("g")))
    assert rows(got, "k", "s", "tot") == rows(want, "k", "s", "tot")


def test_prefix_sums_exclusive_and_minimum(hot):
    w = Window.partitionBy("g").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, -1)
    got = ordered.prefix_sums(hot, ["g"], ["t", "k"], {"s": F.lit(1)}, inclusive=False, segments=5)
    assert rows(got, "k", "s") == rows(hot.withColumn("s", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0))), "k", "s")
    got = ordered.prefix_sums(hot, ["g"], ["t", "k"], {"m": F.col("v")}, inclusive=False, how="min", segments=5)
    assert rows(got, "k", "m") == rows(hot.withColumn("m", F.min("v").over(w)), "k", "m")


@pytest.mark.parametrize("rows_per_segment", [10, 500, 10**9])
def test_hash_rank(hot, rows_per_segment):
    got = ordered.hash_rank(hot, ["k"], 1, ["g"], total="n", rows_per_segment=rows_per_segment)
    h = ordered.key_hash(["k"], "", 1)
    want = hot.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(h, "k"))).withColumn(
        "n", F.count("*").over(Window.partitionBy("g"))
    )
    assert rows(got, "k", "rank", "n") == rows(want, "k", "rank", "n")


@pytest.mark.parametrize("backward", [False, True])
def test_fill(hot, backward):
    small = impute.directional_fill(hot, ["v"], ["g"], ["t", "k"], backward)
    big = impute.directional_fill(hot, ["v"], ["g"], ["t", "k"], backward, max_group=10)
    assert rows(small, "k", "v") == rows(big, "k", "v")


def test_interpolate(hot):
    small = impute.interpolate(hot, ["v"], ["g"], ["t", "k"])
    big = impute.interpolate(hot, ["v"], ["g"], ["t", "k"], max_group=10)
    assert rows(small, "k", "v") == rows(big, "k", "v")


def test_frames(hot, monkeypatch):
    small = sequence.sequences(hot, ["g"], ["t", "k"], ["k"], "k", 4, 2)
    again = sequence.moving_statistics(hot, ["g"], ["t", "k"], "v", 7)
    monkeypatch.setattr(ordered.row_frames, "__defaults__", (10, 50, 5))
    big = sequence.sequences(hot, ["g"], ["t", "k"], ["k"], "k", 4, 2, max_group=10)
    moved = sequence.moving_statistics(hot, ["g"], ["t", "k"], "v", 7, max_group=10)
    assert rows(small, "g", "k", "start", "sequence", "target") == rows(big, "g", "k", "start", "sequence", "target")
    assert rows(again, "k", "v_max", "v_min") == rows(moved, "k", "v_max", "v_min")


def test_early_stops(hot):
    log = hot.where("v is not null")
    small = sequence.early_stops(log, "g", ["t", "k"], "v", 5, 2.0)
    big = sequence.early_stops(log, "g", ["t", "k"], "v", 5, 2.0, max_group=10)
    assert rows(small, "g", "stop_at", "best_at", "best") == rows(big, "g", "stop_at", "best_at", "best")


def fold(values, patience, delta):
    """The rule, one evaluation after another."""
    best = at = stop = None
    for p, x in enumerate(values, 1):
        if stop is None:
            if best is None or x < best - delta:
                best, at = x, p
            elif p - at >= patience:
                stop = p
    return stop, at, best


def test_early_stops_of_a_long_run(spark):
    """One run with two thirds of the rows, falling slowly so that most values are new minima, in segments of few places."""
    import random

    r = random.Random(3)
    runs = {0: [], 1: [5.0], 2: [3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0]}
    for i in range(2000):
        runs[0].append(1000 - 0.2 * i + r.uniform(-0.3, 0.3))
    for k in range(3, 40):
        level = 100.0
        runs[k] = [level := level - r.choice([0.0, 0.1, 0.5, 2.0]) + r.choice([0.0, 0.3]) for _ in range(r.randint(1, 60))]
    rows_ = [(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)]
    r.shuffle(rows_)
    log = spark.createDataFrame(rows_, "g long, t long, v double")
    for patience, delta in ((4, 0.0), (5, 1.0), (40, 7.5), (3000, 2.0)):
        want = {k: fold(xs, patience, delta) for k, xs in runs.items()}
        for segment in (sequence.STOP_SEGMENT, 37, 5):
            got = sequence.early_stops(log, "g", ["t"], "v", patience, delta, max_group=50, segment=segment)
            assert {x["g"]: (x["stop_at"], x["best_at"], x["best"]) for x in got.collect()} == want
    chain = sequence.early_stops(log, "g", ["t"], "v", 5, 1.0, max_group=50, segment=37)
    assert chain.count() == len(runs)


def test_quantiles_from_brackets(hot, monkeypatch):
    """The driver may look at few values: brackets are cut by their own sketches first."""
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    plain = hot.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(c) for c in ("v", "t")]).first()
    for collected in (quantiles.COLLECTED, 40):
        monkeypatch.setattr(quantiles, "COLLECTED", collected)
        found = quantiles.fit_quantiles(hot, ["v", "t"], probs)
        for c in ("v", "t"):
            assert found[c] == pytest.approx(plain[c], rel=1e-12)


def test_quantiles_of_ten_million_values(spark):
    """Two scans; the brackets hold a few hundredths of the values."""
    n, probs = 10_000_000, [i / 100 for i in range(101)]
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7_368_787 % n).cast("double").alias("x"))  # a permutation
    spans = quantiles._brackets(df, ["x"], probs, 1.5)["x"][1]
    assert sum(hi - lo for lo, hi in spans) < 0.1 * n
    assert quantiles.fit_quantiles(df, ["x"], probs)["x"] == pytest.approx([p * (n - 1) for p in probs], rel=1e-12)


def test_missed_brackets_are_widened(spark, monkeypatch):
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    real, calls = quantiles._brackets, []

    def narrow(df, cols, probs, wide):
        calls.append(wide)
        out = real(df, cols, probs, wide)
        return {c: (n, [(hi, hi) for _, hi in spans]) for c, (n, spans) in out.items()} if len(calls) == 1 else out

    monkeypatch.setattr(quantiles, "_brackets", narrow)
    want = df.agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert quantiles.fit_quantiles(df, ["x"], [0.5])["x"] == [want] and len(calls) == 2


def test_splits_do_not_depend_on_partitioning(hot):
    a = split.split(hot.repartition(1), ["k"], stratify="g")
    b = split.split(hot.repartition(17), ["k"], stratify="g")
    assert rows(a, "k", "split") == rows(b, "k", "split")
    with pytest.raises(ValueError):
        split.split(hot, ["k"], 0.5, 0.2, 0.2)


def test_samples_leave_the_bulk_where_it_is(spark, hot):
    """The first rows in hash order, as a rank over the whole table gives them; nulls are a stratum, null takes nothing away."""
    from gridwright.plans.ordered import hash_rank

    base = hot.select("k", F.when(F.col("g") != 5, F.col("g")).alias("g"))
    for groups in ([], ["g"]):
        plain = hash_rank(base, ["k"], 42, groups, "r")
        for n in (1, 3, 40, 150, 5000):
            take = spark.createDataFrame([(n,)], "take long") if not groups else base.select("g").distinct().withColumn("take", F.lit(n))
            for digits in (1, 2, 3):
                got = split.first_rows(base, ["k"], groups, take, digits=digits)
                assert rows(got, "k") == rows(plain.where(F.col("r") <= n), "k")
    nested = split.nested_subsets(base, ["k"], (10, 100, 2999, 4000), "g")
    w, order = Window.partitionBy("g"), Window.orderBy("q", "g", "k")
    whole = hash_rank(base, ["k"], 42, ["g"], "i").withColumn("q", (F.col("i") - 0.5) / F.count("*").over(w)).withColumn("r", F.row_number().over(order))
    want = [(k, s) for k, r in rows(whole, "k", "r") for s in (10, 100, 2999) if r <= s]
    assert rows(nested, "k", "subset") == sorted(want, key=str)


def test_sample_sizes(hot):
    assert split.sample(hot, ["k"], n=100).count() == 100
    assert split.stratified_sample(hot, ["k"], "g", 333).count() == 333


def test_outlier_cap_keeps_exact_share(hot):
    df = hot.select("k", F.col("k").cast("double").alias("a"), F.col("k").cast("double").alias("b"))
    bounds = {"a": (0.0, 999.0), "b": (0.0, 999.0)}
    assert outlier.remove_multi_outliers(df, bounds, ["k"]).count() == 3000 - 600


def test_concordance_equals_pairs(spark):
    data = [(i, (i * 37) % 50 / 7.0, (i * 5) % 3 != 0, (i * 11) % 13 / 3.0) for i in range(120)]
    df = spark.createDataFrame([(k, t, int(e), r) for k, t, e, r in data], "key long, time double, event int, risk double")
    pairs = [(r1 > r2) for _, t1, e1, r1 in data if e1 for _, t2, _, r2 in data if t1 < t2]
    assert survival.concordance(df).first()[0] == pytest.approx(sum(pairs) / len(pairs))
    none = df.withColumn("event", F.lit(0))
    assert survival.concordance(none).first()[0] == 0.5


def test_ks_equals_definition(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 9.0]
    ra, rb = (spark.createDataFrame([(x,) for x in v], "x double") for v in (a, b))
    want = max(abs(sum(x <= p for x in a) / 4 - sum(x <= p for x in b) / 3) for p in a + b)
    assert drift.kolmogorov_smirnov(ra, rb, ["x"]).first()["score"] == pytest.approx(want)


def test_auc_with_ties(spark):
    rows_ = [(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8), (1, 0.1), (0, 0.9)]
    df = spark.createDataFrame(rows_, "y_true int, s double")
    pos, neg = [s for y, s in rows_ if y], [s for y, s in rows_ if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert classification.binary_areas(df, "s").first()["roc_auc"] == pytest.approx(want)


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_parts_equal_ranks(hot, digits):
    bounds = lambda n: [F.floor(n * 0.37), F.floor(n * 0.6)]
    got = ordered.hash_parts(hot, ["k"], bounds, 5, ["g"], "p", digits)
    ranked = ordered.hash_rank(hot, ["k"], 5, ["g"], "r", total="n")
    a, b = bounds(F.col("n"))
    want = ranked.withColumn("p", (F.col("r") > a).cast("int") + (F.col("r") > b).cast("int"))
    assert rows(got, "k", "p") == rows(want, "k", "p")
