"""Metrics of the self-supervised objectives: masked cells, columns, next rows, contrastive pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.statistics import ratio
from gridwright.plans.ordered import hash_rank
from gridwright.plans.storage import written


def masked_classification(df: DataFrame, mask: str = "masked", proba: str | None = None) -> DataFrame:
    """Accuracy (and cross-entropy with a probability array) on masked cells only."""
    cells = [
        F.count("*").alias("n_masked"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")
    ]
    if proba:
        p = F.element_at(proba, F.col("y_true").cast("int") + 1)
        cells.append(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("cross_entropy"))
    return df.where(F.col(mask)).agg(*cells)


def masked_regression(df: DataFrame, mask: str = "masked") -> DataFrame:
    e = F.col("y_pred") - F.col("y_true")
    return df.where(F.col(mask)).agg(
        F.count("*").alias("n_masked"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def masked_cell_report(cells: DataFrame) -> DataFrame:
    """cells(kind, masked, y_true, y_pred): categorical accuracy, numeric MAE, masked count and share."""
    m = F.col("masked")
    cat = m & (F.col("kind") == "categorical")
    num = m & (F.col("kind") == "numerical")
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return cells.agg(
        F.coalesce(F.avg(F.when(cat, hit)), F.lit(0.0)).alias("categorical_accuracy"),
        F.coalesce(F.avg(F.when(num, F.abs(F.col("y_pred") - F.col("y_true")))), F.lit(0.0)).alias("numerical_mae"),
        F.count_if(m).alias("total_masked"), F.avg(m.cast("double")).alias("mask_ratio"),
    )


def masked_column_report(columns: DataFrame) -> DataFrame:
    """columns(masked, type_true, type_pred, stats_true, stats_pred, corr_true, corr_pred)."""
    m = F.col("masked")
    diff = F.aggregate(
        F.zip_with("stats_true", "stats_pred", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x
    ) / F.size("stats_true")
    return columns.agg(
        F.avg(F.when(m, (F.col("type_true") == F.col("type_pred")).cast("double"))).alias("column_type_accuracy"),
        F.avg(F.when(m, diff)).alias("stats_mae"), F.avg(F.when(m, F.abs(F.col("corr_true") - F.col("corr_pred")))).alias("correlation_mae"),
        F.count_if(m).alias("total_masked_columns"), F.avg(m.cast("double")).alias("column_mask_ratio"),
    )


def next_row_report(cells: DataFrame, n_total: int) -> DataFrame:
    """cells(feature, y_true, y_pred): mean of the per-feature accuracies and feature coverage."""
    per = cells.groupBy("feature").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return per.agg(
        F.avg("accuracy").alias("overall_accuracy"), F.count("*").alias("n_predicted_features"), F.lit(n_total).alias("n_total_features"),
        (F.count("*") / max(n_total, 1)).alias("prediction_coverage"),
    )


def with_batches(df: DataFrame, key_cols: Sequence[str], batch_size: int, seed: int = 42) -> DataFrame:
    """Adds batch_id: consecutive ranks in hash order, at most `batch_size` rows each."""
    return hash_rank(df, key_cols, seed, out="__r").withColumn(
        "batch_id", F.floor((F.col("__r") - 1) / batch_size).cast("long")
    ).drop("__r")


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


#: Rows of a batch whose similarities are held as one matrix; larger batches are cut in blocks of about so many.
BATCH_BLOCK = 1024
_NCE = "loss double, correct double, positive_similarity double, negative_similarity double"


def _unit_columns(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _unit(np.stack(pdf["a"].to_numpy()).astype(float)), _unit(np.stack(pdf["p"].to_numpy()).astype(float))


def _whole_batches(rows: DataFrame, dtype: str, temperature: float, keep_self: bool) -> DataFrame:
    """One matrix product a batch."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, p = _unit_columns(pdf)
        ap, aa = a @ p.T, a @ a.T
        n = len(a)
        off = ~np.eye(n, dtype=bool)
        logits = np.concatenate([ap, aa if keep_self else np.where(off, aa, -np.inf)], axis=1) / temperature
        top = logits.max(axis=1, keepdims=True)
        lse = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0]
        pos = np.diag(ap)
        others = logits.copy()
        others[np.arange(n), np.arange(n)] = -np.inf
        neg_sum = (ap * off).sum(axis=1) + (aa * off).sum(axis=1)
        return pd.DataFrame({
            "key": pdf["key"], "batch_id": pdf["batch_id"], "loss": lse - pos / temperature,
            "correct": (pos / temperature >= others.max(axis=1)).astype(float),
            "positive_similarity": pos, "negative_similarity": neg_sum / max(2 * n - 2, 1),
        })

    return rows.groupBy("batch_id").applyInPandas(one, f"key {dtype}, batch_id long, {_NCE}")


def _packed_batches(rows: DataFrame, size: int) -> DataFrame:
    """(batch_id, block, n, blocks, items): blocks of about ``size`` rows; ``rows`` has the batch's row count n."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("a", "p", F.col("key").cast("string")), blocks).cast("int"))
    packed = dealt.groupBy("batch_id", "block", "n", "blocks").agg(F.collect_list(F.struct("key", "a", "p")).alias("items"))
    return written(packed, "batches")


def _block_batches(rows: DataFrame, dtype: str, temperature: float, keep_self: bool, size: int) -> DataFrame:
    """Every block of a batch meets every other; a row's log-sum-exp is merged from one (greatest, sum) a block."""
    packed = _packed_batches(rows, size)
    left = packed.select("batch_id", F.col("block").alias("mine"), "n", F.col("items").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = left.join(packed.select("batch_id", "block", F.col("items").alias("y")), ["batch_id", "block"]).select("batch_id", "mine", "block", "n", "x", "y")
    schema = f"key {dtype}, batch_id long, mine int, i int, n long, top double, total double, rival double, negatives double, pos double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                side = lambda items: [_unit(items.field(f).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(items), -1)) for f in (1, 2)]
                x, y = get("x").values, get("y").values
                (a, p), (b, q) = side(x), side(y)
                ap, aa = a @ q.T, a @ b.T
                pos = (a * p).sum(axis=1)
                same = get("mine").as_py() == get("block").as_py()
                own = np.eye(len(a), len(b), dtype=bool) if same else np.zeros((len(a), len(b)), bool)
                rivals = np.concatenate([np.where(own, -np.inf, ap), aa if keep_self else np.where(own, -np.inf, aa)], axis=1) / temperature
                top = np.maximum(rivals.max(axis=1), pos / temperature if same else -np.inf)
                top = np.where(np.isfinite(top), top, -1e300)
                total = np.exp(rivals - top[:, None]).sum(axis=1) + (np.exp(pos / temperature - top) if same else 0.0)
                m = len(a)
                full = lambda v, t: pa.array(np.full(m, v), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    x.field(0), full(get("batch_id").as_py(), pa.int64()), full(get("mine").as_py(), pa.int32()), pa.array(np.arange(m, dtype=np.int32)),
                    full(get("n").as_py(), pa.int64()), pa.array(top), pa.array(total), pa.array(rivals.max(axis=1)),
                    pa.array(np.where(own, 0.0, ap).sum(axis=1) + np.where(own, 0.0, aa).sum(axis=1)), pa.array(pos),
                ], [f.split()[0] for f in schema.split(", ")])

    parts = met.mapInArrow(run, schema).groupBy("batch_id", "mine", "i").agg(
        F.first("key").alias("key"), F.max("n").alias("n"), F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("sums"),
        F.max("rival").alias("rival"), F.sum("negatives").alias("negatives"), F.max("pos").alias("pos"),
    )
    total = F.aggregate("sums", F.lit(0.0), lambda s, e: s + e["total"] * F.exp(e["top"] - F.col("top")))
    return parts.select(
        "key", "batch_id", (F.log(total) + F.col("top") - F.col("pos") / temperature).alias("loss"),
        (F.col("pos") / temperature >= F.col("rival")).cast("double").alias("correct"), F.col("pos").alias("positive_similarity"),
        (F.col("negatives") / F.greatest(2 * F.col("n") - 2, F.lit(1))).alias("negative_similarity"),
    )


def _sized(df: DataFrame, anchor: str, positive: str, block: int, key: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of batches of at most ``block`` rows, rows of larger ones (with their number n), and whether there are such."""
    rows = df.select(*([F.col(key).alias("key")] if key else [F.lit(0).alias("key")]), F.col("batch_id").cast("long").alias("batch_id"), F.col(anchor).alias("a"), F.col(positive).alias("p"))
    large = rows.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") > block)
    if large.isEmpty():
        return rows, rows.withColumn("n", F.lit(0)), False
    large = written(large, "large")
    return rows.join(large, "batch_id", "left_anti").select(rows.columns), rows.join(large, "batch_id"), True


def info_nce(
    df: DataFrame, anchor: str = "anchor", positive: str = "positive", key: str = "key",
    temperature: float = 0.07, keep_self: bool = False, block: int = BATCH_BLOCK,
) -> DataFrame:
    """Per row: InfoNCE loss with in-batch negatives (all other positives and all other anchors),
    whether the positive wins, and the positive and mean negative similarity.

    `df` needs batch_id. A batch of at most `block` rows is one matrix product in an Arrow task; a larger one is cut in blocks, whose
    pairs are worked on by all tasks. Pairs of rows are never materialized. `keep_self` also counts the anchor itself.
    """
    dtype = df.schema[key].dataType.simpleString()
    small, large, any_large = _sized(df, anchor, positive, block, key)
    out = _whole_batches(small, dtype, temperature, keep_self)
    return out.unionByName(_block_batches(large, dtype, temperature, keep_self, block)) if any_large else out


def info_nce_explicit(df: DataFrame, anchor: str, positive: str, negatives: str, temperature: float = 0.07) -> DataFrame:
    """InfoNCE with an explicit array of negative vectors per row, as one expression."""
    from gridwright.functions.vectors import cosine, fold_sum

    pos = cosine(F.col(anchor), F.col(positive)) / temperature
    logits = F.concat(F.array(pos), F.transform(negatives, lambda v: cosine(F.col(anchor), v) / temperature))
    top = F.array_max(logits)
    lse = F.log(fold_sum(F.transform(logits, lambda x: F.exp(x - top)))) + top
    return df.select("*", (lse - pos).alias("loss"), (pos >= top).cast("double").alias("correct"))


def contrastive_report(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.avg("loss").alias("loss"), F.avg("correct").alias("contrastive_accuracy"),
        F.avg("positive_similarity").alias("positive_similarity"), F.avg("negative_similarity").alias("negative_similarity"),
        (F.avg("positive_similarity") - F.avg("negative_similarity")).alias("similarity_gap"),
    )


def similarity_statistics(df: DataFrame, anchor: str = "anchor", positive: str = "positive", block: int = BATCH_BLOCK) -> DataFrame:
    """Mean and population std of the in-batch similarity matrices: overall, diagonal, off-diagonal.

    Each batch of at most `block` rows returns six sums; the matrices stay inside the tasks. A larger one needs no matrix of all its
    pairs: the sums over it follow from sums of its vectors and of their outer products.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, p = _unit_columns(pdf)
        s = a @ p.T
        d = np.diag(s)
        return pd.DataFrame([(s.size, s.sum(), (s * s).sum(), len(d), d.sum(), (d * d).sum())],
                            columns=["n", "s", "q", "dn", "ds", "dq"])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for pdf in batches:
            for batch_id, rows in pdf.groupby("batch_id"):
                a, p = _unit_columns(rows)
                d = (a * p).sum(axis=1)
                got = [np.concatenate([(a.T @ a).ravel(), a.sum(axis=0)]), np.concatenate([(p.T @ p).ravel(), p.sum(axis=0)]), np.array([len(d), d.sum(), (d * d).sum()])]
                found[batch_id] = [x + y for x, y in zip(found[batch_id], got)] if batch_id in found else got
        cells = [(b, kind, i, float(x)) for b, got in found.items() for kind, values in enumerate(got) for i, x in enumerate(values)]
        if cells:
            yield pd.DataFrame(cells, columns=["batch_id", "kind", "i", "x"])

    small, large, any_large = _sized(df, anchor, positive, block)
    sums = small.groupBy("batch_id").applyInPandas(one, "n double, s double, q double, dn double, ds double, dq double")
    if any_large:
        cells = large.select("batch_id", "a", "p").mapInPandas(products, "batch_id long, kind int, i int, x double").groupBy("batch_id", "kind", "i").agg(F.sum("x").alias("x"))
        dims = F.floor((F.sqrt(1 + 4 * F.col("m").cast("double")) - 1) / 2)  # m = dims * dims + dims
        sides = cells.where("kind < 2").groupBy("batch_id", "i").agg(F.max(F.when(F.col("kind") == 0, F.col("x"))).alias("x"), F.max(F.when(F.col("kind") == 1, F.col("x"))).alias("y"))
        sizes = sides.groupBy("batch_id").agg(F.count("*").alias("m")).select("batch_id", dims.alias("dims"))
        both = sides.join(sizes, "batch_id").groupBy("batch_id").agg(
            F.sum(F.when(F.col("i") >= F.col("dims") * F.col("dims"), F.col("x") * F.col("y"))).alias("s"), F.sum(F.when(F.col("i") < F.col("dims") * F.col("dims"), F.col("x") * F.col("y"))).alias("q")
        )
        own = cells.where("kind = 2").groupBy("batch_id").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(c) for i, c in enumerate(("dn", "ds", "dq"))])
        sums = sums.unionByName(both.join(own, "batch_id").select((F.col("dn") * F.col("dn")).alias("n"), "s", "q", "dn", "ds", "dq"))
    t = sums.agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "dn", "ds", "dq")])

    def mean_std(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
        m = ratio(s, n)
        return m, F.sqrt(F.greatest(ratio(q, n) - m * m, F.lit(0.0)))

    c = {k: F.col(k) for k in ("n", "s", "q", "dn", "ds", "dq")}
    am, as_ = mean_std(c["n"], c["s"], c["q"])
    pm, ps = mean_std(c["dn"], c["ds"], c["dq"])
    nm, ns = mean_std(c["n"] - c["dn"], c["s"] - c["ds"], c["q"] - c["dq"])
    return t.select(
        am.alias("mean_similarity"), as_.alias("std_similarity"), pm.alias("positive_mean"), ps.alias("positive_std"),
        nm.alias("negative_mean"), ns.alias("negative_std"), (pm - nm).alias("separation"),
    )


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))


def weighted_objective(df: DataFrame, weights: dict[str, float], out: str = "weighted_loss") -> DataFrame:
    """Weighted sum of the objective losses of a log row; an absent loss counts 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(w))
    return df.withColumn(out, total)
