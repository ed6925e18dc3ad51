"""Objective metrics: masked cells and columns, next rows, contrastive pairs, pooling functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.functions import vectors as vec
from gridwright.operators import pretraining as pre
from gridwright.queries.base import hash_sql, query, rounded, table
from gridwright.queries.classification import PROBA, proba

# every fifth order line is a masked cell; the guess of the flag and of the price come from other columns
CELLS = """(SELECT l_partkey % 5 = 0 AS masked, l_linenumber % 3 AS y_true, (l_quantity % 3)::INT AS y_pred, l_extendedprice / 1000 AS v, l_quantity * 1.5 AS pv FROM lineitem)"""


def cells(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 5 == 0).alias("masked"), (F.col("l_linenumber") % 3).alias("y_true"), (F.col("l_quantity") % 3).cast("int").alias("y_pred"),
        (F.col("l_extendedprice") / 1000).alias("v"), (F.col("l_quantity") * 1.5).alias("pv"),
    )


@query(
    "mp1_masked_classification",
    f"""SELECT count(*) AS n_masked, round(avg((y_true = y_pred)::INT::DOUBLE), 6) AS accuracy, round(avg(-ln(proba[y_true + 1])), 6) AS cross_entropy FROM (
    SELECT vec_id, y_true, list_position(proba, list_max(proba)) - 1 AS y_pred, proba FROM {PROBA}) WHERE vec_id % 4 = 0""",
)
def mp1(spark, sf):
    df = proba(spark, sf).select("y_true", "proba", vec.argmax(F.col("proba")).alias("y_pred"), (F.col("vec_id") % 4 == 0).alias("masked"))
    return rounded(pre.masked_classification(df, proba="proba"))


@query("mp1_masked_regression", f"SELECT count(*) AS n_masked, round(avg((pv - v) * (pv - v)), 6) AS mse, round(sqrt(avg((pv - v) * (pv - v))), 6) AS rmse FROM {CELLS} WHERE masked")
def mp1_regression(spark, sf):
    return rounded(pre.masked_regression(cells(spark, sf).select("masked", F.col("v").alias("y_true"), F.col("pv").alias("y_pred"))))


@query(
    "mp2_cell_report",
    f"""SELECT round(avg((y_true = y_pred)::INT::DOUBLE) FILTER (masked), 6) AS categorical_accuracy, round(avg(abs(pv - v)) FILTER (masked), 6) AS numerical_mae,
    2 * count(*) FILTER (masked) AS total_masked, round(avg(masked::INT::DOUBLE), 6) AS mask_ratio FROM {CELLS}""",
)
def mp2(spark, sf):
    c = cells(spark, sf)
    cat = c.select(F.lit("categorical").alias("kind"), "masked", F.col("y_true").cast("double").alias("y_true"), F.col("y_pred").cast("double").alias("y_pred"))
    num = c.select(F.lit("numerical").alias("kind"), "masked", F.col("v").alias("y_true"), F.col("pv").alias("y_pred"))
    return rounded(pre.masked_cell_report(cat.unionByName(num)))


@query(
    "mp2_column_report",
    """SELECT round(avg((t = p)::INT::DOUBLE) FILTER (m), 6) AS column_type_accuracy, round(avg((abs(a - c) + abs(b - d)) / 2) FILTER (m), 6) AS stats_mae,
    round(avg(abs(a - b)) FILTER (m), 6) AS correlation_mae, count(*) FILTER (m) AS total_masked_columns, round(avg(m::INT::DOUBLE), 6) AS column_mask_ratio FROM (
    SELECT l_partkey % 4 = 0 AS m, l_linenumber % 4 AS t, l_suppkey % 4 AS p, l_discount AS a, l_tax AS b, l_quantity / 50 AS c, l_tax * 2 AS d FROM lineitem)""",
)
def mp2_columns(spark, sf):
    df = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 4 == 0).alias("masked"), (F.col("l_linenumber") % 4).alias("type_true"), (F.col("l_suppkey") % 4).alias("type_pred"),
        F.array("l_discount", "l_tax").alias("stats_true"), F.array(F.col("l_quantity") / 50, F.col("l_tax") * 2).alias("stats_pred"),
        F.col("l_discount").alias("corr_true"), F.col("l_tax").alias("corr_pred"),
    )
    return rounded(pre.masked_column_report(df))


@query(
    "mp3_next_row",
    """WITH p AS (SELECT event_type, lag(event_type) OVER w AS pt, floor(value / 10) AS v, lag(floor(value / 10)) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (SELECT avg((event_type = pt)::INT::DOUBLE) AS a FROM p WHERE pt IS NOT NULL UNION ALL SELECT avg((v = pv)::INT::DOUBLE) FROM p WHERE pv IS NOT NULL)
    SELECT round(avg(a), 6) AS overall_accuracy, count(*) AS n_predicted_features, 4 AS n_total_features, count(*) / 4.0::DOUBLE AS prediction_coverage FROM f""",
)
def mp3(spark, sf):
    from gridwright.operators.sequence import naive_next_row

    t = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.col("value") / 10).cast("string").alias("bucket"))
    pred = naive_next_row(t, ["user_id"], ["ts", "event_id"], ["event_type", "bucket"])
    parts = [
        pred.where(F.col(f"{c}_pred").isNotNull()).select(F.lit(c).alias("feature"), F.col(c).alias("y_true"), F.col(f"{c}_pred").alias("y_pred"))
        for c in ("event_type", "bucket")
    ]
    return rounded(pre.next_row_report(parts[0].unionByName(parts[1]), 4))


# anchor: the vector; positive: the vector turned by one place; batches of 32 in hash order
_VEC = f"""(SELECT vec_id, (row_number() OVER (ORDER BY {hash_sql('vec_id')}, vec_id) - 1) // 32 AS b, list_transform(embedding, lambda x: x::DOUBLE) AS a,
  list_transform(embedding[2:] || embedding[1:1], lambda x: x::DOUBLE) AS p FROM embeddings)"""


def contrastive(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("anchor")
    )
    n = F.size("anchor")
    e = e.withColumn("positive", F.concat(F.slice("anchor", F.lit(2), n - 1), F.slice("anchor", 1, 1)))
    return pre.with_batches(e, ["vec_id"], 32)


_NCE = f"""(WITH v AS MATERIALIZED {_VEC}, s AS (
    SELECT x.vec_id, x.b, x.vec_id = y.vec_id AS pos, list_cosine_similarity(x.a, y.p) AS sim FROM v x JOIN v y ON x.b = y.b
    UNION ALL SELECT x.vec_id, x.b, false, list_cosine_similarity(x.a, y.a) FROM v x JOIN v y ON x.b = y.b AND x.vec_id <> y.vec_id)
  SELECT vec_id, b, ln(sum(exp(sim / 0.07 - 1 / 0.07))) + 1 / 0.07 - max(sim / 0.07) FILTER (pos) AS loss, (max(sim) FILTER (pos) >= coalesce(max(sim) FILTER (NOT pos), -9))::INT::DOUBLE AS correct,
    max(sim) FILTER (pos) AS ps, coalesce(avg(sim) FILTER (NOT pos), 0) AS ns FROM s GROUP BY 1, 2)"""


@query(
    "mp4_info_nce",
    f"SELECT vec_id AS key, b AS batch_id, round(loss, 5) AS loss, correct, round(ps, 6) AS positive_similarity, round(ns, 6) AS negative_similarity FROM {_NCE}",
)
def mp4(spark, sf):
    out = pre.info_nce(contrastive(spark, sf), key="vec_id")
    return rounded(out.withColumn("loss", F.round("loss", 5)))


@query(
    "mp4_report",
    f"""SELECT round(avg(loss), 5) AS loss, round(avg(correct), 6) AS contrastive_accuracy, round(avg(ps), 6) AS positive_similarity, round(avg(ns), 6) AS negative_similarity,
    round(avg(ps) - avg(ns), 6) AS similarity_gap FROM {_NCE}""",
)
def mp4_report(spark, sf):
    out = pre.contrastive_report(pre.info_nce(contrastive(spark, sf), key="vec_id"))
    return rounded(out.withColumn("loss", F.round("loss", 5)))


@query(
    "mp4_explicit_negatives",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
    s AS (SELECT vec_id, list_cosine_similarity(a, a[2:] || a[1:1]) / 0.07 AS p, list_cosine_similarity(a, a[3:] || a[1:2]) / 0.07 AS n1, list_cosine_similarity(a, list_reverse(a)) / 0.07 AS n2 FROM v)
    SELECT vec_id, round(ln(exp(p - greatest(p, n1, n2)) + exp(n1 - greatest(p, n1, n2)) + exp(n2 - greatest(p, n1, n2))) + greatest(p, n1, n2) - p, 5) AS loss, (p >= n1 AND p >= n2)::INT::DOUBLE AS correct FROM s""",
)
def mp4_explicit(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    n = F.size("a")
    turn = lambda k: F.concat(F.slice("a", F.lit(k + 1), n - k), F.slice("a", 1, k))
    df = e.select("vec_id", "a", turn(1).alias("p"), F.array(turn(2), F.reverse("a")).alias("n"))
    return rounded(pre.info_nce_explicit(df, "a", "p", "n").select("vec_id", "loss", "correct"), 5)


@query(
    "mp5_similarity_statistics",
    f"""WITH v AS MATERIALIZED {_VEC}, s AS (SELECT x.vec_id = y.vec_id AS pos, list_cosine_similarity(x.a, y.p) AS sim FROM v x JOIN v y ON x.b = y.b)
    SELECT round(avg(sim), 6) AS mean_similarity, round(stddev_pop(sim), 6) AS std_similarity, round(avg(sim) FILTER (pos), 6) AS positive_mean, round(stddev_pop(sim) FILTER (pos), 6) AS positive_std,
    round(avg(sim) FILTER (NOT pos), 6) AS negative_mean, round(stddev_pop(sim) FILTER (NOT pos), 6) AS negative_std, round(avg(sim) FILTER (pos) - avg(sim) FILTER (NOT pos), 6) AS separation FROM s""",
)
def mp5(spark, sf):
    return rounded(pre.similarity_statistics(contrastive(spark, sf)))


@query(
    "mp6_perplexity",
    "SELECT round(exp(avg(value / 100)), 6) AS perplexity FROM events",
)
def mp6(spark, sf):
    return rounded(pre.perplexity(table(spark, sf, "events").select((F.col("value") / 100).alias("loss")), "loss"))


@query(
    "mp6_weighted_objective",
    """SELECT user_id, round(1.0 * coalesce(avg(value) FILTER (event_type = 'click'), 0) + 0.5 * coalesce(avg(value) FILTER (event_type = 'view'), 0)
    + 0.25 * coalesce(avg(value) FILTER (event_type = 'error'), 0), 6) AS weighted_loss FROM events GROUP BY 1""",
)
def mp6_weighted(spark, sf):
    log = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.avg("value"))
    return rounded(pre.weighted_objective(log, {"click": 1.0, "view": 0.5, "error": 0.25}).select("user_id", "weighted_loss"))


@query(
    "fun_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)
    SELECT vec_id, round(sqrt(list_inner_product(a, a)), 6) AS norm, round(list_cosine_similarity(a, list_reverse(a)), 6) AS cosine,
    round(list_sum(list_transform(a[1:32], lambda x, i: (x + a[i + 32]) / 2)), 6) AS mean_pool_sum, round(list_sum(list_transform(a[1:32], lambda x, i: greatest(x, a[i + 32]))), 6) AS max_pool_sum,
    round(1 / (1 + exp(-a[1])), 6) AS sigmoid, round(ln(1 + exp(a[1])), 6) AS softplus FROM v""",
)
def fun_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    two = F.array(F.slice("a", 1, 32), F.slice("a", 33, 32))
    a = F.col("a")
    return rounded(e.select(
        "vec_id", vec.norm(a).alias("norm"), vec.cosine(a, F.reverse(a)).alias("cosine"), vec.fold_sum(vec.mean_pool(two)).alias("mean_pool_sum"),
        vec.fold_sum(vec.max_pool(two)).alias("max_pool_sum"), vec.sigmoid(a[0]).alias("sigmoid"), vec.softplus(a[0]).alias("softplus"),
    ))


@query(
    "fun_distributions",
    f"""SELECT vec_id, round(-list_sum(list_transform(proba, lambda p: p * ln(p + 1e-8))), 6) AS entropy, (list_position(proba, list_max(proba)) - 1)::INT AS argmax,
    array_to_string(list_transform(list_sort(list_transform(proba, lambda p, i: {{'n': -p, 'i': i - 1}}))[1:3], lambda s: s.i), ',') AS top3 FROM {PROBA}""",
)
def fun_distributions(spark, sf):
    p = F.col("proba")
    return rounded(proba(spark, sf).select(
        "vec_id", vec.entropy(p).alias("entropy"), vec.argmax(p).alias("argmax"),
        F.array_join(vec.top_k_indices(p, 3).cast("array<string>"), ",").alias("top3"),
    ))
