"""Classification and ranking metrics, significance, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.functions.vectors import softmax
from gridwright.operators import classification as clf
from gridwright.operators import experiments, ranking, significance
from gridwright.queries.base import query, rounded, table, uniform_sql, union_sql

# binary truth and score of a document
BIN = """(SELECT l.doc_id, quality AS y_true, n_chars / (n_chars + 1000.0) AS score, (n_chars / (n_chars + 1000.0) > 0.5)::INT AS y_pred,
  toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
# multi-class truth and guess of an order line
MULTI = """(SELECT l_returnflag AS y_true, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE l_returnflag END AS y_pred FROM lineitem)"""


def binary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    s = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return table(spark, sf, "labels").join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("y_true"), s.alias("score"), (s > 0.5).cast("int").alias("y_pred"), "toxic"
    )


def multi(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("y_true"), F.when(q < 17, "A").when(q < 34, "N").otherwise(F.col("l_returnflag")).alias("y_pred")
    )


# ten-class probabilities of a vector: softmax of the sums of its entries in ten groups
PROBA = """(SELECT vec_id, label AS y_true, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda v: exp(v)))) AS proba
  FROM (SELECT vec_id, label, list_transform(range(10), lambda j: list_sum(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x, i: (i - 1) % 10 = j))) AS z FROM embeddings))"""


def _z():
    return F.expr("transform(sequence(0, 9), j -> aggregate(filter(embedding, (x, i) -> i % 10 = j), 0.0D, (a, x) -> a + cast(x as double)))")


def proba(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y_true"), _z().alias("z")).select("vec_id", "y_true", softmax(F.col("z")).alias("proba"))


def _class_sql(src: str) -> str:
    return f"""(SELECT label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS tp,
      CASE WHEN sum(p) = 0 THEN 0 ELSE sum(h)::DOUBLE / sum(p) END AS precision, CASE WHEN sum(t) = 0 THEN 0 ELSE sum(h)::DOUBLE / sum(t) END AS recall,
      CASE WHEN sum(p) + sum(t) = 0 THEN 0 ELSE 2.0 * sum(h) / (sum(p) + sum(t)) END AS f1 FROM (
      SELECT y_true AS label, 1 AS t, 0 AS p, (y_true = y_pred)::INT AS h FROM {src} UNION ALL SELECT y_pred, 0, 1, 0 FROM {src}) GROUP BY label)"""


@query(
    "mc1_metrics",
    f"""SELECT 'weighted' AS average, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
    round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM {_class_sql(MULTI)}
    UNION ALL SELECT 'macro', round(sum(tp)::DOUBLE / sum(support), 6), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM {_class_sql(MULTI)}
    UNION ALL SELECT 'binary', round(sum(tp)::DOUBLE / sum(support), 6), round(max(precision) FILTER (label = 1), 6), round(max(recall) FILTER (label = 1), 6),
      round(max(f1) FILTER (label = 1), 6) FROM {_class_sql(BIN)}""",
)
def mc1(spark, sf):
    m = multi(spark, sf)
    parts = [clf.classification_metrics(m, a).withColumn("average", F.lit(a)) for a in ("weighted", "macro")]
    parts.append(clf.classification_metrics(binary(spark, sf), "binary").withColumn("average", F.lit("binary")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "mc2_per_class",
    f"SELECT label, support, tp, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_class_sql(MULTI)}",
)
def mc2(spark, sf):
    return rounded(clf.per_class(clf.confusion(multi(spark, sf))))


@query(
    "mc3_confusion",
    f"""SELECT y_true, count(*) FILTER (y_pred = 'A') AS "A", count(*) FILTER (y_pred = 'N') AS "N", count(*) FILTER (y_pred = 'R') AS "R" FROM {MULTI} GROUP BY 1""",
)
def mc3(spark, sf):
    return clf.confusion_matrix(multi(spark, sf), ["A", "N", "R"])


@query(
    "mc3_report",
    f"""SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {_class_sql(MULTI)}
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM {_class_sql(MULTI)}
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM {_class_sql(MULTI)}
    UNION ALL SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6),
      sum(support)::BIGINT FROM {_class_sql(MULTI)}""",
)
def mc3_report(spark, sf):
    return rounded(clf.classification_report(multi(spark, sf)))


def _areas_sql(src: str, by: str = "1") -> str:
    return f"""(WITH s AS (SELECT {by} AS g, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {src} GROUP BY 1, 2),
      c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM s
        WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT g, sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)) AS roc_auc, sum(pos / p * tp / (tp + fp)) AS ap, max(p) AS support FROM c GROUP BY g)"""


_BIN_S = f"(SELECT score, y_true AS y FROM {BIN})"
_OVR = f"(SELECT (i - 1) AS label, p AS score, (y_true = i - 1)::INT AS y FROM (SELECT y_true, unnest(proba) AS p, generate_subscripts(proba, 1) AS i FROM {PROBA}))"
# events: is it an error, by value; whole table with many ties
_EV_S = "(SELECT value AS score, (event_type = 'error')::INT AS y FROM events)"


@query(
    "mc4_roc_auc",
    f"""SELECT 'documents' AS source, round(roc_auc, 6) AS roc_auc FROM {_areas_sql(_BIN_S)} UNION ALL SELECT 'events', round(roc_auc, 6) FROM {_areas_sql(_EV_S)}
    UNION ALL SELECT 'one_vs_rest', round(sum(roc_auc * support) / sum(support), 6) FROM {_areas_sql(_OVR, 'label')}""",
)
def mc4(spark, sf):
    ev = table(spark, sf, "events").select(F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("y_true"))
    parts = [
        clf.binary_areas(binary(spark, sf), "score").select(F.lit("documents").alias("source"), "roc_auc"),
        clf.binary_areas(ev, "score").select(F.lit("events").alias("source"), "roc_auc"),
        clf.multiclass_areas(proba(spark, sf)).select(F.lit("one_vs_rest").alias("source"), "roc_auc"),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "mc5_average_precision",
    f"""SELECT 'events' AS source, round(ap, 6) AS average_precision FROM {_areas_sql(_EV_S)}
    UNION ALL SELECT 'macro', round(avg(ap), 6) FROM {_areas_sql(_OVR, 'label')}""",
)
def mc5(spark, sf):
    ev = table(spark, sf, "events").select(F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("y_true"))
    a = clf.binary_areas(ev, "score").select(F.lit("events").alias("source"), "average_precision")
    b = clf.multiclass_areas(proba(spark, sf)).select(F.lit("macro").alias("source"), "average_precision")
    return rounded(a.unionByName(b))


@query("mc6_log_loss", f"SELECT round(avg(-ln(proba[y_true + 1])), 6) AS log_loss FROM {PROBA}")
def mc6(spark, sf):
    return rounded(clf.log_loss(proba(spark, sf)))


@query(
    "mc7_threshold",
    f"""SELECT tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(tp::DOUBLE / (tp + fp), 6) AS precision,
    round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn::DOUBLE / (tn + fp), 6) AS specificity,
    round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 6) AS balanced_accuracy FROM (
    SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
      count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM {BIN})""",
)
def mc7(spark, sf):
    return rounded(clf.threshold_metrics(binary(spark, sf), "score"))


_TOPK = f"""(SELECT y_true, y_pred, (SELECT count(*) FROM unnest(proba) u(p) WHERE p > mine) AS above FROM (
  SELECT y_true, list_position(proba, list_max(proba)) - 1 AS y_pred, proba, proba[y_true + 1] AS mine FROM {PROBA}))"""
_ARG = f"(SELECT y_true, (list_position(proba, list_max(proba)) - 1)::INT AS y_pred FROM {PROBA})"


@query(
    "mc8_multiclass",
    f"""SELECT (SELECT round(avg(precision), 6) FROM {_class_sql(_ARG)} WHERE support > 0) AS precision,
    (SELECT round(avg(recall), 6) FROM {_class_sql(_ARG)} WHERE support > 0) AS recall, (SELECT round(avg(f1), 6) FROM {_class_sql(_ARG)} WHERE support > 0) AS f1,
    round(avg((y_true = y_pred)::INT::DOUBLE), 6) AS accuracy, round(avg((above < 3)::INT::DOUBLE), 6) AS top3_accuracy, round(avg((above < 5)::INT::DOUBLE), 6) AS top5_accuracy FROM {_TOPK}""",
)
def mc8(spark, sf):
    return rounded(clf.multiclass_metrics(proba(spark, sf)))


# two labels per order line with two scores
ML = """(SELECT unnest([0, 1]) AS i, unnest([(l_returnflag = 'R')::INT, (l_linestatus = 'O')::INT]) AS t, unnest([l_quantity / 50, l_discount * 10]) AS s,
  unnest([l_orderkey, l_orderkey]) AS k FROM lineitem)"""


def multilabel(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.array((F.col("l_returnflag") == "R").cast("int"), (F.col("l_linestatus") == "O").cast("int")).alias("labels"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("scores"),
    )


@query(
    "mc9_multilabel",
    f"""WITH c AS (SELECT i, t, (s > 0.5)::INT AS p FROM {ML}),
    l AS (SELECT i, count(*) FILTER (t = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (t = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (t = 1 AND p = 0)::DOUBLE AS fn FROM c GROUP BY i),
    s AS (SELECT avg(((l_returnflag = 'R') = (l_quantity / 50 > 0.5) AND (l_linestatus = 'O') = (l_discount * 10 > 0.5))::INT::DOUBLE) AS a FROM lineitem)
    SELECT (SELECT round(avg((t <> p)::INT::DOUBLE), 6) FROM c) AS hamming_loss, (SELECT round(a, 6) FROM s) AS subset_accuracy,
    round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1,
    round(avg(tp / (tp + fp)), 6) AS macro_precision, round(avg(tp / (tp + fn)), 6) AS macro_recall, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM l""",
)
def mc9(spark, sf):
    return rounded(clf.multilabel_metrics(multilabel(spark, sf)))


@query(
    "mc10_postprocess",
    f"""SELECT vec_id, list_position(proba, list_max(proba)) - 1 AS label, round(list_max(proba), 6) AS top FROM {PROBA}""",
)
def mc10(spark, sf):
    out = clf.postprocess(table(spark, sf, "embeddings").select("vec_id", _z().alias("z")), "z")
    return rounded(out.select("vec_id", F.col("label").cast("long").alias("label"), F.array_max("proba").alias("top")))


@query(
    "mc11_weighted_loss",
    f"""SELECT round(sum(0.9 * w * -ln(proba[y_true + 1]) + 0.1 * sp) / sum(w), 6) AS cross_entropy, (SELECT round(avg(-(w * t * ln(p) + (1 - t) * ln(1 - p))), 6)
      FROM (SELECT t, CASE i WHEN 0 THEN 2.0 ELSE 0.5 END AS w, least(greatest(s, 1e-12), 1 - 1e-12) AS p FROM {ML})) AS binary_cross_entropy FROM (
    SELECT y_true, proba, 1 + y_true / 10.0 AS w, list_sum(list_transform(range(10), lambda i: (1 + i / 10.0) * -ln(proba[i + 1]))) / 10 AS sp FROM {PROBA})""",
)
def mc11(spark, sf):
    a = clf.weighted_cross_entropy(proba(spark, sf), [1 + i / 10 for i in range(10)], smoothing=0.1).select(F.col("loss").alias("cross_entropy"), F.lit(1).alias("k"))
    b = clf.weighted_binary_cross_entropy(multilabel(spark, sf), [2.0, 0.5]).select(F.col("loss").alias("binary_cross_entropy"), F.lit(1).alias("k"))
    return rounded(a.join(b, "k").drop("k"))


# ---------------------------------------------------------------- ranking

RANK = """(SELECT o_custkey AS q, o_orderkey AS k, o_totalprice AS s, greatest(3 - CAST(left(o_orderpriority, 1) AS INTEGER), 0) AS rel FROM orders)"""
_RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS r, row_number() OVER (PARTITION BY q ORDER BY rel DESC, k) AS i FROM {RANK})"""


def rank_input(spark, sf):
    rel = F.greatest(F.lit(3) - F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(0))
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("s"), rel.alias("rel"))
    return ranking.ranked(t, "q", "s", "rel", "k")


@query(
    "mk1_ndcg",
    union_sql(
        f"""SELECT {k} AS k, round(avg(CASE WHEN b > 0 THEN d / b ELSE 0 END), 6) AS ndcg FROM (SELECT q, sum(CASE WHEN r <= {k} THEN rel / log2(r + 1) ELSE 0 END) AS d,
        sum(CASE WHEN i <= {k} THEN rel / log2(i + 1) ELSE 0 END) AS b FROM {_RANKED} GROUP BY q)"""
        for k in (5, 10)
    ),
)
def mk1(spark, sf):
    r = rank_input(spark, sf)
    return rounded(ranking.ndcg(r, "q", "rel", 5).unionByName(ranking.ndcg(r, "q", "rel", 10)))


# scores in steps of 50,000: many orders of a customer share one
_TIED = f"""(SELECT *, min(r) OVER (PARTITION BY q, t) AS lo, count(*) OVER (PARTITION BY q, t) AS c FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY t DESC, k) AS r, row_number() OVER (PARTITION BY q ORDER BY rel DESC, k) AS i FROM (SELECT *, floor(s / 50000) AS t FROM {RANK})))"""


@query(
    "mk1_ndcg_tied",
    union_sql(
        f"""SELECT {k} AS k, round(avg(CASE WHEN b > 0 THEN d / b ELSE 0 END), 6) AS ndcg FROM (
        SELECT q, sum(rel / c * coalesce(list_sum(list_transform(range(lo, least(lo + c - 1, {k}) + 1), lambda p: 1 / log2(p + 1))), 0)) AS d,
        sum(CASE WHEN i <= {k} THEN rel / log2(i + 1) ELSE 0 END) AS b FROM {_TIED} GROUP BY q)"""
        for k in (5, 10)
    ),
)
def mk1_tied(spark, sf):
    t = rank_input(spark, sf).drop("rank", "ideal").withColumn("t", F.floor(F.col("s") / 50000))
    r = ranking.ranked(t, "q", "t", "rel", "k")
    return rounded(ranking.ndcg(r, "q", "rel", 5, "t").unionByName(ranking.ndcg(r, "q", "rel", 10, "t")))


@query(
    "mk2_mrr",
    f"""SELECT (SELECT round(avg(coalesce(1.0 / f, 0)), 6) FROM (SELECT q, min(r) FILTER (rel > 0) AS f FROM {_RANKED} GROUP BY q)) AS mrr_first,
    (SELECT round(avg(1.0 / r), 6) FROM {_RANKED} WHERE rel > 0) AS mean_reciprocal_rank_all""",
)
def mk2(spark, sf):
    return rounded(ranking.reciprocal_ranks(rank_input(spark, sf), "q", "rel"))


@query(
    "mk3_precision_recall",
    union_sql(
        f"""SELECT {k} AS k, round(avg(h / {k}.0), 6) AS precision, round(avg(CASE WHEN n > 0 THEN h::DOUBLE / n ELSE 0 END), 6) AS recall FROM (
        SELECT q, count(*) FILTER (rel > 0 AND r <= {k}) AS h, count(*) FILTER (rel > 0) AS n FROM {_RANKED} GROUP BY q)"""
        for k in (1, 5, 10)
    ),
)
def mk3(spark, sf):
    return rounded(ranking.precision_recall_at(rank_input(spark, sf), "q", "rel", (1, 5, 10)))


# ---------------------------------------------------------------- significance


@query(
    "st1_paired_t",
    """SELECT count(*) AS n, round(avg(d), 6) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS statistic FROM (SELECT l_discount - l_tax AS d FROM lineitem)""",
)
def st1(spark, sf):
    return rounded(significance.paired_t_statistic(table(spark, sf, "lineitem"), "l_discount", "l_tax"))


@query(
    "st2_wilcoxon",
    """WITH d AS (SELECT round(l_discount - l_tax, 2) AS d FROM lineitem WHERE round(l_discount - l_tax, 2) <> 0),
    c AS (SELECT abs(d) AS m, count(*)::DOUBLE AS n, count(*) FILTER (d > 0)::DOUBLE AS up FROM d GROUP BY 1),
    r AS (SELECT *, sum(n) OVER (ORDER BY m) - (n - 1) / 2 AS r FROM c)
    SELECT sum(r * up) AS w_plus, sum(r * (n - up)) AS w_minus, sum(n)::BIGINT AS n, sum(n * n * n - n) AS ties, least(sum(r * up), sum(r * (n - up))) AS statistic FROM r""",
)
def st2(spark, sf):
    t = table(spark, sf, "lineitem").select(F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("a"), F.lit(0.0).alias("b"))
    return significance.wilcoxon_statistic(t, "a", "b")


def _poisson_sql(u: str) -> str:
    import math

    out, cdf, term = "CASE", 0.0, math.exp(-1.0)
    for k in range(12):
        cdf += term
        term /= k + 1
        out += f" WHEN {u} < {cdf!r} THEN {k}"
    return out + " ELSE 12 END"


_BOOT = f"""SELECT replicate, sum(w * s) / sum(w * c) AS mean FROM (SELECT replicate, s, c, {_poisson_sql('u')} AS w FROM (
      SELECT replicate, s, c, {uniform_sql("unit || '|' || replicate", "boot")} AS u FROM (
        SELECT CAST(CAST(floor({uniform_sql("event_id", "block")} * 1000) AS BIGINT) AS VARCHAR) AS unit, sum(value) AS s, count(value) AS c FROM events GROUP BY 1),
        (SELECT unnest(range(1000))::INTEGER AS replicate))) GROUP BY 1"""


@query("st3_bootstrap", f"SELECT replicate, round(mean, 6) AS mean FROM ({_BOOT})")
def st3(spark, sf):
    return rounded(significance.bootstrap_means(table(spark, sf, "events"), "value", "event_id"))


@query(
    "st3_interval",
    f"""SELECT round((SELECT avg(value) FROM events), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper FROM ({_BOOT})""",
)
def st3_interval(spark, sf):
    return rounded(significance.bootstrap_interval(table(spark, sf, "events"), "value", "event_id"))


# ---------------------------------------------------------------- experiment results

# results(model, dataset, metric, value): languages as data sets, sources as models
RES = """(SELECT source AS model, lang AS dataset, unnest(['chars', 'rmse_like']) AS metric, unnest([avg(n_chars), stddev_pop(n_chars)]) AS value FROM documents GROUP BY 1, 2)"""


def results(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.col("source").alias("model"), F.col("lang").alias("dataset")).agg(
        F.avg("n_chars").alias("chars"), F.stddev_pop("n_chars").alias("rmse_like")
    )
    return g.unpivot(["model", "dataset"], ["chars", "rmse_like"], "metric", "value")


@query(
    "ord1_leaderboard",
    f"""SELECT model, round(avg(value) FILTER (metric = 'chars'), 4) AS chars, round(avg(value) FILTER (metric = 'rmse_like'), 4) AS rmse_like,
    CAST(row_number() OVER (ORDER BY avg(value) FILTER (metric = 'rmse_like'), model) AS INTEGER) AS rank FROM {RES} GROUP BY model""",
)
def ord1(spark, sf):
    return rounded(experiments.leaderboard(results(spark, sf), "rmse_like", ["chars", "rmse_like"]), 4)


@query(
    "bl5_summary",
    f"""SELECT model, count(DISTINCT dataset) AS n_datasets, round(avg(value) FILTER (metric = 'chars'), 4) AS chars_mean, round(stddev_pop(value) FILTER (metric = 'chars'), 4) AS chars_std,
    round(avg(value) FILTER (metric = 'rmse_like'), 4) AS rmse_like_mean, round(stddev_pop(value) FILTER (metric = 'rmse_like'), 4) AS rmse_like_std FROM {RES} GROUP BY model""",
)
def bl5(spark, sf):
    return rounded(experiments.suite_summary(results(spark, sf), ["chars", "rmse_like"]), 4)


@query(
    "bl6_improvement",
    f"""SELECT a.model, a.dataset, a.metric, round(a.value - b.value, 4) AS absolute, round(CASE WHEN b.value = 0 THEN 0 ELSE (a.value - b.value) / abs(b.value) END, 6) AS relative
    FROM {RES} a JOIN {RES} b ON a.dataset = b.dataset AND a.metric = b.metric WHERE b.model = 'src0' AND a.model <> 'src0'""",
)
def bl6(spark, sf):
    out = experiments.improvements(results(spark, sf), "src0")
    return out.select("model", "dataset", "metric", F.round("absolute", 4).alias("absolute"), F.round("relative", 6).alias("relative"))


@query(
    "bl7_transfer_matrix",
    f"""SELECT model AS source, max(value) FILTER (dataset = 'de') AS de, max(value) FILTER (dataset = 'en') AS en, max(value) FILTER (dataset = 'es') AS es, max(value) FILTER (dataset = 'fr') AS fr
    FROM (SELECT model, dataset, metric, round(value, 4) AS value FROM {RES}) WHERE metric = 'chars' GROUP BY model""",
)
def bl7(spark, sf):
    r = results(spark, sf).select(F.col("model").alias("source"), F.col("dataset").alias("target"), "metric", F.round("value", 4).alias("value"))
    return experiments.transfer_matrix(r, "chars", ["de", "en", "es", "fr"])


# ---------------------------------------------------------------- one entry for all


@query(
    "ev1_evaluate",
    f"""WITH c AS {_class_sql(_ARG)}, a AS {_areas_sql(_OVR, 'label')}
    SELECT 'accuracy' AS metric, round(sum(tp)::DOUBLE / sum(support), 6) AS value FROM c UNION ALL SELECT 'precision', round(sum(precision * support) / sum(support), 6) FROM c
    UNION ALL SELECT 'recall', round(sum(recall * support) / sum(support), 6) FROM c UNION ALL SELECT 'f1', round(sum(f1 * support) / sum(support), 6) FROM c
    UNION ALL SELECT 'roc_auc', round(sum(roc_auc * support) / sum(support), 6) FROM a UNION ALL SELECT 'average_precision', round(avg(ap), 6) FROM a
    UNION ALL SELECT 'log_loss', round(avg(-ln(proba[y_true + 1])), 6) FROM {PROBA}""",
)
def ev1(spark, sf):
    from gridwright.functions.vectors import argmax
    from gridwright.operators.evaluate import evaluate

    return rounded(evaluate(proba(spark, sf).withColumn("y_pred", argmax(F.col("proba"))), "classification"))
