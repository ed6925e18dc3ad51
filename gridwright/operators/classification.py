"""Classification metrics as aggregates over a predictions frame (y_true, y_pred, proba)."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.statistics import ratio
from gridwright.functions.vectors import argmax, fold_sum, sigmoid, softmax, top_k_indices
from gridwright.plans.ordered import prefix_sums


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Long confusion matrix; at most classes^2 rows after partial aggregation."""
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence) -> DataFrame:
    """One row per true class, one column per predicted label."""
    return confusion(df).groupBy("y_true").pivot("y_pred", list(labels)).agg(F.sum("n")).na.fill(0)


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts."""
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    rows = counts.select(F.posexplode(sides).alias("i", "s"), hit.alias("hit")).select(
        "s.*", F.when(F.col("i") == 0, F.col("hit")).otherwise(0).alias("tp")
    )
    base = rows.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    p = ratio(F.col("tp"), F.col("predicted"))
    r = ratio(F.col("tp"), F.col("support"))
    return base.select(
        "label", "support", "tp", "predicted", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")
    )


def classification_metrics(df: DataFrame, average: str = "weighted", positive=1) -> DataFrame:
    """accuracy, precision, recall, f1; average: weighted, macro or binary (undefined values are 0)."""
    classes = per_class(confusion(df))
    n = F.sum("support")
    acc = F.sum("tp") / n
    if average == "binary":
        pick = lambda c: F.coalesce(F.max(F.when(F.col("label") == positive, F.col(c))), F.lit(0.0))
    elif average == "macro":
        pick = lambda c: F.avg(c)
    else:
        pick = lambda c: F.sum(F.col(c) * F.col("support")) / n
    return classes.agg(
        acc.alias("accuracy"), pick("precision").alias("precision"), pick("recall").alias("recall"), pick("f1").alias("f1")
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted rows, with support."""
    rows = per_class(confusion(df))
    cols = ["precision", "recall", "f1"]
    each = rows.select(F.col("label").cast("string").alias("label"), *cols, "support")
    n = F.sum("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in cols], n.alias("support")).select(F.lit("macro avg").alias("label"), *cols, "support")
    weighted = rows.agg(*[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in cols], n.alias("support")).select(
        F.lit("weighted avg").alias("label"), *cols, "support"
    )
    acc = rows.agg((F.sum("tp") / n).alias("a"), n.alias("support")).select(
        F.lit("accuracy").alias("label"), *[F.col("a").alias(c) for c in cols], "support"
    )
    return each.unionByName(macro).unionByName(weighted).unionByName(acc)


def score_table(df: DataFrame, score: Column, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with positive and negative counts and their running sums, highest first."""
    counts = df.groupBy(*by, score.alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return prefix_sums(
        counts, list(by), [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")},
        totals={"tp": "P", "fp": "N"},
    )


def ranking_areas(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties count half) and average precision of a score table."""
    below = F.col("N") - F.col("fp") + F.col("neg") / 2.0
    step = F.col("pos") / F.when(F.col("P") > 0, F.col("P"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = F.sum(F.col("pos") * below) / F.when((F.max("P") > 0) & (F.max("N") > 0), F.max("P") * F.max("N"))
    return table.groupBy(*by).agg(area.alias("roc_auc"), F.sum(step * precision).alias("average_precision"), F.max("P").alias("support"))


def binary_areas(df: DataFrame, score: str, y_true: str = "y_true") -> DataFrame:
    return ranking_areas(score_table(df, F.col(score), F.col(y_true) == 1)).drop("support")


def one_vs_rest_areas(df: DataFrame, proba: str = "proba", y_true: str = "y_true") -> DataFrame:
    """Per class AUC and average precision from a probability array."""
    long = df.select(y_true, F.posexplode(proba).alias("label", "p"))
    table = score_table(long, F.col("p"), F.col(y_true) == F.col("label"), ["label"])
    return ranking_areas(table, ["label"])


def multiclass_areas(df: DataFrame, proba: str = "proba", y_true: str = "y_true") -> DataFrame:
    """Support-weighted one-vs-rest AUC and macro average precision."""
    rows = one_vs_rest_areas(df, proba, y_true).where("support > 0")
    auc = F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")
    return rows.agg(auc.alias("roc_auc"), F.avg("average_precision").alias("average_precision"))


def log_loss(df: DataFrame, proba: str = "proba", y_true: str = "y_true") -> DataFrame:
    eps = sys.float_info.epsilon
    p = F.element_at(proba, F.col(y_true).cast("int") + 1)
    return df.agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))).alias("log_loss"))


def threshold_metrics(df: DataFrame, score: str, y_true: str = "y_true", threshold: float = 0.5) -> DataFrame:
    t, p = F.col(y_true) == 1, F.col(score) > threshold
    base = df.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec, rec, spec = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return base.select(
        "*", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        ratio(2 * prec * rec, prec + rec).alias("f1"), spec.alias("specificity"), ((rec + spec) / 2).alias("balanced_accuracy"),
    )


def multiclass_metrics(df: DataFrame, proba: str = "proba", y_true: str = "y_true") -> DataFrame:
    """Accuracy, macro P/R/F1 over classes present in the targets, top-3 and top-5 accuracy."""
    work = df.select(F.col(y_true).cast("int").alias("y_true"), argmax(F.col(proba)).alias("y_pred"), proba)
    classes = per_class(confusion(work)).where("support > 0")
    macro = classes.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")
    )
    in_top = lambda k: F.avg(F.array_contains(top_k_indices(F.col(proba), k), F.col("y_true")).cast("double"))
    tops = work.agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        in_top(3).alias("top3_accuracy"), in_top(5).alias("top5_accuracy"),
    )
    # two one-row results side by side
    return macro.withColumn("__k", F.lit(1)).join(tops.withColumn("__k", F.lit(1)), "__k").drop("__k")


def multilabel_metrics(df: DataFrame, y_true: str = "labels", score: str = "scores", threshold: float = 0.5) -> DataFrame:
    """Hamming loss, subset accuracy, micro and macro precision/recall/F1."""
    pred = F.transform(F.col(score), lambda x: (x > threshold).cast("int"))
    wrong = F.aggregate(
        F.zip_with(F.col(y_true), pred, lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, x: s + x
    )
    rows = df.select(y_true, pred.alias("pred"), wrong.alias("wrong"))
    whole = rows.agg(
        (F.sum("wrong") / F.sum(F.size(y_true))).alias("hamming_loss"), F.avg((F.col("wrong") == 0).cast("double")).alias("subset_accuracy")
    )
    cells = rows.select(F.posexplode(F.arrays_zip(F.col(y_true).alias("t"), F.col("pred").alias("p"))).alias("label", "z"))
    t, p = F.col("z.t") == 1, F.col("z.p") == 1
    by_label = cells.groupBy("label").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )
    prf = lambda tp, fp, fn: (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn))
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    per = by_label.select("*", *[e.alias(n) for e, n in zip(prf(*c), ("p", "r", "f"))])
    micro = prf(*[F.sum(x) for x in c])
    out = per.agg(
        *[e.alias(f"micro_{n}") for e, n in zip(micro, ("precision", "recall", "f1"))],
        F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"),
    )
    return whole.withColumn("__k", F.lit(1)).join(out.withColumn("__k", F.lit(1)), "__k").drop("__k")


def postprocess(df: DataFrame, logits: str, task: str = "multiclass", temperature: float = 1.0) -> DataFrame:
    """Label and probabilities from logits: softmax + argmax, or sigmoid + 0.5 for binary/multilabel."""
    z = F.col(logits)
    if task == "multiclass":
        return df.withColumn("proba", softmax(z, temperature)).withColumn("label", argmax(F.col("proba")))
    proba = F.transform(z, lambda x: sigmoid(x / temperature))
    out = df.withColumn("proba", proba)
    if task == "binary":
        return out.withColumn("label", (F.col("proba")[0] > 0.5).cast("int"))
    return out.withColumn("label", F.transform("proba", lambda x: (x > 0.5).cast("int")))


def weighted_cross_entropy(
    df: DataFrame, class_weights: Sequence[float], proba: str = "proba", y_true: str = "y_true", smoothing: float = 0.0
) -> DataFrame:
    """Class-weighted cross-entropy with label smoothing over stored probabilities."""
    w = F.array(*[F.lit(float(x)) for x in class_weights])
    k = len(class_weights)
    y = F.col(y_true).cast("int")
    nll = F.transform(F.col(proba), lambda p: -F.log(F.greatest(p, F.lit(1e-12))))
    own = w[y] * nll[y]
    spread = fold_sum(F.zip_with(w, nll, lambda a, b: a * b)) / k
    return df.agg(
        (F.sum((1 - smoothing) * own + smoothing * spread) / F.sum(w[y])).alias("loss")
    )


def weighted_binary_cross_entropy(df: DataFrame, positive_weights: Sequence[float], labels: str = "labels", scores: str = "scores") -> DataFrame:
    """Mean binary cross-entropy over rows and labels, positives weighted per label."""
    w = F.array(*[F.lit(float(x)) for x in positive_weights])
    cells = df.select(F.posexplode(F.arrays_zip(F.col(labels).alias("t"), F.col(scores).alias("p"), w.alias("w"))).alias("i", "z"))
    p = F.least(F.greatest(F.col("z.p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    t = F.col("z.t")
    return cells.agg(F.avg(-(F.col("z.w") * t * F.log(p) + (1 - t) * F.log(1 - p))).alias("loss"))
