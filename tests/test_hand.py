"""Small frames with hand-computed answers."""

import math

import pytest
from pyspark.sql import functions as F

from gridwright.operators import (
    augment, classification, encode, impute, outlier, regression, scale, schema, scoring, semantics, sequence,
    significance, tokenize, types, validate,
)
from gridwright.plans import prepare
from gridwright.sources import sinks


def frame(spark, rows, schema_):
    return spark.createDataFrame(rows, schema_)


@pytest.fixture(scope="module")
def f13(spark):
    return frame(spark, [(i + 1, v) for i, v in enumerate([1, 2, 3, 4, 1000])], "normal_col long, outlier_col long")


def test_iqr(f13):
    assert outlier.iqr_bounds(f13, ["outlier_col"]) == {"outlier_col": (-1.0, 7.0)}
    assert outlier.clip(f13, {"outlier_col": (-1.0, 7.0)}).agg(F.max("outlier_col")).first()[0] == 7.0
    got = {r["column"]: r["n_outliers"] for r in validate.outlier_counts(f13).collect()}
    assert got == {"normal_col": 0, "outlier_col": 1}


def test_fill(spark):
    df = frame(spark, [(1.0, "a"), (2.0, "b"), (None, None), (4.0, "d"), (5.0, "e")], "n double, c string")
    assert impute.recovery_values(df) == {"n": 3.0, "c": "a"}
    assert impute.fit_fill(df, {"n": "knn"}) == {"n": 3.0}
    empty = df.select(F.lit(None).cast("string").alias("c"))
    assert impute.recovery_values(empty) == {"c": "unknown"}


def test_robust_and_frequency(spark):
    df = frame(spark, [(1, "a", 0), (2, "b", 1), (3, "a", 0), (4, "b", 1), (5, "c", 0)], "n long, c string, t int")
    scaled = scale.apply_scaler(df, scale.fit_scaler(df, ["n"], "robust"))
    assert sorted(r["n"] for r in scaled.collect()) == [-1.0, -0.5, 0.0, 0.5, 1.0]
    freq = {r["key"]: r["value"] for r in encode.frequency_mapping(df, "c").collect()}
    assert freq == {"a": 2, "b": 2, "c": 1}
    test = frame(spark, [("a",), ("z",)], "c string")
    coded = encode.encode_category(df, test, "c", "frequency", "x", unseen="most_frequent")
    assert {r["c"]: r["x"] for r in coded.collect()} == {"a": 2, "z": 2}
    with pytest.raises(encode.UnseenCategory):
        encode.encode_category(df, test, "c", "label", "x", unseen="error")
    zero = scale.fit_scaler(df.withColumn("n", F.lit(4.0)), ["n"])
    assert zero == {"n": (4.0, 1.0)}


def test_vocabulary(spark):
    train = frame(spark, [("A",), ("B",), ("A",)], "value string")
    vocab = encode.vocabulary(train, "value")
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids == {"<MASK>": 0, "<UNK>": 1, "A": 2, "B": 3}
    test = frame(spark, [("A",), ("C",)], "value string")
    got = {r["value"]: r["i"] for r in encode.encode_vocabulary(test, "value", vocab, "i").collect()}
    assert got == {"A": 2, "C": 1}
    many = spark.range(1000).select(F.concat(F.lit("cat_"), "id").alias("value"))
    assert encode.vocabulary(many, "value", 100).count() == 100
    with_null = frame(spark, [("A",), (None,)], "value string")
    assert "NaN" in {r["token"] for r in encode.vocabulary(with_null, "value").collect()}


def test_cyclic_date(spark):
    df = frame(spark, [("2023-01-01",), (None,)], "d string").select(F.col("d").cast("timestamp").alias("d"))
    v = [r["v"] for r in df.select(encode.cyclic_datetime(F.col("d"), (2023.0, 1.0)).alias("v")).collect()]
    assert v[0][1:5] == pytest.approx([0, 1, 0, 1]) and v[1] == [0.0] * 9
    wide = encode.expand_datetime(df.where("d is not null"), "d").first()
    assert wide["d_dayofweek"] == 6 and len(wide) == 9


def test_bins(spark):
    df = frame(spark, [(x,) for x in (0.0, 1.0, 2.5, 4.0, 9.0, None)], "x double")
    got = [r[0] for r in df.select(encode.bin_id(F.col("x"), [0.0, 1.0, 1.0, 4.0])).collect()]
    assert got == [0, 2, 2, 2, 2, 3]


def test_types(spark):
    df = frame(spark, [("yes", "2023-1-5", 1, None), ("No", "2023-12-31", 0, None)], "b string, d string, z int, n string")
    assert types.infer_types(df) == {"b": "boolean", "d": "datetime", "z": "boolean", "n": "unknown"}
    odd = frame(spark, [("2023-01-05",), ("5/1/2023",)], "d string")
    assert types.infer_types(odd) == {"d": "categorical"}  # no single format fits


def test_validation(spark):
    df = frame(spark, [(1.0, "a"), (None, "b"), (None, "c"), (None, "d"), (5.0, "e")], "col1 double, col2 string")
    rep = validate.validate(df, validate.Rules(expected_columns=("col1", "col2", "col3")))
    codes = {(r["code"], r["column"]) for r in rep.issues.collect()}
    assert rep.valid and rep.has_errors and {("missing_column", "col3"), ("excessive_missing", "col1")} <= codes
    with pytest.raises(validate.ValidationFailed):
        validate.validate(df, validate.Rules(expected_columns=("col3",)), strict=True)
    ok = frame(spark, [(i, f"s{i}", float(i)) for i in range(5)], "a long, b string, c double")
    assert not validate.validate(ok).has_errors
    empty = ok.where("false")
    assert validate.validate(empty).has_errors


def test_repair(spark):
    df = frame(spark, [(1,), (2,), (3,)], "col1 long")
    out, log = prepare.repair(df, ["col1", "col2", "col3"])
    assert out.columns == ["col1", "col2", "col3"]
    assert {r["column"] for r in log.where("action = 'added_column'").collect()} == {"col2", "col3"}
    dirty = frame(spark, [("1", 0), ("invalid", 1), ("1000", 0), ("2", 1), ("3", 0), (None, None)], "m string, target int")
    fixed, _ = prepare.repair(dirty, expected_dtypes={"m": "float"}, target="target")
    assert fixed.count() == 5 and fixed.where("m is null").count() == 0


def test_prepare_round_trip(spark, tmp_path):
    df = frame(spark, [(i, float(i % 25), "ab"[i % 2], 7.0) for i in range(100)], "k long, x double, c string, one double")
    fitted = prepare.fit_prepare(df, ["k"])
    assert fitted.constant == ["one"] and fitted.types["x"] == "numerical"
    fitted.save(spark, str(tmp_path / "p"))
    again = prepare.Prepared.load(spark, str(tmp_path / "p"))
    a, b = (sorted(map(tuple, m.transform(df).collect())) for m in (fitted, again))
    assert a == b and len(a) == 100


def test_coercion(spark):
    df = frame(spark, [("1", "1.5", "t"), ("x", "y", "maybe")], "i string, f string, b string")
    out = schema.coerce_columns(df, {"i": "int", "f": "float", "b": "bool"}).collect()
    assert [tuple(r) for r in out] == [(1, 1.5, True), (None, None, None)]


def test_time_column(spark):
    df = frame(spark, [(1, "2023-01-01", 5)], "id long, timestamp string, value long")
    assert sequence.detect_time_column(df) == "timestamp"
    assert sequence.detect_time_column(df.drop("timestamp")) is None
    assert sequence.ordering_columns(df.drop("timestamp"), "auto", ["id"]) == ["id"]


def test_sequences_of_two_customers(spark):
    df = frame(spark, [(c, d, 10 * c + d) for c in (1, 2) for d in (1, 2, 3)], "c int, d int, v int")
    out = sequence.sequences(df, ["c"], ["d"], ["v"], "v", 2, 1).collect()
    assert sorted((r["c"], [s["v"] for s in r["sequence"]], r["target"]) for r in out) == [(1, [11, 12], 13), (2, [21, 22], 23)]
    assert sequence.sequences(df, ["c"], ["d"], ["v"], "v", 5, 1).count() == 0


def test_classification(spark):
    t, p = [0, 1, 0, 1, 0, 1], [0, 1, 1, 1, 0, 0]
    df = frame(spark, list(zip(t, p)), "y_true int, y_pred int")
    m = classification.classification_metrics(df, "binary").first()
    assert m["accuracy"] == pytest.approx(4 / 6) and m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3)


def test_regression(spark):
    y, p = [1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 1.9, 3.2, 3.8, 5.1]
    df = frame(spark, list(zip(y, p)), "y_true double, y_pred double")
    m = regression.regression_metrics(df).first()
    assert m["mse"] == pytest.approx(0.022) and m["mae"] == pytest.approx(0.14) and m["r2"] == pytest.approx(0.989)


def test_significance(spark):
    a, b = [0.9, 0.8, 0.85, 0.95, 0.7], [0.8, 0.75, 0.8, 0.85, 0.72]
    df = frame(spark, list(zip(a, b)), "a double, b double")
    t = significance.paired_t(df, "a", "b")
    d = [x - y for x, y in zip(a, b)]
    mean = sum(d) / 5
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 4)
    assert t["statistic"] == pytest.approx(mean / (sd / math.sqrt(5)))
    # t distribution with 1 degree of freedom is Cauchy: two-sided p at t = 1 is one half
    from gridwright.functions.special import student_two_sided

    assert student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-6)
    assert student_two_sided(2.776445, 4) == pytest.approx(0.05, abs=1e-5)
    assert significance.wilcoxon(df, "a", "b")["n"] == 5


def test_masking_rates(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.array(*[F.lit(1.0)] * 10).alias("x"), F.array(*[F.lit(1)] * 9, F.lit(0)).alias("m"))
    out = augment.mask_independent(df, ["k"], 0.15)
    share = out.select(F.explode(F.slice("mask", 1, 9)).alias("v")).agg(F.avg("v")).first()[0]
    assert abs(share - 0.15) < 3 * math.sqrt(0.15 * 0.85 / 36000)
    assert out.agg(F.max(F.col("mask")[9])).first()[0] == 0
    one = augment.mask_cells(df, ["k"], 0.15).select(F.aggregate("mask", F.lit(0), lambda s, v: s + v).alias("n"))
    assert one.agg(F.min("n"), F.max("n")).first()[:] == (1, 1)
    a, b = (sorted(map(str, augment.mask_cells(df.repartition(n), ["k"], 0.3).select("k", "masked").collect())) for n in (1, 9))
    assert a == b


def test_forward_fill_augmentation(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.array(*[F.lit(float(i)) for i in range(1, 6)]).alias("x"), F.array(*[F.lit(1)] * 5).alias("m"))
    out = augment.simulate_missing(df, ["k"], 0.5, "forward", probability=1.0)
    for r in out.collect():
        assert all(b >= a for a, b in zip(r["x"], r["x"][1:]))


def test_tokens_and_absent_feature(spark):
    df = frame(spark, [(i, f"c{i % 3}", float(i)) for i in range(30)], "k int, c string, x double")
    fitted = tokenize.fit_tokenizer(df, ["x", "c"], 5)
    row = fitted.transform(df.drop("x")).first()["tokens"]
    assert [t["present"] for t in row] == [False, True]
    with pytest.raises(ValueError):
        tokenize.fit_tokenizer(df, [])


def test_fallback(spark):
    df = frame(spark, [(1.0, 9.0), (None, 2.0), (float("nan"), None)], "a double, b double")
    out = scoring.with_fallback(df, F.col("a"), F.col("b")).collect()
    assert [(r["prediction"], r["source"]) for r in out] == [(1.0, "primary"), (2.0, "fallback"), (0.0, "constant")]


def test_domains(spark):
    cols = spark.createDataFrame([("customer_id",), ("total_amount",), ("order_date",), ("zzz",)], "column string")
    got = {r["column"]: r["domain"] for r in semantics.with_domain(cols).collect()}
    assert got["total_amount"] == "finance" and got["order_date"] == "temporal" and got["zzz"] == "unknown"


def test_safe_name():
    assert sinks.safe_name("a b/c-1_x.csv") == "a_b_c-1_x_csv"
