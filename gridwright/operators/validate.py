"""Table validation: rules produce rows of an issues frame (severity, code, column, message)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import dtype_family, numeric_columns, present, scalar_columns
from gridwright.operators.outlier import iqr_bounds
from gridwright.operators.profile import column_rows
from gridwright.operators.schema import coerce, column_set_issues, issues_frame


class ValidationFailed(ValueError):
    """Raised in strict mode when an error-level issue exists."""


@dataclass(frozen=True)
class Rules:
    min_rows: int = 1
    max_rows: int | None = None
    min_columns: int = 1
    max_columns: int | None = None
    expected_columns: tuple[str, ...] | None = None
    expected_dtypes: dict = field(default_factory=dict)
    allow_extra_columns: bool = True
    missing_threshold: float = 0.3
    outlier_threshold: float = 0.1


@dataclass(frozen=True)
class Report:
    valid: bool
    has_errors: bool
    issues: DataFrame


def structure_issues(df: DataFrame, rules: Rules) -> DataFrame:
    k = len(df.columns)
    fixed = []
    if k < rules.min_columns:
        fixed.append(("error", "too_few_columns", "", f"{k} columns"))
    if rules.max_columns is not None and k > rules.max_columns:
        fixed.append(("error", "too_many_columns", "", f"{k} columns"))
    n = F.col("n")
    checks = [F.when(n == 0, F.lit("empty")), F.when(n < rules.min_rows, F.lit("too_few_rows"))]
    if rules.max_rows is not None:
        checks.append(F.when(n > rules.max_rows, F.lit("too_many_rows")))
    rows = df.agg(F.count("*").alias("n")).select(
        F.lit("error").alias("severity"),
        F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("code"),
        F.lit("").alias("column"),
        F.concat(n.cast("string"), F.lit(" rows")).alias("message"),
    )
    return issues_frame(df.sparkSession, fixed).unionByName(rows)


def dtype_issues(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Wrong dtype family: a warning when every value converts, an error otherwise."""
    family = {"int": "integer", "float": "float", "datetime": "datetime", "bool": "boolean", "string": "string"}
    wrong = [
        c for c, t in expected.items()
        if c in df.columns and dtype_family(df.schema[c].dataType) != family[t]
    ]
    if not wrong:
        return issues_frame(df.sparkSession, [])
    bad = lambda c: F.count_if(F.col(c).isNotNull() & coerce(F.col(c), expected[c]).isNull())
    rows = column_rows(df, wrong, {"n_bad": bad})
    ok = F.col("n_bad") == 0
    return rows.select(
        F.when(ok, "warning").otherwise("error").alias("severity"),
        F.when(ok, "dtype_convertible").otherwise("dtype_mismatch").alias("code"),
        "column",
        F.concat(F.col("n_bad").cast("string"), F.lit(" values do not convert")).alias("message"),
    )


def outlier_counts(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """(column, n_present, n_outliers) by the IQR rule; fewer than 4 values or IQR 0 gives 0."""
    nums = numeric_columns(df)
    bounds = iqr_bounds(df, nums, factor)

    def outside(c):
        lo, hi = bounds[c]
        x = present(df, c)
        # IQR 0 shows as lo == hi
        if lo is None or lo == hi:
            return F.count_if(F.lit(False))
        return F.when(F.count(x) >= 4, F.count_if((x < lo) | (x > hi))).otherwise(0)

    return column_rows(df, nums, {"n_present": lambda c: F.count(present(df, c)), "n_outliers": outside})


def quality_issues(df: DataFrame, rules: Rules) -> DataFrame:
    """Missing share, outlier share and constant columns."""
    cols = scalar_columns(df)
    facts = column_rows(
        df,
        cols,
        {
            "n": lambda c: F.count(F.lit(1)),
            "n_missing": lambda c: F.count_if(present(df, c).isNull()),
            "constant": lambda c: F.coalesce(F.min(present(df, c)) == F.max(present(df, c)), F.lit(True)),
        },
    ).withColumn("n_outliers", F.lit(0).cast("long"))
    if numeric_columns(df):
        out = outlier_counts(df).select("column", F.col("n_outliers").alias("o"))
        facts = facts.join(out, "column", "left").withColumn("n_outliers", F.coalesce("o", F.lit(0)))
    miss = F.col("n_missing") / F.when(F.col("n") > 0, F.col("n"))
    outl = F.col("n_outliers") / F.when(F.col("n") > 0, F.col("n"))
    found = F.array(
        F.when(miss > rules.missing_threshold, F.lit("error:excessive_missing")).when(
            miss > 0.1, F.lit("warning:moderate_missing")
        ),
        F.when(outl > rules.outlier_threshold, F.lit("error:excessive_outliers")).when(
            outl > 0.05, F.lit("warning:moderate_outliers")
        ),
        F.when(F.col("constant"), F.lit("warning:constant_column")),
    )
    hit = facts.select(
        "column", "n_missing", "n_outliers", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")
    )
    return hit.select(
        F.split("f", ":")[0].alias("severity"),
        F.split("f", ":")[1].alias("code"),
        "column",
        F.concat(
            F.lit("missing "), F.col("n_missing").cast("string"), F.lit(", outliers "),
            F.col("n_outliers").cast("string"),
        ).alias("message"),
    )


def all_issues(df: DataFrame, rules: Rules) -> DataFrame:
    out = structure_issues(df, rules)
    if rules.expected_columns is not None:
        out = out.unionByName(column_set_issues(df, rules.expected_columns, rules.allow_extra_columns))
    if rules.expected_dtypes:
        out = out.unionByName(dtype_issues(df, rules.expected_dtypes))
    if df.columns:
        out = out.unionByName(quality_issues(df, rules))
    return out


def validate(df: DataFrame, rules: Rules = Rules(), strict: bool = False) -> Report:
    """Run every rule. `valid` only turns false when validation itself cannot run (no columns);
    rule errors are reported through `has_errors`, and raise in strict mode."""
    if not df.columns:
        if strict:
            raise ValidationFailed("table has no columns")
        return Report(False, True, structure_issues(df, rules))
    issues = all_issues(df, rules)
    errors = issues.where("severity = 'error'").select("code", "column").collect()  # one row a column and rule
    if errors and strict:
        raise ValidationFailed("; ".join(f"{r['code']} {r['column']}".strip() for r in errors))
    return Report(True, bool(errors), issues)
