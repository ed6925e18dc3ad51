"""The three end-to-end preparation plans. `fit` runs a few aggregates and keeps driver-side
numbers; `transform` is one lazy projection (plus the de-duplication shuffle in batch)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.columns import numeric_columns, scalar_columns, string_columns
from gridwright.operators import encode, impute, outlier, scale, schema
from gridwright.operators.profile import column_rows, missing_count
from gridwright.operators.types import general_types, normalizer_types, type_facts
from gridwright.plans.quantiles import fit_quantiles
from gridwright.plans.storage import written


@dataclass(frozen=True)
class PrepareConfig:
    numeric_fill: str = "median"
    categorical_fill: str = "mode"
    outlier_method: str = "iqr"
    remove_outliers: bool = True
    scaling: str | None = "standard"
    drop_duplicates: bool = True
    drop_constant: bool = True
    null_as_zero: bool = False


@dataclass
class Prepared:
    """Fitted parameters; a plain record, so it can be stored and used by a stream."""

    config: PrepareConfig
    types: dict[str, str]
    constant: list[str]
    fill: dict[str, object]
    bounds: dict[str, tuple]
    scaler: dict[str, tuple]
    key_cols: list[str] = field(default_factory=list)

    def apply_row_wise(self, df: DataFrame) -> DataFrame:
        """The stateless part: drop constants, fill, scale. Safe on a stream."""
        out = df.drop(*self.constant)
        out = impute.apply_fill(out, {c: v for c, v in self.fill.items() if c in out.columns})
        return scale.apply_scaler(out, {c: v for c, v in self.scaler.items() if c in out.columns},
                                  self.config.null_as_zero)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.dropDuplicates() if self.config.drop_duplicates else df
        out = out.drop(*self.constant)
        out = impute.apply_fill(out, {c: v for c, v in self.fill.items() if c in out.columns})
        if self.config.remove_outliers and self.bounds:
            out = outlier.remove_multi_outliers(out, self.bounds, self.key_cols)
        return scale.apply_scaler(out, {c: v for c, v in self.scaler.items() if c in out.columns},
                                  self.config.null_as_zero)

    def feature_info(self, spark: SparkSession) -> DataFrame:
        rows = [(c, t) for c, t in self.types.items() if c not in self.constant]
        return spark.createDataFrame(rows, "column string, semantic_type string")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "params string").coalesce(1).write.text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Prepared":
        return Prepared.from_record(json.loads(spark.read.text(path).first()[0]))

    @staticmethod
    def from_record(raw: dict) -> "Prepared":
        pairs = {k: {c: tuple(v) for c, v in raw[k].items()} for k in ("bounds", "scaler")}
        return Prepared(**(raw | pairs | {"config": PrepareConfig(**raw["config"])}))


def fit_prepare(
    df: DataFrame, key_cols: Sequence[str], config: PrepareConfig = PrepareConfig(),
    feature_cols: Sequence[str] | None = None,
) -> Prepared:
    """Types, constants, fill values, outlier bounds and scalers, all fitted on the raw values of
    the de-duplicated table. Keys are carried through and never treated as features."""
    cols = [c for c in (feature_cols or scalar_columns(df)) if c not in key_cols]
    base = df
    if config.drop_duplicates:
        # the fit reads these columns several times; the de-duplication shuffle runs once, into the shared folder
        base = written(df.dropDuplicates().select(*cols), "distinct")
    facts = {r["column"]: r for r in general_types(type_facts(base, cols)).collect()}  # one row per column
    types = {c: facts[c]["semantic_type"] for c in cols if c in facts}
    constant = [c for c in types if facts[c]["n_unique"] <= 1] if config.drop_constant else []
    live = [c for c in types if c not in constant]
    texts = set(string_columns(df))
    nums = [c for c in live if types[c] == "numerical"]
    words = [c for c in live if types[c] in ("categorical", "boolean") and c in texts]
    flags = [c for c in live if types[c] == "boolean" and c not in texts]
    fill: dict[str, object] = {}
    bounds: dict[str, tuple] = {}
    if nums and config.numeric_fill == "median" and config.outlier_method == "iqr":
        q = fit_quantiles(base, nums, [0.25, 0.5, 0.75])
        fill = {c: v[1] for c, v in q.items()}
        bounds = {c: (a - 1.5 * (d - a), d + 1.5 * (d - a)) for c, (a, _, d) in q.items() if a is not None}
    elif nums:
        fill = impute.fit_fill(base, {c: config.numeric_fill for c in nums})
        bounds = outlier.fit_bounds(base, nums, config.outlier_method)
    fill |= impute.fit_fill(base, {c: config.categorical_fill for c in words} | {c: "mode" for c in flags})
    if not config.remove_outliers:
        bounds = {}
    bounds = {c: b for c, b in bounds.items() if b[0] is not None}
    scaler = scale.fit_scaler(base, nums, config.scaling, config.null_as_zero) if config.scaling else {}
    return Prepared(config, types, constant, fill, bounds, scaler, list(key_cols))


# ---------------------------------------------------------------- robust normalizer


@dataclass(frozen=True)
class RobustConfig:
    numeric_fill: str = "median"
    outlier_method: str = "iqr"
    outlier_action: str = "clip"
    scaling: str = "robust"
    categorical: str = "frequency"
    unseen: str = "ignore"


@dataclass
class RobustNormalizer:
    config: RobustConfig
    numeric: list[str]
    categorical: list[str]
    datetime: list[str]
    fill: dict[str, object]
    bounds: dict[str, tuple]
    scaler: dict[str, tuple]
    mappings: dict[str, DataFrame]
    categories: dict[str, list[str]]
    defaults: dict[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        out = impute.apply_fill(df, {c: v for c, v in self.fill.items() if c in df.columns})
        if self.config.outlier_action == "clip":
            out = outlier.clip(out, self.bounds)
        elif self.config.outlier_action == "remove":
            out = outlier.remove_outside(out, self.bounds)
        else:
            out = outlier.log_transform(out, self.numeric)
        out = scale.apply_scaler(out, self.scaler)
        for c in self.categorical:
            if self.config.categorical == "onehot":
                out = encode.one_hot(out, c, self.categories[c])
            else:
                coded = encode.lookup(out, c, self.mappings[c], f"__e_{c}", self.defaults[c])
                out = coded.select(
                    *[F.col(f"__e_{c}").alias(c) if x == c else F.col(x) for x in out.columns]
                )
        for c in self.datetime:
            out = encode.expand_datetime(out, c)
        return out

    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        for c in self.categorical:
            names += [f"{c}_{v}" for v in self.categories[c]] if self.config.categorical == "onehot" else [c]
        parts = ("year", "month", "day", "dayofweek", "hour", "month_sin", "month_cos", "day_sin", "day_cos")
        return names + [f"{c}_{p}" for c in self.datetime for p in parts]

    def action_log(self, df: DataFrame) -> DataFrame:
        """(step, column, n_cells): cells touched by filling and by the outlier action."""
        fills = impute.fill_log(df, self.fill).select(
            F.lit("fill").alias("step"), "column", F.col("n_filled").alias("n_cells")
        )
        if not self.bounds:
            return fills
        hit = column_rows(df, list(self.bounds), {"n_cells": lambda c: F.count_if(outlier.outside(df, c, self.bounds))})
        return fills.unionByName(hit.select(F.lit(self.config.outlier_action).alias("step"), "column", "n_cells"))


def fit_robust(
    df: DataFrame, config: RobustConfig = RobustConfig(), target: str | None = None,
    exclude: Sequence[str] = (),
) -> RobustNormalizer:
    cols = [c for c in scalar_columns(df) if c != target and c not in exclude]
    kinds = {r["column"]: r["semantic_type"] for r in normalizer_types(type_facts(df, cols)).collect()}
    nums = [c for c in cols if kinds[c] == "numerical"]
    cats = [c for c in cols if kinds[c] == "categorical"]
    dates = [c for c in cols if kinds[c] == "datetime"]
    fill = impute.fit_fill(df, {c: config.numeric_fill for c in nums} | {c: "mode" for c in cats})
    bounds = outlier.fit_bounds(df, nums, config.outlier_method) if nums else {}
    bounds = {c: b for c, b in bounds.items() if b[0] is not None and b[0] != b[1]}
    clean = impute.apply_fill(df, fill)
    if config.outlier_action == "clip":
        clean = outlier.clip(clean, bounds)
    elif config.outlier_action == "remove":
        clean = outlier.remove_outside(clean, bounds)
    scaler = scale.fit_scaler(clean, nums, config.scaling)
    mappings, categories, defaults = {}, {}, {}
    for c in cats:
        if config.categorical == "onehot":
            categories[c] = encode.fit_categories(clean, c)
            continue
        mappings[c] = (
            encode.target_mapping(clean, c, target) if config.categorical == "target"
            else encode.frequency_mapping(clean, c) if config.categorical == "frequency"
            else encode.label_mapping(clean, c)
        )
        defaults[c] = encode.default_code(mappings[c], config.categorical, config.unseen)
    return RobustNormalizer(config, nums, cats, dates, fill, bounds, scaler, mappings, categories, defaults)


def minimal_transform(df: DataFrame) -> DataFrame:
    """Last resort: numbers get 0, strings 'unknown'."""
    return impute.fill_constants(df, 0.0, "unknown")


# ---------------------------------------------------------------- repair


@dataclass(frozen=True)
class RepairConfig:
    numeric_fill: str = "median"
    outlier_action: str = "clip"
    outlier_factor: float = 1.5


def repair(
    df: DataFrame, expected_columns: Sequence[str] | None = None, expected_dtypes: dict[str, str] | None = None,
    target: str | None = None, config: RepairConfig = RepairConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Add/drop columns, coerce, fill, treat outliers, drop empty rows. Returns (table, log).

    All outlier bounds are measured on the filled table before any row is removed.
    """
    log: list[tuple[str, str, int]] = []
    out = df
    if expected_columns is not None:
        log += [("added_column", c, 1) for c in expected_columns if c not in df.columns]
        log += [("dropped_column", c, 1) for c in df.columns if c not in expected_columns and c != target]
        out = schema.align_columns(out, expected_columns, target)
    if expected_dtypes:
        wanted = {c: t for c, t in expected_dtypes.items() if c in out.columns}
        log += [("coerced", c, 1) for c in wanted]
        out = schema.coerce_columns(out, wanted)
    out = schema.drop_empty_rows(out)
    if target and target in out.columns:
        out = schema.drop_missing(out, [target])
    values = impute.recovery_values(out, config.numeric_fill, target)
    spark = df.sparkSession
    filled_log = None
    if values:
        filled_log = column_rows(out, list(values), {"n": missing_count(out)}).where("n > 0").select(
            F.lit("filled").alias("action"), "column", F.col("n").cast("long").alias("n")
        )
    out = impute.apply_fill(out, values)
    nums = [c for c in numeric_columns(out) if c != target]
    bounds = outlier.iqr_bounds(out, nums, config.outlier_factor) if nums else {}
    bounds = {c: b for c, b in bounds.items() if b[0] is not None and b[0] != b[1]}
    if config.outlier_action == "clip":
        out = outlier.clip(out, bounds)
    elif config.outlier_action == "remove":
        out = outlier.remove_outside(out, bounds)
    else:
        out = outlier.log_transform(out, list(bounds))
    log_df = spark.createDataFrame(log, "action string, column string, n long")
    return out, (log_df.unionByName(filled_log) if filled_log is not None else log_df)
