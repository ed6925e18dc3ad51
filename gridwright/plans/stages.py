"""The fitted operators as stages of a ``pyspark.ml`` pipeline: fit, save, load, transform.

An estimator keeps its options, a model what was fitted, as JSON in a parameter; tables of codes are written as Parquet in the
model's folder. Both are saved and loaded by Spark's own pipeline writer.

    model = Pipeline(stages=[Fill(strategies={"age": "median"}), Scale(cols=["age"])]).fit(df)
    model.write().overwrite().save(path)
    PipelineModel.load(path).transform(other)
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from gridwright.operators import encode, impute, scale
from gridwright.plans import prepare


class _Estimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    options = Param(Params._dummy(), "options", "options as JSON", TypeConverters.toString)

    def __init__(self, **options):
        super().__init__()
        self._set(options=json.dumps(options))

    def option(self, name: str, default=None):
        return json.loads(self.getOrDefault(self.options)).get(name, default)


class _Model(Model, DefaultParamsReadable, DefaultParamsWritable):
    fitted = Param(Params._dummy(), "fitted", "what was fitted, as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, **fitted):
        model = cls()
        model._set(fitted=json.dumps(fitted))
        return model

    def part(self, name: str):
        return json.loads(self.getOrDefault(self.fitted))[name]


# ---------------------------------------------------------------- filling and scaling


class Fill(_Estimator):
    """Fills missing cells; ``strategies``: column -> mean, median, mode, knn or constant."""

    def _fit(self, df: DataFrame) -> "FillModel":
        return FillModel.of(values=impute.fit_fill(df, self.option("strategies", {})))


class FillModel(_Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        return impute.apply_fill(df, {c: v for c, v in self.part("values").items() if c in df.columns})


class Scale(_Estimator):
    """``cols`` by ``method``: standard, minmax or robust."""

    def _fit(self, df: DataFrame) -> "ScaleModel":
        null_as_zero = self.option("null_as_zero", False)
        return ScaleModel.of(scaler=scale.fit_scaler(df, self.option("cols", []), self.option("method", "standard"), null_as_zero), null_as_zero=null_as_zero)


class ScaleModel(_Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        return scale.apply_scaler(df, {c: tuple(v) for c, v in self.part("scaler").items() if c in df.columns}, self.part("null_as_zero"))


# ---------------------------------------------------------------- encoding


class Bins(_Estimator):
    """{col}_bin and {col}_scaled of ``cols``: ``n_bins`` bins by quantiles, or of one width (``kind`` = uniform)."""

    def _fit(self, df: DataFrame) -> "BinsModel":
        cols = self.option("cols", [])
        edges = (encode.uniform_edges if self.option("kind") == "uniform" else encode.quantile_edges)(df, cols, self.option("n_bins", 100))
        edges = {c: e for c, e in edges.items() if e[0] is not None}
        return BinsModel.of(edges=edges, scaler=scale.fit_scaler(df, list(edges), self.option("method", "standard")))


class BinsModel(_Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        return encode.encode_numbers(df, self.part("edges"), scaler={c: tuple(v) for c, v in self.part("scaler").items()})


class _TablesWriter(MLWriter):
    """Metadata as Spark writes it, and one folder of Parquet for each table of the model."""

    def __init__(self, model: "_TablesModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.getActiveSession())
        for i, name in enumerate(self.model.part("tables")):
            self.model.tables[name].write.parquet(f"{path}/tables/{i}")


class _TablesReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = {name: spark.read.parquet(f"{path}/tables/{i}") for i, name in enumerate(model.part("tables"))}
        return model


class _TablesModel(Model, MLWritable, MLReadable):
    """A model with tables of any size beside its numbers."""

    fitted = _Model.fitted

    def __init__(self):
        super().__init__()
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, tables: dict[str, DataFrame], **fitted):
        model = cls()
        model._set(fitted=json.dumps({"tables": list(tables), **fitted}))
        model.tables = tables
        return model

    part = _Model.part

    def copy(self, extra=None):
        out = super().copy(extra)
        out.tables = self.tables
        return out

    def write(self) -> MLWriter:
        return _TablesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TablesReader(cls)


class Category(_Estimator):
    """Codes of the categories of ``col`` in ``out``; ``method``: label, frequency or target (with ``target``); ``unseen``: ignore or
    most_frequent."""

    def _fit(self, df: DataFrame) -> "CategoryModel":
        col, method = self.option("col"), self.option("method", "label")
        fit = {"label": encode.label_mapping, "frequency": encode.frequency_mapping, "target": lambda d, c: encode.target_mapping(d, c, self.option("target"))}
        mapping = fit[method](df, col)
        default = encode.default_code(mapping, method, self.option("unseen", "ignore"))
        return CategoryModel.of({"codes": mapping}, col=col, out=self.option("out") or f"{col}_code", default=default)


class CategoryModel(_TablesModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return encode.lookup(df, self.part("col"), self.tables["codes"], self.part("out"), self.part("default"))


# ---------------------------------------------------------------- whole preparations


class Prepare(_Estimator):
    """`prepare.fit_prepare`; ``key_cols``, and ``config``: fields of `prepare.PrepareConfig`."""

    def _fit(self, df: DataFrame) -> "PrepareModel":
        config = prepare.PrepareConfig(**self.option("config", {}))
        return PrepareModel.of(prepared=asdict(prepare.fit_prepare(df, self.option("key_cols", []), config)))


class PrepareModel(_Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        return prepare.Prepared.from_record(self.part("prepared")).transform(df)


class Normalize(_Estimator):
    """`prepare.fit_robust`; ``target``, ``exclude``, and ``config``: fields of `prepare.RobustConfig`."""

    def _fit(self, df: DataFrame) -> "NormalizeModel":
        config = prepare.RobustConfig(**self.option("config", {}))
        fitted = prepare.fit_robust(df, config, self.option("target"), self.option("exclude", []))
        record = {k: getattr(fitted, k) for k in ("numeric", "categorical", "datetime", "fill", "bounds", "scaler", "categories", "defaults")}
        return NormalizeModel.of(fitted.mappings, config=asdict(config), record=record)


class NormalizeModel(_TablesModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        record = self.part("record")
        pairs = {k: {c: tuple(v) for c, v in record[k].items()} for k in ("bounds", "scaler")}
        return prepare.RobustNormalizer(config=prepare.RobustConfig(**self.part("config")), mappings=self.tables, **(record | pairs)).transform(df)
