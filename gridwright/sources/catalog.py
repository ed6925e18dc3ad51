"""Data set catalogue: an append-only Parquet table; the last write of a name wins."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.sources import generators
from gridwright.sources.readers import load_auto

log = logging.getLogger(__name__)

SCHEMA = (
    "name string, source string, path string, description string, task_type string, target string, "
    "n_rows long, n_columns int, metadata string, deleted boolean, version long"
)


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _history(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def _append(self, rows: list[tuple]) -> None:
        at = (self._history().agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(*r, at) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def register(self, name: str, source: str, path: str, **meta) -> None:
        known = ("description", "task_type", "target", "n_rows", "n_columns")
        rest = {k: v for k, v in meta.items() if k not in known}
        self._append([(name, source, path, *[meta.get(k) for k in known], json.dumps(rest, sort_keys=True), False)])

    def register_many(self, entries: Sequence[dict]) -> None:
        known = ("description", "task_type", "target", "n_rows", "n_columns")
        self._append([
            (e["name"], e["source"], e["path"], *[e.get(k) for k in known],
             json.dumps({k: v for k, v in e.items() if k not in (*known, "name", "source", "path")}, sort_keys=True), False)
            for e in entries
        ])

    def remove(self, name: str) -> None:
        """Tombstone row."""
        self._append([(name, None, None, None, None, None, None, None, "{}", True)])

    def entries(self) -> DataFrame:
        cols = [c for c in self._history().columns if c != "name"]
        last = self._history().groupBy("name").agg(F.max_by(F.struct(*cols), "version").alias("r"))
        return last.select("name", "r.*").where(~F.col("deleted")).drop("deleted", "version")

    def get(self, name: str):
        row = self.entries().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return row

    def search(self, text: str) -> DataFrame:
        """Case-insensitive substring of name or description."""
        low = F.lit(text.lower())
        hit = F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("description", F.lit(""))), low)
        return self.entries().where(hit)

    def by_task(self, task: str) -> DataFrame:
        return self.entries().where(F.col("task_type") == task)

    def load(self, name: str) -> DataFrame:
        return load_auto(self.spark, self.get(name)["path"])

    def load_many(self, names: Sequence[str] | None = None, task: str | None = None, fallback: bool = True) -> dict[str, tuple[DataFrame, str]]:
        """{name: (table, target)}; the last column is the target unless registered. What cannot be read
        is replaced by a generated table of the registered shape, or skipped."""
        chosen = self.entries()
        if names is not None:
            chosen = chosen.where(F.col("name").isin(list(names)))
        if task is not None:
            chosen = chosen.where(F.col("task_type") == task)
        out = {}
        for e in chosen.orderBy("name").collect():
            try:
                df = load_auto(self.spark, e["path"])
                out[e["name"]] = (df, e["target"] or df.columns[-1])
            except Exception as err:
                log.warning("%s: %s", e["name"], err)
                if fallback and e["n_rows"] and e["n_columns"]:
                    ids = self.spark.range(e["n_rows"])
                    make = generators.regression if e["task_type"] == "regression" else generators.classification
                    out[e["name"]] = (make(ids, "id", n_features=e["n_columns"] - 1), "target")
        return out
