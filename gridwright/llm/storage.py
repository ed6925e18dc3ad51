"""Intermediate tables of this subpackage, in the folder the session names for checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridwright.plans.storage import scratch_path, shared_dir


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Written as Parquet and read again: the lineage ends here, lost executors repeat nothing before it, and the
    optimizer knows the table's size, so that only tables below the broadcast threshold are broadcast. ``parts``: at most so many
    files, for a table whose size is known to be small."""
    df = df if parts is None else df.coalesce(parts)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote. Only after the last job that reads them, and what comes after is stored itself."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = hadoop(folder)
            if hadoop(shared_dir(spark)).getName() == path.getParent().getName():
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
