"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``, else the session's warehouse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_READY: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the session's shared one, removed when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    key = (spark.sparkContext.applicationId, base)
    if key not in _READY:
        jvm = spark.sparkContext._jvm
        folder = f"{base.rstrip('/')}/gridwright-{key[0]}-{uuid.uuid4().hex[:8]}"
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _READY[key] = folder
    return _READY[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and fixes the rows each partition holds."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read again, for tables that several jobs read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
