"""Request, latency, training and communication logs as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.operators.sequence import naive_next_row
from gridwright.plans.quantiles import MAX_DISTINCT, grouped_quantiles

# Response time buckets in milliseconds (the last one is open).
RESPONSE_BUCKETS = (10, 50, 100, 500, 1000, 5000, 10000)


def bucket(c: Column) -> Column:
    out = None
    for b in RESPONSE_BUCKETS:
        out = F.when(c <= b, str(b)) if out is None else out.when(c <= b, str(b))
    return out.otherwise("inf")


def request_metrics() -> list[Column]:
    """Aggregates over a request log (ok, response_ms, inference_ms); also used on streams."""
    n = F.count(F.lit(1))
    return [
        n.alias("total"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"),
        F.avg("response_ms").alias("mean_response_ms"), F.avg("inference_ms").alias("mean_inference_ms"),
    ]


def request_summary(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return requests.groupBy(*by).agg(*request_metrics())


def response_histogram(requests: DataFrame) -> DataFrame:
    return requests.groupBy(bucket(F.col("response_ms")).alias("bucket")).agg(F.count("*").alias("n"))


def latency_statistics(log: DataFrame, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """Latency per batch size and the throughput it means (rows per second).

    The percentiles come from Spark's histogram while there are few distinct values, and from
    prefix sums over the value counts otherwise.
    """
    x = F.col("latency_ms")
    probs = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    base = [
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]
    if log.agg(F.approx_count_distinct(x)).first()[0] <= max_distinct:
        out = log.groupBy("batch_size").agg(*base, *[F.percentile(x, F.lit(p)).alias(k) for k, p in probs.items()])
    else:
        counts = log.groupBy("batch_size", "latency_ms").agg(F.count("*").alias("c"))
        q = grouped_quantiles(counts, ["batch_size"], "latency_ms", "c", list(probs.values()))
        wide = q.groupBy("batch_size").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(k) for k, p in probs.items()])
        out = log.groupBy("batch_size").agg(*base).join(wide, "batch_size")
    return out.withColumn("throughput", F.col("batch_size") * 1000.0 / F.col("mean"))


def read_training_log(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """JSON lines of all ranks with an explicit schema (no inference pass)."""
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def training_log_summary(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    long = log.select(*[F.col(f).cast("double").alias(f) for f in fields]).unpivot([], list(fields), "field", "v")
    return long.where("v is not null").groupBy("field").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )


def communication_summary(events: DataFrame) -> DataFrame:
    """Per operation type and overall; one scan with a grouping set for the total row."""
    mb = F.col("bytes") / (1024 * 1024)
    rate = mb / F.when(F.col("duration") > 0, F.col("duration"))
    d = F.col("duration")
    out = events.rollup("type").agg(
        F.count("*").alias("n"), F.sum(d).alias("total_duration"), F.avg(d).alias("mean_duration"),
        F.max(d).alias("max_duration"), F.min(d).alias("min_duration"), F.sum(mb).alias("total_mb"),
        F.avg(rate).alias("mean_bandwidth"), F.max(rate).alias("max_bandwidth"),
    )
    return out.withColumn("type", F.coalesce("type", F.lit("overall"))).withColumn(
        "efficiency", F.col("total_mb") / F.greatest(F.col("total_duration"), F.lit(1e-6))
    )


def step_timing(log: DataFrame, run: str, order_cols: Sequence[str], ts: str) -> DataFrame:
    """Mean, min and max time between steps and steps per second, per run."""
    work = log.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    prev = naive_next_row(work, [run], order_cols, ["__us"])
    dt = (F.col("__us") - F.col("__us_pred")) / 1e6
    return prev.groupBy(run).agg(
        F.count("*").alias("steps"), F.avg(dt).alias("mean_step"), F.min(dt).alias("min_step"),
        F.max(dt).alias("max_step"), (1.0 / F.avg(dt)).alias("steps_per_second"),
    )


def scaling_efficiency(throughputs: DataFrame) -> DataFrame:
    """throughput / (single-worker throughput x workers); one row per world size."""
    single = throughputs.where("world_size = 1").agg(F.max("throughput")).first()[0]
    return throughputs.withColumn("efficiency", F.col("throughput") / (F.lit(single) * F.col("world_size")))
