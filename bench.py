"""Headline queries at one scale; prints one JSON line. Every result row is computed (noop sink).

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "prf1_quality", "prf3_statistics", "pip1_prepare", "enc8_quantile_bins", "seq1_sequences", "drf1_jensen_shannon",
    "drf3_kolmogorov_smirnov", "mc4_roc_auc", "mc5_average_precision", "spl3_split", "spl9_balance", "mv6_forward_backward",
    "imp1_mutual_information", "ms1_concordance", "sc2_distinct_scoring", "tok2_table_tokens", "msk1_cells",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("gridwright-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gridwright.queries import load

    queries, _ = load()
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # JVM start
    cold, warm, rows = {}, {}, {}
    for name in names:
        for store in (cold, warm):
            t0 = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            store[name] = round(time.time() - t0, 3)
    for t in ("lineitem", "orders", "events"):
        rows[t] = spark.read.parquet(f"{sf}/{t}.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "rows": rows, "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
