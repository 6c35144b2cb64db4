"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median
wall time of writing its whole result away. BENCH_SF_DIR names the tables,
BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from chronoframe.plans import catalog

HEADLINE = ["select_all", "match_re", "time_range", "rate", "sum", "sum_by", "avg_by_prefix", "nested_agg", "sum_rate_by", "quantile", "arith_precedence", "arith_one_row", "topk", "rollup_1m", "rollup_1h", "series_list", "stats", "blocks", "recent_feed", "dedupe_merge", "shard_counts", "codec_roundtrip"]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronoframe-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
