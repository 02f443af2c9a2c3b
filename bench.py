"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestar.queries import QUERIES

HEADLINE = [
    "word_count",
    "word_count_salted",
    "word_count_by_partition",
    "avg_word_length",
    "cell_classes",
    "outlier_summary",
    "ball_counts",
    "exact_outliers",
    "top_outliers",
    "kcenter_centers",
    "kcenter_radius",
    "kcenter_outliers",
    "item_freq",
    "distinct_item_count",
    "true_frequent",
    "reservoir_sample",
    "sticky_table",
    "frequent_summary",
    "stream_summary",
    "stream_item_freq",
    "stream_frequent_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        # The whole result is computed in the executors and thrown away.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    run("outlier_summary")
    run("kcenter_centers")
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
