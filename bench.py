"""Time the headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from groveline import catalogue

HEADLINE = ("stand_metrics", "gini", "dominant_height", "diameter_distribution", "findings_all", "focal_mean", "canopy_summary", "distance_to_canopy", "treetop_candidates", "match_candidates")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in ("live_filter", *HEADLINE):
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    took.pop("live_filter")  # warms the JVM
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
