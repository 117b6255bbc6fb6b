"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from pourscale.checks import registry
from pourscale.session import SETTINGS

HEADLINE = [
    "normalize_text", "parse_item", "source_offer_stats", "merge_sources", "verdict_summary", "analyze_markup",
    "freshness_worklist", "section_state", "parse_menu", "producer_gate",
]
# not in the default list: over 150 s at sf0.1 beside another job; name them in BENCH_QUERIES
SLOW = ["fuzzy_match_join", "analyze_items"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "16g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": cpus}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}
    for name in chosen:
        start = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
