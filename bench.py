"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from proofloom import catalog

HEADLINES = [
    "parse_prices", "product_rows", "squash_whitespace", "cue_categories",
    "distinct_assets", "exact_copies", "snapshot_problems", "gate_validity", "invalidated_gates",
    "assigned_matches", "first_candidate_page", "nearest_photos",
    "expanded_credits", "caption_violations", "merged_credits", "overlaid_groups", "undeclared_changes",
    "rolling_usage", "step_durations", "admitted_requests", "streamed_usage", "streamed_stagnation", "visible_draws", "page_ranges",
    "closed_swaps", "page_order", "one_to_one_cards",
]
WARM_RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("proofloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    seconds = {}
    for name in HEADLINES:
        runs = []
        for attempt in range(WARM_RUNS + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt or not WARM_RUNS:  # the first run warms up
                runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
