"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default all), ``BENCH_QUERIES`` (comma-separated
names, ``all`` for every registered query), ``BENCH_REPEAT`` (median of n runs, default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "norm_text", "url_resolve", "page_blocks", "chunks_web", "pack_1k", "content_dedupe",
    "bounded_frontier", "snapshot_diff", "incremental_chunks", "debounce_events",
    "knn_topk", "tfidf_novelty", "format_context", "index_stats",
    "clean_leaves", "replace_and_map", "mask_names_free_text", "record_to_text", "weekly_schedule",
    "vitals_merge", "vitals_report", "confirm_dialogue", "export_markdown",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docflow-bench")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from docflow.registry import load

    queries = load()[0]
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_REPEAT", "1"))):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
