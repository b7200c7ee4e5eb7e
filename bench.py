"""Time the headline queries: one JSON line with seconds per query.

``queries`` holds warm runs (second run in the session), ``cold`` the first ones.
Results go to Spark's noop sink, so every row and column is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tenderloom.catalog.queries import all_queries  # noqa: E402

HEADLINE = (
    "stats_by_mode",
    "stats_default_rules",
    "reason_lists",
    "scores_and_tiers",
    "top_signals",
    "validation_report",
    "normalized_text",
    "source_hash",
    "amount_parse",
    "dedupe_first_wins",
    "crawl_qc",
    "upsert_merge",
    "window_filter",
    "stale_page_cut",
    "latest_label_one",
    "latest_label_ties",
    "search_text_page",
    "search_mode_page",
    "search_totals",
    "quality_metrics_by_mode",
    "calibration_compare",
    "drift_rows",
    "export_broad",
    "export_qc",
    "review_queue",
    "page_records",
    "bootstrap_ingest",
    "streaming_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds(chosen[0])  # JVM and table start-up
    cold = {name: seconds(name) for name in chosen}
    warm = {name: seconds(name) for name in chosen}
    print(
        json.dumps(
            {
                "metric": "headline queries, warm total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cores": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
