"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores of the local session,
BENCH_RUNS the timed runs per query after one warm-up; the median is reported. Every run
evaluates the whole result (noop sink). Known-item search quality goes along: quoted
passages as questions, the documents that quote them as answers.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodgelens.catalog import QUERIES  # noqa: E402
from lodgelens.catalog.known_items import known_item_means  # noqa: E402
from lodgelens.session import build_session  # noqa: E402

HEADLINE = [
    "stratified_sample",
    "latest_n_per_key",
    "dedup_keep_first",
    "chunk_build",
    "detect_language",
    "strip_tags",
    "snapshot_diff",
    "enriched_view",
    "avg_by_group",
    "distribution",
    "repeat_requests",
    "latency_percentiles",
    "phase_stats",
    "place_match_join",
    "name_match_join",
    "scope_resolve",
    "embed_text",
    "knn_exact",
    "knn_filtered",
    "knn_ann",
    "lexical_topk",
    "hybrid_fuse",
    "retrieve_then_rerank",
    "ir_metrics",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 4)
    quality = {mode: known_item_means(spark, folder, mode) for mode in ("lexical", "hybrid")}
    line = {
        "metric": "total_median_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
        "runs": runs,
        "known_item_quality": quality,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
