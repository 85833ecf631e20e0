"""Headline queries timed on one machine; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowwarden.catalog import QUERIES  # noqa: E402
from flowwarden.plans.session import with_settings  # noqa: E402

HEADLINE = [
    "behavior_flags", "ip_behavior_windows_volume", "representative_row", "window_summary",
    "parse_typed", "parse_syslog_fallback", "enrich_connections", "enrich_geo", "flow_summary",
    "dedup_lineitem", "normalize_text", "clip_iqr_lineitem", "feature_matrix", "standardize_lineitem",
    "profile_columns", "auc_roc", "quantile_lineitem", "blocklist_upsert", "alert_feed",
    "iforest_nodes", "iforest_scores_volume", "train_model", "score_windows", "stream_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowwarden-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    spark = with_settings(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run starts the JVM's compiler and the Python workers.
    QUERIES["iforest_nodes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(f"{name:32}{times[name]:8.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds, headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
