"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores. Each query is run into a no-op sink after one warm-up
query, so that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from netsift.plans import catalogue  # noqa: E402

HEADLINE = [
    "h6_check_signatures",
    "h7_match_all",
    "h8_default_rules_by_severity",
    "f2_rate_match",
    "e1_flow_features",
    "e2_bidirectional_flows",
    "e4_window_summary",
    "f1_trailing_features",
    "e7_count_over_time",
    "e9_top_n",
    "e12_dashboard",
    "c2_impute_median",
    "c9_preprocess",
    "c11_profile",
    "d4_check_packets",
    "d5_match_cidr",
    "d6_geoip",
    "d9_enrich_intel",
    "d10_enrich_and_escalate",
    "d12_match_alerts",
    "d13_pair_alerts",
    "e19_detector_quality",
    "e21_case_alerts",
    "f3_moving_threshold",
    "f4_ewma_threshold",
    "f5_seasonal_threshold",
    "f9_debounce",
    "f12_nms",
    "j2_score_packets",
    "j3_dbscan",
    "j5_lof",
    "j9_ks_drift",
    "j13_uncertainty_band",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalogue.load()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["h1_port_rule"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf})
    )
    spark.stop()


if __name__ == "__main__":
    main()
