"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from argosift.plans.catalog import QUERIES  # noqa: E402
from argosift.session import build_session, discard_tables  # noqa: E402

HEADLINE = [
    "c1_integrity_audit", "c6_forensics", "d8_integrity_report", "k19_chain_build", "e3_chain_verify",
    "a3_scan_text", "b1_parse_syslog", "b2_parse_access", "b4_auth_fields", "h13_classify_logs", "h39_log_features",
    "h37_network_features", "h11_entropy", "d1_log_summary", "d7_profiles", "k2_moving_profiles",
    "k4_statistical_score", "e1_burst_rate", "k9_combined_detect", "k10_ensemble", "k6_forest_score",
    "k11_rules_log", "d4_brute_force", "d5_port_scan", "c10_temporal_correlation", "e6_entity_frequency",
    "k12_attack_chains", "c12_process_changes", "e4_bandwidth", "k24_indicators", "k15_response_plan",
    "i4_tumbling_counts", "i9_chain_append", "c13_connection_changes", "k13_correlation_records", "k14_assessments",
    "i6_interval_join", "i8_moving_baseline", "i12_snapshot_events",
]
# Queries that score every event once per source type.
SCORED = {"k9_combined_detect": 4}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    took: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
        discard_tables(spark)
    total = round(sum(took.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "events": rows,
        "events_per_second": {n: round(rows / s) for n, s in took.items() if s > 0},
        "scored_rows_per_second": {n: round(k * rows / took[n]) for n, k in SCORED.items() if took.get(n)}}))
    spark.stop()


if __name__ == "__main__":
    main()
