"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
BENCH_QUERIES names other queries, comma separated; 'all' runs every query.
Each query runs once, to a full write of all its rows into a sink that drops them,
so no column or row is pruned away. "calibration" is the time of a fixed job that no code of the library takes part in, the
least of three: seconds of runs on machines of unequal speed compare after division by it.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritab.plans import QUERIES
from veritab.session import build_session

HEADLINE = [
    "q7_rule_set", "q1_profile_lineitem", "q12_anomalies", "q13_health_scores", "q14_digest", "a2_coverage_matrix", "a3_description_coverage",
    "j2_name_match_edges", "j7_similar_name_groups", "j8_glossary_matches", "j6_dependency_edges", "g1_neighbourhood_nodes",
    "g2_impact_summary", "g5_hop_distance", "g8_infer_column_edges", "x2_value_scan_documents", "x4_column_descriptions",
    "x17_sql_column_edges", "x18_safety", "x25_edge_descriptions", "x28_output_datasets", "p1_decisions", "p6_infer_owners",
    "e2_scores", "a12_report", "w3_few_shots", "f12_search", "t1_ingest_run_events", "t3_descriptor_changes",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = QUERIES.names() if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    scratch = tempfile.TemporaryDirectory(prefix="veritab-bench-")
    spark = build_session(
        f"local[{cpus}]", **{"spark.checkpoint.dir": scratch.name, "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                             "spark.ui.showConsoleProgress": "false",
                             # Small inputs, costly rows: keep all cores busy instead of merging to 1 MB.
                             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("OFF")
    # Start the workers and compile the common paths before the clock runs.
    QUERIES.get("a7_assets_by_tier").fn(spark, root).collect()
    calibration = []
    for _ in range(3):
        start = time.time()
        spark.range(0, 100_000_000, 1, int(cpus)).selectExpr("max(xxhash64(id, id + 1))").collect()
        calibration.append(time.time() - start)
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES.get(name).fn(spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    scratch.cleanup()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
        "calibration": round(min(calibration), 3),
    }))


if __name__ == "__main__":
    main()
