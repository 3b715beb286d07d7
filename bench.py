"""Time the headline queries; prints one JSON line.

After one warm-up query each query is timed once, from building the plan to the
noop sink, so the whole result is computed and nothing passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from emberwatch.plans import catalog
from emberwatch.session import INPUT_PARTITIONS, STATIC_SETTINGS

HEADLINES = [
    "sigma_prefilter",
    "sigma_detect",
    "sigma_detect_bundle",
    "sigma_detect_count",
    "matches_per_event",
    "match_explain",
    "signature_scan",
    "signature_scan_bundle",
    "signature_events",
    "doc_any_all_n",
    "doc_entropy",
    "ioc_extract",
    "ioc_counts",
    "search_hits",
    "saved_query_run",
    "ingest_evtx_xml",
    "ingest_journal",
    "ingest_auditd",
    "ingest_csv",
    "format_route",
    "typosquat",
    "process_network_map",
    "external_destinations",
    "triage_score",
    "triage_score_by_host",
    "correlation_chains",
    "threshold_count_trailing",
    "threshold_distinct",
    "near_all",
    "sequence_by",
    "sequence_until",
    "session_events",
    "process_lineage",
    "top_by_group",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp())
        .config(INPUT_PARTITIONS, cpus)
        .config(map=STATIC_SETTINGS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    chosen = sys.argv[1:] or HEADLINES
    times = {}
    queries["file_info"](spark, sf_dir).collect()
    for name in chosen:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
