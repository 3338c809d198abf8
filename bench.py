"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query is
planned and run to completion into a no-op sink, once, after a small warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from paperloom.plans import QUERIES
from paperloom.session import build_session

HEADLINE = [
    "A-05_dataset_status_pivot",
    "A-07_daily_timeline",
    "A-11_service_metrics",
    "A-14_concat_chunks",
    "A-15_page_range_map",
    "A-17_confidence_stats",
    "D-01_with_config",
    "D-06_merge_runs",
    "D-09_latest_correction_join",
    "E-01_match_score",
    "E-04_fuzzy_score",
    "E-06_evaluate_json",
    "F-04_search_content",
    "J-01_json_leaves",
    "J-03_repair_json",
    "J-05_classify_response",
    "K-01_list_latest",
    "P-08_normalize_document",
    "S-07_upsert",
    "T-03_document_state",
    "W-01_number_corrections",
    "W-03_correction_chain",
    "W-06_attachment_budget",
    "W-07_plan_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
