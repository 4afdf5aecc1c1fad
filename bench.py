"""Headline-query timings: prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default HEADLINE). Each query runs to completion
through the ``noop`` sink (full execution, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetrisk.plans.queries import QUERIES  # noqa: E402
from fleetrisk.session import build_session  # noqa: E402

HEADLINE = [
    "flatten_training", "enriched", "validated", "kb_ranking", "closure_pairs", "kb_status",
    "scan_summary", "fleet_ranking", "cve_preview", "candidate_scores", "best_candidate",
    "month_window", "page_links", "ml_cluster_profile", "ml_scaling", "ml_split_sizes", "ml_classification_eval",
    "report_lines", "nested_ranking", "missing_update_candidates", "result_rows",
    "missing_kbs", "scanner_summary", "window_advisories", "scan_documents", "ml_elbow",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", app="fleetrisk-bench", shuffle_partitions=max(cpus * 2, 8))
    timings: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
