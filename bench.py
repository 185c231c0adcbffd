"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS
(default 3: the median of three warm runs) set it up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventfold.plans import registry
from eventfold.session import local_session

HEADLINE = [
    "o1_canonical_order",
    "o2_first_copy",
    "r1_lww_register",
    "r9_item_headers",
    "r10_item_view",
    "r11_field_history",
    "c1_or_set",
    "c6_counters",
    "d1_comments",
    "d5_relations",
    "d7_relation_attributes",
    "d8_touching",
    "d13_claim_episodes",
    "v1_schema_versions",
    "v7_quarantine_drain",
    "v14_conflict_log",
    "v19_catalog_issues",
    "h1_append_offsets",
    "h3_sequence_checks",
    "h7_pull_page",
    "k5_watermark",
    "q2_ready_work",
    "q6_effort_progress",
    "q7_burndown",
    "q12_numbers",
    "s2_json_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "eventfold-bench")
    registry.load()
    times = {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:]), 3)  # the first run warms up
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
