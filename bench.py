"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "batch_report",
    "match_boxes",
    "match_xs_page_scope",
    "mean_best_iou",
    "sequence_metrics",
    "accuracy_summary",
    "normalize_splits",
    "derive_measures",
    "param_sweep",
    "assign_to_systems",
    "apply_edits",
    "meter_check",
    "melody_timeline",
    "pack_by_meter",
    "collect_problems",
    "splice_measures",
    "classify_items",
    "parse_lines_to_notes",
    "build_heat",
    "nms_1d",
    "score_round_trip",
    "structure_round_trip",
    "compare_samples",
    "parent_of",
    "system_boxes",
]


def main() -> None:
    from scorelake import catalog
    from scorelake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's compilers and the Python workers outside the timings
    catalog.QUERIES["count_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
