"""Headline queries, timed: prints ONE JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import load_all  # noqa: E402
from checks.registry import QUERIES  # noqa: E402
from pingframe.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_worst_contacts", "f1_query_contacts", "f2_dim_filter", "t2_top_by_confidence", "a20_count_by_class", "a21_band_histogram",
    "a23_review_progress", "p6_briefing", "w13_latest_status", "s15_upsert", "x23_severity", "x25_actions", "j15_nearest_layer",
    "j6_box_pairs", "g1_suppressed", "j7_corroboration", "j10_match_candidates", "a27_point_metrics", "w9_pr_auc", "a24_calibration_error",
    "j12_survey_diff", "j14_confirm_candidates", "g4_linkage_zones", "w2_first_return", "a3_gain_bins", "w14_local_stats", "a9_backgrounds",
    "st1_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    spark.range(1000).count()      # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline query total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
