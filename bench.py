"""Headline timings: prints one JSON line.

Every query starts from the raw tables with an empty workspace, so its time
includes all the stages it depends on.
"""

from __future__ import annotations

import json
import os
import sys
import time

from originline.plans import jobs
from originline.plans.workspace import Workspace
from originline.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")

QUERIES = (
    "rolling_origin_samples", "assign_split", "table_fingerprint", "booking_row_contract",
    "feat_ewma_shares", "feat_community_windows", "feature_table", "as_of_audit",
    "habit_predictions", "match_summary", "evaluation_report", "slice_report",
    "representation_ceiling", "candidate_ranks", "prompt_dataset", "lead_quantiles",
    "paired_bootstrap", "review_sheet", "train_heads",
)


def main() -> None:
    names = sys.argv[1:] or QUERIES
    spark = local_session(CORES, shuffle_partitions=int(CORES))
    spark.read.parquet(f"{FOLDER}/events.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        out = jobs.JOBS[name](Workspace(spark, FOLDER))
        out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
