"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line with seconds per query.

Each query is built and run to the end (``noop`` sink) once to warm up and then
three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from voxelarium.plans import QUERIES
from voxelarium.session import local_session
from voxelarium.storage import scratch

HEADLINES = [
    "cohort_intensity_stats",
    "case_intensity_stats",
    "merged_moments",
    "cohort_percentiles",
    "intensity_histogram",
    "case_mean_boxes",
    "modality_correlations",
    "stats_cube",
    "label_volumes",
    "region_volumes",
    "derived_labels",
    "region_summary",
    "presence_and_fraction",
    "top_cases_by_volume",
    "windowed_volumes",
    "ctn_normalised",
    "zscored_volumes",
    "heuristic_regions",
    "extracted_patches",
    "brain_components",
    "complete_cases",
    "pending_cases",
    "deduplicated_labels",
    "stratified_split",
    "group_split",
    "balanced_batches",
    "effective_number_weights",
    "batch_scores",
    "binary_metrics",
    "ranking_metrics",
    "mean_losses",
    "early_stop",
    "progression",
    "session_activity",
    "decoded_scans",
    "streaming_daily_moments",
]


def measure(spark, sf_dir: str, name: str, runs: int) -> float:
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        with scratch(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = {name: measure(spark, sf_dir, name, runs) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds, warm",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": spark.sparkContext.defaultParallelism,
            }
        )
    )


if __name__ == "__main__":
    main()
