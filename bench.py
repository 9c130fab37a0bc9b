"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and executes it fully with the ``noop`` sink (every
row computed, nothing collected to the driver). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "asof_event_history",
    "asof_latest_version",
    "asof_cumulative",
    "enrich_spine",
    "knn_temporal_comps",
    "trend_grid",
    "transit_features",
    "cap_group_quantile",
    "band_group_quantile",
    "regression_metrics",
    "quota_admission",
    "usage_overview",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lotline.plans import registry
    from lotline.session import get_spark

    spark = get_spark("lotline-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    registry.load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # warm-up (not timed): one pass of the same queries over the tiny sf0.001 tables, so class
    # loading, JIT and codegen caches are not charged to whichever query happens to run first
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    # a fixed query that the library has no part in: how fast the machine is today
    t0 = time.perf_counter()
    spark.range(200_000_000).selectExpr("sum(id * 7 % 1000003) AS s").collect()
    calibration = round(time.perf_counter() - t0, 3)
    times = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "calibration": calibration,
        "warmup": warm_dir if os.path.isdir(warm_dir) else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
