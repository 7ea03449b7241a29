"""Headline queries on one machine: median seconds over warm runs, one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the tables, the cores and the repeats.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans.queries import QUERIES
from tidemark.session import local_session

HEADLINE = (
    "bars_hourly", "log_returns", "rv_daily", "har_features", "tick_micro_daily", "obi_daily", "liquidity_daily",
    "vpin_buckets", "vpin_daily", "vpin_trades_daily", "equity_daily_rv", "macro_ffill", "asof_features", "gkg_daily",
    "depth_imbalance", "har_forecast", "dm_test", "doc_sentiment", "profile_table",
)


def run() -> dict:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    return {
        "metric": "sum of the median seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }


if __name__ == "__main__":
    print(json.dumps(run()))
