"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` (default 8) against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints ONE JSON line:
{"metric": "...", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full (``write.format("noop")``, no collect) once to warm up and then
``$BENCH_RUNS`` times (default 2); the reported time per query is the median.  ``value`` is
the sum of the medians.  Intermediate memo tables are dropped between runs so every run
recomputes from the parquet files.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "filters_F7_F8": ["f7_apply_filters", "f8_filter_summary"],
    "periods_T2_T3": ["t2_equal_periods", "t3_period_distribution"],
    "cv_K3_k5": ["k3_cv_residuals"],
    "best_k_K8": ["k8_optimal_k"],
    "account_stats_A1_A8": ["a8_feature_matrix"],
    "dbscan_D1_D3": ["d3_dbscan_noise"],
    "iforest_D6_D7": ["d6_iforest_scores"],
    "full_chain_D12": ["d12_detect"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from acctlens.session import get_spark
    scratch = tempfile.mkdtemp(prefix="acctlens-bench-")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                             "spark.local.dir": os.path.join(scratch, "local")})
    from acctlens.plans import queries as Q

    def run_once(keys):
        Q._MEMO.clear()
        t0 = time.perf_counter()
        for k in keys:
            Q.REGISTRY[k][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times: dict[str, float] = {}
    for name, keys in HEADLINE.items():
        run_once(keys)                       # warm-up
        times[name] = round(statistics.median(run_once(keys) for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "runs": runs}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
