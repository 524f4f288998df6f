"""Benchmark the headline queries.

Runs each query once to warm up, then three timed runs (full execution into the
``noop`` sink, nothing collected), and prints ONE JSON line with the median per
query and their sum.  Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default: all cores), BENCH_RUNS (default 3), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "mcrmse_per_target", "cv_scores", "group_kfold", "stratified_kfold", "multilabel_kfold",
    "kendall_tau", "predicted_order", "order_masks",
    "encode_tokens", "top_tokens", "ngram_counts", "random_truncate", "mask_tokens",
    "pos_pairs", "neg_pairs", "triplets",
    "describe_numeric", "corr_matrix", "kde_grid", "histogram",
    "pool_mean", "pool_attention",
    "weight_grid", "vote_ensemble", "classification_report", "fold_argmax",
    "early_stop", "running_mean", "leaderboard", "tumbling_5s",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    from tessera.plans.registry import load_all
    from tessera.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "6g")})
    queries, _ = load_all()
    out = {}
    for name in names:
        def run():
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        run()
        out[name] = round(statistics.median(run() for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
