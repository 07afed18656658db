"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect to the driver) and
timed; prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Headline queries: one per pipeline stage (split, preprocess, score, train, stack,
# metrics, calibration, tests, report).
HEADLINE = (
    "K03_stratified_kfold",
    "T07_fit_fold_preprocessor",
    "R01_univariate_r2",
    "R08_stability_selection",
    "M01_linear_regression",
    "M10_adaboost_r2",
    "M11_knn_distance",
    "M13_neural_ordinal",
    "B02_blend_nnls",
    "V01_regression_metrics",
    "C01_bias_and_qhat",
    "H02_wilcoxon_signed_rank",
    "H03_friedman",
    "L02_rank_models",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from strata.plans.catalog import load_all
    from strata.session import build_session

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=parts)
    reg = load_all()
    only = sys.argv[1:]
    names = [n for n in HEADLINE if n in reg and (not only or any(n.startswith(p) for p in only))]
    # Warm-up: JVM start, parquet footers.
    reg["S01_list_environments"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        print(f"{n}: {times[n]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
