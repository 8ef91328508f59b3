"""Headline queries, timed once each after a warm-up; prints one JSON line."""

import json
import os
import time

from phasewise.plans.catalog import QUERIES
from phasewise.session import local_session

HEADLINE = [
    "flagship_pooled_lm", "fit_lm_grouped", "fit_logistic", "fit_cox", "srs", "residual_sampling", "neyman_inf", "balanced",
    "window_nearest", "first_per_key", "spine_join", "knn_donors", "rake", "draw_pmm", "pool_rubin", "bias_table",
    "quantiles", "ecdf_midrank", "transform_stages_round_trip", "error_matrix", "bootstrap", "weighted_resample", "classify_by_rules",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    for name in ("crosstab", "draw_norm"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
