"""Bench: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is built (fits are eager) and then fully computed with a
``noop`` write, so every row is produced without collecting to the driver.
``value`` is the sum over queries. Set BENCH_QUERIES=a,b to pick a subset,
BENCH_MODELS=0 to skip the model fits.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from allelix.queries import QUERIES  # noqa: E402
from allelix.session import local_session  # noqa: E402

# operator queries (one per SURVEY group) and the model arms the baseline times
OPERATORS = ["population_profile", "stratified_split", "group_kfold", "group_metrics",
             "confusion_matrix", "arm_comparison", "roc_points", "group_thresholds",
             "threshold_predict", "acmg_hybrid", "pathway_features", "char_counts_long",
             "impute_standard_scale", "robust_scale", "quantile_rank", "histogram50",
             "kde_grid", "corr_matrix", "cv_summary"]
# the three model rows of the baseline
MODELS = ["fit_logistic", "fit_forest", "fit_boosted_3class"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES")
    models = [] if os.environ.get("BENCH_MODELS") == "0" else MODELS
    names = picked.split(",") if picked else OPERATORS + models
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="allelix-bench")
    # warm the JVM once (class loading, codegen caches) so the first query is not charged for it
    QUERIES["class_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name} {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
