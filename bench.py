"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query runs twice into a no-op sink and the better time counts, so that class loading and code
generation of the first run do not.
"""

from __future__ import annotations

import json
import os
import time

from veil.functions.lineage import drop_scratch
from veil.plans import QUERIES
from veil.session import local_session

HEADLINE = [
    "f1_missing_table", "f3_numeric_summary", "f6_value_frequencies", "c1_correlation_matrix", "c3_age_gender_pivot",
    "k1_class_sizes_raw", "k2_risk_profile", "k5_before_after", "k6_record_risk", "l1_class_diversity", "t2_frequency_distance",
    "t5_scorecard", "l7_enforce_diversity", "p6_respond_all", "p9_estimate_by_region", "p14_laplace_mechanism", "p11_simulated_estimates",
    "p19_staged_release", "m6_partition_k", "m6_partition_kl", "m7_partition_bounded", "m10_micro_aggregation", "s5_release_sink", "p18_combined_protection", "v3_folds_exact", "v11_choose_threshold", "v15_roc_auc",
    "v16_average_precision", "v19_calibration_curve",
]


def run(fn, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = max(8, int(cpus)) if cpus.isdigit() else 8
    spark = local_session(cpus, partitions=partitions, app="bench")
    times = {name: round(min(run(QUERIES[name], spark, sf_dir) for _ in range(2)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
