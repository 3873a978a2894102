"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully computed through Spark's ``noop`` sink (nothing is
collected to the driver) after one warm-up run of the flagship query; the
time per query is the best of ``$BENCH_REPEAT`` (default 2) runs, because
single runs on a shared VM vary by +-15 % or more. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_tod_profile",
    "quality_travel",
    "quality_travel_audit",
    "dedup_exact",
    "iqr_split",
    "group_sigma_filter",
    "split_random",
    "split_stratified",
    "split_singleton",
    "split_dates",
    "sizes_by_keys",
    "describe_num",
    "feature_matrix",
    "label_encode",
    "sequences",
    "sequence_weight",
    "fill_minutes_travel",
    "prediction_report",
    "metrics_batch",
    "incumbent_bins",
    "per_group_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tripframe.plans import load_all
    from tripframe.session import get_spark
    spark = get_spark(f"local[{cpus}]", "tripframe-bench",
                      {"spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE", str(max(4, cpus))),
                       "spark.driver.memory": os.environ.get("BENCH_MEM", "4g")})
    queries, _ = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in queries]

    def run(name):
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    run(names[0])  # warm-up: JVM, codegen, file listing
    times = {n: round(min(run(n) for _ in range(repeat)), 3) for n in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": f"headline_total_best_of_{repeat}",
                      "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": m.group(1) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
