"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fuzzyspark.plans.catalog import QUERIES  # noqa: E402
from fuzzyspark.session import get_session  # noqa: E402

HEADLINE = ["block_tfidf", "block_self", "negative_rule_apply", "pair_distance", "nearest_left",
            "local_precision", "config_profit", "predict", "evaluate", "fuzzy_join"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    # untimed warm-up on the smallest tables: JVM class loading / JIT,
    # Python workers for the stemmer and Jaro-Winkler UDFs
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        QUERIES["fuzzy_join"](spark, warm_dir).count()
        QUERIES["predict"](spark, warm_dir).count()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
