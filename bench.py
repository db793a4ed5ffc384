"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list to run a subset).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from knockon.plans import catalog as K  # noqa: E402
from knockon.plans.suite import fit_suite  # noqa: E402
from knockon.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def run(df):
    df.write.format("noop").mode("overwrite").save()


def q_clean(spark, sf):
    run(K.clean_of(spark, sf, "lineitem"))


def q_pairs(spark, sf):
    run(K.pairs_of(spark, sf, "lineitem"))


def q_pairs_dirty(spark, sf):
    run(K.pairs_of(spark, sf, "flights"))


def q_delay_rate(spark, sf):
    K.QUERIES["delay_rate_by_bin_multi_year"](spark, sf).collect()


def q_decay(spark, sf):
    K.QUERIES["decay_table"](spark, sf).collect()


def q_models(spark, sf):
    out = fit_suite(spark, K.mf_of(spark, sf, "lineitem"))
    out["airline_carryover"].collect()


def q_ranking(spark, sf):
    K.QUERIES["ranking_metrics_prev_delay"](spark, sf).collect()


def q_bootstrap(spark, sf):
    K.QUERIES["bootstrap_table"](spark, sf).collect()


def q_yearly_models(spark, sf):
    K.QUERIES["fit_by_year"](spark, sf).collect()


def q_density(spark, sf):
    K.QUERIES["density_grid"](spark, sf).collect()


QUERIES = {"clean": q_clean, "pairs": q_pairs, "pairs_dirty": q_pairs_dirty,
           "delay_rate_by_bin": q_delay_rate, "decay": q_decay, "models": q_models,
           "ranking_metrics": q_ranking, "bootstrap": q_bootstrap, "yearly_models": q_yearly_models, "density_grid": q_density}


def main():
    spark = get_spark("knockon-bench", master=f"local[{CPUS}]", shuffle_partitions=max(8, CPUS * 2))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    # warm-up: JVM, Python workers, parquet footers
    K.clean_of(spark, SF_DIR, "lineitem").limit(10).collect()
    times = {}
    for name in wanted:
        t = time.perf_counter()
        QUERIES[name](spark, SF_DIR)
        times[name] = round(time.perf_counter() - t, 3)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else SF_DIR,
                      "cpus": CPUS}))


if __name__ == "__main__":
    main()
