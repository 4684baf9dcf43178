"""Benchmark: run the headline queries on $BENCH_SF_DIR (default sf0.1) on
local[$BENCH_CPUS] and print one JSON line.

Each query is executed in full with a ``noop`` write (no rows pulled to
the driver). Time per query is wall-clock seconds including planning.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from peerpanel.plans import catalog as C  # noqa: E402
from peerpanel.session import build_session  # noqa: E402

# headline queries: one per operator family
HEADLINE = [
    "prepare_panel",                 # bucket, active flag, densify (customer x month)
    "prepare_panel_week",            # weekly densify, the largest panel
    "desc_summary_count",            # trim, per-date counts, running distinct
    "desc_summary_stats",            # per-date mean/sd/median
    "desc_quantile_timeseries",      # split ntile + frequency percent rank
    "detect_changepoint",            # binary segmentation rounds
    "model_summary_orders",          # leave-one-out counterfactual, all customers
    "model_ts_rank",                 # LOWESS on arrays + rankings
    "select_peers_by_segment",       # pair-free peer windows
    "causal_impact",                 # ridge on all other series, per supplier
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]")
    qs = C.queries()
    only = sys.argv[1:]
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    conf = spark.conf
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus),
           "config": {"master": spark.sparkContext.master,
                      "host_cpus": os.cpu_count(),
                      "shuffle_partitions": conf.get("spark.sql.shuffle.partitions"),
                      "aqe": conf.get("spark.sql.adaptive.enabled"),
                      "driver_memory": conf.get("spark.driver.memory", None),
                      "spark": spark.version}}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
