"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 1).
Every query is executed completely with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A15_idle_core_time",
    "W1_active_tasks_series",
    "J9_cores_asof",
    "J1_pair_jobs",
    "J3_pair_tasks",
    "J6_attribute_active",
    "A1_job_task_counters",
    "A5_job_stage_counters",
    "P11_task_phases",
    "A14_phase_profile",
    "A16_stragglers",
    "T2_slowest_tasks",
    "T1_job_table",
    "U2_timeline_items",
    "W3_cell_runs",
    "J10_attribute_cells",
    "W4_retain_recent",
    "S3_parse_messages",
    "A18_histogram_fill",
    "X7_rewrite_links",
    "A19_workload_sum",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))

    from tracefold.plans.catalog import all_queries
    from tracefold.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(int(cpus) * 2))))
    qs = all_queries()
    # ingest once (adapter -> events -> entities written as Parquet), timed as its own entry
    from tracefold.plans.context import ingest

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    ingest(spark, sf_dir)
    times["ingest"] = round(time.perf_counter() - t0, 3)
    # warm-up: parquet footers, Python workers (not timed)
    qs["P22_job_markers"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    # pairing itself, from the event tables (the J1 and J3 queries read the paired tables of the ingest)
    from tracefold.operators import entities
    from tracefold.plans.context import Ctx

    lc = Ctx(spark, sf_dir).lc
    for name, pair in (("pair_jobs_from_events", entities.pair_jobs), ("pair_tasks_from_events", entities.pair_tasks)):
        t0 = time.perf_counter()
        pair(lc).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
