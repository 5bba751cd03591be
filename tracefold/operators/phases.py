"""Task time broken into phases: P10–P14 and the phase profile A14.

Definitions follow the listener's task-end arithmetic (SURVEY §7.3, P11):
all in ms, ``total = finish - launch``; proportions are percent of the task's
wall time computed as ``(x / total) * 100`` (a zero-length task gives NULL);
the computing proportion is what is left of 100 after the other six, never
below 0; positions are the running sums in display order. A task end without
metrics has its phases computed but not emitted (NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.columns import to_proportion

# display order of the phases (fixed values)
PHASES = [
    "scheduler_delay",
    "deserialization",
    "shuffle_read",
    "computing",
    "shuffle_write",
    "serialization",
    "getting_result",
]

LABELS = {
    "scheduler_delay": "Scheduler Delay",
    "deserialization": "Task Deserialization Time",
    "shuffle_read": "Shuffle Read Time",
    "computing": "Executor Computing Time",
    "shuffle_write": "Shuffle Write Time",
    "serialization": "Result Serialization Time",
    "getting_result": "Getting Result Time",
}


def _m(name: str) -> Column:
    return F.col(f"metrics.{name}")


def task_phases(tasks: DataFrame) -> DataFrame:
    """Finished tasks with a ``phases`` struct (NULL when the end had no metrics)."""
    total = F.col("finish_ms") - F.col("launch_ms")
    sr = F.coalesce(_m("fetch_wait_ms"), F.lit(0).cast("long"))
    sw = F.coalesce(F.expr("metrics.shuffle_write_ns div 1000000"), F.lit(0).cast("long"))
    ser = F.coalesce(_m("ser_ms"), F.lit(0).cast("long"))
    de = F.coalesce(_m("deser_ms"), F.lit(0).cast("long"))
    gra = F.coalesce(F.col("getting_result_at"), F.lit(0).cast("long"))
    gr = F.when(gra != 0, F.col("finish_ms") - gra).otherwise(F.lit(0).cast("long"))
    overhead = ser + de
    run = F.coalesce(_m("run_ms"), total - overhead - gr)
    sched = F.greatest(F.lit(0).cast("long"), total - run - overhead - gr)
    comp = run - sr - sw
    base = tasks.where(F.col("finish_ms").isNotNull()).select(
        "*", total.alias("_total"), sched.alias("_sched"), de.alias("_de"), sr.alias("_sr"), comp.alias("_comp"),
        sw.alias("_sw"), ser.alias("_ser"), gr.alias("_gr"),
    )
    p = {k: to_proportion(F.col(c), F.col("_total")) for k, c in
         [("scheduler_delay", "_sched"), ("deserialization", "_de"), ("shuffle_read", "_sr"),
          ("shuffle_write", "_sw"), ("serialization", "_ser"), ("getting_result", "_gr")]}
    comp_p = F.greatest(
        F.lit(100.0) - p["scheduler_delay"] - p["shuffle_read"] - p["shuffle_write"] - p["serialization"]
        - p["deserialization"] - p["getting_result"],
        F.lit(0.0),
    )
    with_p = base.select("*", *[v.alias(f"_p_{k}") for k, v in p.items()], comp_p.alias("_p_computing"))
    pos = {}
    acc = F.lit(0.0)
    for k in PHASES:
        pos[k] = acc
        acc = acc + F.col(f"_p_{k}")
    phases = F.struct(
        F.col("_sched").alias("scheduler_delay_ms"),
        F.col("_de").alias("deserialization_ms"),
        F.col("_sr").alias("shuffle_read_ms"),
        F.col("_comp").alias("computing_ms"),
        F.col("_sw").alias("shuffle_write_ms"),
        F.col("_ser").alias("serialization_ms"),
        F.col("_gr").alias("getting_result_ms"),
        *[F.col(f"_p_{k}").alias(f"{k}_pct") for k in PHASES],
        *[pos[k].alias(f"{k}_pos") for k in PHASES],
        F.coalesce(_m("result_size"), F.lit(0).cast("long")).alias("result_size"),
        F.coalesce(_m("gc_ms"), F.lit(0).cast("long")).alias("jvm_gc_ms"),
        F.coalesce(_m("memory_spilled"), F.lit(0).cast("long")).alias("memory_bytes_spilled"),
        F.coalesce(_m("disk_spilled"), F.lit(0).cast("long")).alias("disk_bytes_spilled"),
        F.coalesce(_m("peak_memory"), F.lit(0).cast("long")).alias("peak_execution_memory"),
        F.col("getting_result_at").alias("getting_result_at"),
    )
    keep = [c for c in tasks.columns]
    return with_p.select(*keep, F.when(F.col("metrics").isNotNull(), phases).alias("phases"))


def phases_long(tasks_with_phases: DataFrame) -> DataFrame:
    """One row per (task, phase) with label, time, percent and position (``stack``)."""
    t = tasks_with_phases.where(F.col("phases").isNotNull())
    args = ", ".join(
        f"{i}, '{k}', '{LABELS[k]}', phases.{k}_ms, phases.{k}_pct, phases.{k}_pos" for i, k in enumerate(PHASES)
    )
    return t.select(
        "app_id", "task_id",
        F.expr(f"stack({len(PHASES)}, {args}) AS (phase_order, phase, label, time_ms, pct, pos)"),
    )


def phase_profile(tasks_with_phases: DataFrame, by: tuple[str, ...] = ("app_id", "stage_id")) -> DataFrame:
    """Total phase time per group and an I/O- vs CPU-bound label."""
    t = tasks_with_phases.where(F.col("phases").isNotNull())
    sums = [F.sum(f"phases.{k}_ms").cast("long").alias(f"{k}_ms") for k in PHASES]
    g = t.groupBy(*by).agg(F.count(F.lit(1)).alias("num_tasks"), *sums)
    io = F.col("shuffle_read_ms") + F.col("shuffle_write_ms")
    return g.withColumn("bound", F.when(io > F.col("computing_ms"), "IO").otherwise("CPU"))
