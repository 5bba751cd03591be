"""Concurrency against capacity: U1, W1, W2, J9, A15 (and P22 job markers).

Kind ranks of the canonical event order (SURVEY §1.7): appStart 0,
execAdded 1, jobStart 2, stageSubmitted 3, taskStart 4, taskEnd 5,
stageCompleted 6, jobEnd 7, execRemoved 8, appEnd 9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.sweep import running_sums

K_APP_START, K_EXEC_ADDED, K_JOB_START, K_STAGE_SUBMITTED = 0, 1, 2, 3
K_TASK_START, K_TASK_END, K_STAGE_COMPLETED, K_JOB_END, K_EXEC_REMOVED, K_APP_END = 4, 5, 6, 7, 8, 9



def event_points(tasks: DataFrame) -> DataFrame:
    """Task launches (+1) and finishes (-1) as one point table."""
    starts = tasks.select(
        "app_id", "task_id", F.col("launch_ms").alias("t"),
        F.lit(K_TASK_START).alias("kind_rank"), F.lit(1).alias("delta"),
    )
    ends = tasks.where(F.col("finish_ms").isNotNull()).select(
        "app_id", "task_id", F.col("finish_ms").alias("t"),
        F.lit(K_TASK_END).alias("kind_rank"), F.lit(-1).alias("delta"),
    )
    return starts.unionByName(ends)


def capacity_points(executors: DataFrame) -> DataFrame:
    """Executor added (+cores) / removed (-cores); a removal of an unknown executor counts 0."""
    added = executors.where(F.col("added_ms").isNotNull()).select(
        "app_id", F.col("added_ms").alias("t"), F.lit(K_EXEC_ADDED).alias("kind_rank"),
        F.col("executor_id").cast("string").alias("entity"), F.coalesce(F.col("cores"), F.lit(0)).alias("dcores"),
    )
    removed = executors.where(F.col("removed_ms").isNotNull()).select(
        "app_id", F.col("removed_ms").alias("t"), F.lit(K_EXEC_REMOVED).alias("kind_rank"),
        F.col("executor_id").cast("string").alias("entity"), (-F.coalesce(F.col("cores"), F.lit(0))).alias("dcores"),
    )
    return added.unionByName(removed)


def active_tasks_series(tasks: DataFrame, form: str = "step") -> DataFrame:
    """Number of running tasks per application over time.

    ``form="step"``: one row per distinct time, ``active`` after every event
    at that time (tie-independent). ``form="chart"``: two rows per event, the
    value just before and just after it (starts before ends at equal times).
    """
    pts = event_points(tasks)
    if form == "step":
        per_t = pts.groupBy("app_id", "t").agg(F.sum("delta").alias("delta"))
        out = running_sums(per_t, ["app_id"], "t", ["delta"])
        return out.select("app_id", "t", F.col("delta_run").alias("active"))
    if form == "chart":
        out = running_sums(pts, ["app_id"], "t", ["delta"], tiebreak=["kind_rank", "task_id"])
        after = F.col("delta_run")
        return out.select(
            "app_id", "task_id", "kind_rank", "t",
            F.explode(F.array(
                F.struct(F.lit(0).alias("side"), (after - F.col("delta")).alias("active")),
                F.struct(F.lit(1).alias("side"), after.alias("active")),
            )).alias("p"),
        ).select("app_id", "task_id", "kind_rank", "t", "p.side", "p.active")
    raise ValueError(f"unknown form {form!r}")


def cores_series(executors: DataFrame) -> DataFrame:
    """Capacity (total executor cores) per application, one row per distinct change time."""
    per_t = capacity_points(executors).groupBy("app_id", "t").agg(F.sum("dcores").alias("dcores"))
    out = running_sums(per_t, ["app_id"], "t", ["dcores"])
    return out.select("app_id", "t", F.col("dcores_run").alias("cores"))


def capacity_sweep(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Merged step form: (app_id, t, active, cores, next_t) over all task and executor times."""
    a = event_points(tasks).select("app_id", "t", F.col("delta").alias("dactive"), F.lit(0).alias("dcores"))
    c = capacity_points(executors).select("app_id", "t", F.lit(0).alias("dactive"), "dcores")
    per_t = a.unionByName(c).groupBy("app_id", "t").agg(
        F.sum("dactive").alias("dactive"), F.sum("dcores").alias("dcores")
    )
    out = running_sums(per_t, ["app_id"], "t", ["dactive", "dcores"], next_time="next_t")
    return out.select(
        "app_id", "t", F.col("dactive_run").alias("active"), F.col("dcores_run").alias("cores"), "next_t"
    )


def cores_asof(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Capacity known at each task event, in canonical order (one sweep, no as-of join).

    An executor added at the same millisecond counts, one removed at the same
    millisecond does not yet (kind ranks 1 < 4,5 < 8).
    """
    t = event_points(tasks).select(
        "app_id", "t", "kind_rank", F.col("task_id").cast("string").alias("entity"),
        F.col("task_id"), F.col("delta").alias("dactive"), F.lit(0).alias("dcores"),
    )
    c = capacity_points(executors).select(
        "app_id", "t", "kind_rank", "entity", F.lit(None).cast("long").alias("task_id"),
        F.lit(0).alias("dactive"), "dcores",
    )
    out = running_sums(t.unionByName(c), ["app_id"], "t", ["dactive", "dcores"],
                       tiebreak=["kind_rank", "entity"])
    return out.where(F.col("task_id").isNotNull()).select(
        "app_id", "task_id", "kind_rank", "t",
        F.col("dactive_run").alias("active"), F.col("dcores_run").alias("cores"),
    )


def idle_core_time(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Per application, core-ms idle (cores above running tasks), busy and total capacity.

    Integrates the merged step function; the last open segment is dropped.
    """
    s = capacity_sweep(tasks, executors)
    dt = F.col("next_t") - F.col("t")
    return (
        s.where(F.col("next_t").isNotNull())
        .groupBy("app_id")
        .agg(
            F.sum(F.greatest(F.col("cores") - F.col("active"), F.lit(0)) * dt).cast("long").alias("idle_core_ms"),
            F.sum(F.least(F.col("active"), F.col("cores")) * dt).cast("long").alias("busy_core_ms"),
            F.sum(F.col("cores") * dt).cast("long").alias("capacity_core_ms"),
            F.max("active").cast("long").alias("peak_active"),
            F.max("cores").cast("long").alias("peak_cores"),
        )
    )


def job_markers(jobs: DataFrame) -> DataFrame:
    """Labelled chart points "Job n started" / "Job n ended"."""
    s = jobs.where(F.col("submission_ms").isNotNull()).select(
        "app_id", "job_id", F.col("submission_ms").alias("t"),
        F.concat(F.lit("Job "), F.col("job_id").cast("string"), F.lit(" started")).alias("label"),
    )
    e = jobs.where(F.col("completion_ms").isNotNull()).select(
        "app_id", "job_id", F.col("completion_ms").alias("t"),
        F.concat(F.lit("Job "), F.col("job_id").cast("string"), F.lit(" ended")).alias("label"),
    )
    return s.unionByName(e)
