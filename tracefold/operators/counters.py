"""Counters at task, stage, job and application level: A1–A13, A21.

All are grouped aggregates with map-side partial aggregation; none keys the
task table on ``app_id`` alone except app-level totals (partials first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.columns import executor_group
from tracefold.operators.attribution import (
    attribute_planned,
    job_task_counts,
    routable_task_ends,
    skipped_stages,
)
from tracefold.operators.entities import job_stage_infos
from tracefold.operators.series import K_JOB_END, K_JOB_START, K_STAGE_COMPLETED, K_STAGE_SUBMITTED
from tracefold.sources.lifecycle import Lifecycle


def job_num_tasks(jobs: DataFrame) -> DataFrame:
    """Tasks of the job as announced at its start: planned stages not yet completed."""
    i = job_stage_infos(jobs)
    return i.groupBy("app_id", "job_id").agg(
        F.coalesce(F.sum(F.when(F.col("completion_known_ms").isNull(), F.col("num_tasks"))), F.lit(0))
        .cast("long").alias("num_tasks"),
        F.count(F.lit(1)).alias("num_stages"),
    )


# A1 ----------------------------------------------------------------------
def job_task_counters(lc: Lifecycle, jobs: DataFrame, mode: str = "active") -> DataFrame:
    c = job_task_counts(lc, jobs, mode)
    n = job_num_tasks(jobs)
    return c.join(n, ["app_id", "job_id"], "left").select(
        "app_id", "job_id",
        F.coalesce("num_tasks", F.lit(0).cast("long")).alias("num_tasks"),
        (F.col("n_started") - F.col("n_succeeded") - F.col("n_failed")).alias("active_tasks"),
        F.col("n_succeeded").alias("completed_tasks"),
        F.col("n_failed").alias("failed_tasks"),
    )


# A2 ----------------------------------------------------------------------
def job_skip_counters(lc: Lifecycle, jobs: DataFrame, mode: str = "listener") -> DataFrame:
    sk = skipped_stages(lc, jobs, mode).groupBy("app_id", "job_id").agg(
        F.count(F.lit(1)).alias("skipped_stages"), F.sum("num_tasks").cast("long").alias("skipped_tasks")
    )
    n = job_num_tasks(jobs)
    j = jobs.select("app_id", "job_id").join(n, ["app_id", "job_id"], "left").join(sk, ["app_id", "job_id"], "left")
    z = F.lit(0).cast("long")
    return j.select(
        "app_id", "job_id",
        F.coalesce("num_stages", z).alias("num_stages"),
        F.coalesce("skipped_stages", z).alias("skipped_stages"),
        F.coalesce("skipped_tasks", z).alias("skipped_tasks"),
        (F.coalesce("num_stages", z) - F.coalesce("skipped_stages", z)).alias("effective_stages"),
        (F.coalesce("num_tasks", z) - F.coalesce("skipped_tasks", z)).alias("effective_tasks"),
    )


# A3 / A4 -----------------------------------------------------------------
def stage_task_counters(lc: Lifecycle, stages: DataFrame) -> DataFrame:
    """Per (stage, attempt): active / completed / failed / killed tasks and distinct completed indices."""
    k = ["app_id", "stage_id", "stage_attempt"]
    st = lc.task_start.groupBy(*k).agg(F.count(F.lit(1)).alias("started"))
    ok = F.col("end_reason") == "Success"
    en = routable_task_ends(lc.task_end).groupBy(*k).agg(
        F.count(F.lit(1)).alias("ended"),
        F.count_if(ok).alias("completed_tasks"),
        F.count_if(~ok).alias("failed_tasks"),
        F.count_if(F.col("end_reason") == "TaskKilled").alias("killed_tasks"),
        F.count_distinct(F.when(ok, F.col("task_index"))).alias("completed_indices"),
    )
    z = F.lit(0).cast("long")
    j = stages.select(*k, "num_tasks").join(st, k, "full").join(en, k, "full")
    return j.select(
        *k,
        F.col("num_tasks").cast("long").alias("num_tasks"),
        (F.coalesce("started", z) - F.coalesce("ended", z)).alias("active_tasks"),
        F.coalesce("completed_tasks", z).alias("completed_tasks"),
        F.coalesce("failed_tasks", z).alias("failed_tasks"),
        F.coalesce("killed_tasks", z).alias("killed_tasks"),
        F.coalesce("completed_indices", z).alias("completed_indices"),
    )


# A5 ----------------------------------------------------------------------
def _stage_events(lc: Lifecycle) -> DataFrame:
    sub = lc.stage_submitted.select(
        "app_id", "stage_id", "t", F.lit(K_STAGE_SUBMITTED).alias("kind_rank"), "stage_attempt",
        F.lit(True).alias("is_submit"), F.lit(False).alias("ok"), F.lit(False).alias("failed"),
    )
    com = lc.stage_completed.select(
        "app_id", "stage_id", "t", F.lit(K_STAGE_COMPLETED).alias("kind_rank"), "stage_attempt",
        F.lit(False).alias("is_submit"),
        (F.col("failure_reason").isNull() & F.col("submission_ms").isNotNull()).alias("ok"),
        F.col("failure_reason").isNotNull().alias("failed"),
    )
    return sub.unionByName(com)


def job_stage_counters(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """Listener rule: stage events inside the job's active interval; completed is a set
    (a stage is in it iff its last attributed submit-or-complete is a successful completion).

    Sweep form (no job x event pairs): per (app, stage), running counts over the
    stage events and the jobs' start/end markers; a job's counts are end minus
    start, and the last event inside its interval is event number k read at the
    end marker (fetched by an equi-join on (app, stage, k)) when k is above the
    number read at the start marker.
    """
    from tracefold.operators.attribution import END_OF_TIME, MARKS, kind_of
    from tracefold.operators.sweep import running_sums

    pairs = job_stage_infos(jobs, ("completion_ms", "has_start")).withColumnRenamed("completion_ms", "end_t").where(
        F.col("has_start") & F.col("submission_ms").isNotNull())
    # a row is (app, stage, time, mark, id); a mark is the event's kind and, for a completion, whether it succeeded or failed
    submitted, completed, began, over = (k * MARKS for k in (K_STAGE_SUBMITTED, K_STAGE_COMPLETED, K_JOB_START, K_JOB_END))
    row = lambda df, t, mark, eid: df.select("app_id", "stage_id", t.alias("t"), mark.alias("mark"), F.col(eid).cast("long").alias("eid"))
    ev = _stage_events(lc)
    u = (
        row(ev, F.col("t"), F.col("kind_rank") * MARKS + F.when(F.col("ok"), 1).when(F.col("failed"), 2).otherwise(0), "stage_attempt")
        .unionByName(row(pairs, F.col("submission_ms"), F.lit(began), "job_id"))
        .unionByName(row(pairs, F.coalesce("end_t", F.lit(END_OF_TIME)), F.lit(over), "job_id"))
    )
    mark = F.col("mark")
    of_stage = kind_of(mark).isin(K_STAGE_SUBMITTED, K_STAGE_COMPLETED)
    counts = {"n_ev": of_stage, "subs": mark == submitted, "comps": kind_of(mark) == K_STAGE_COMPLETED, "fails": mark == completed + 2}
    vals = list(counts)
    r = running_sums(u, ["app_id", "stage_id"], "t", {v: c.cast("int") for v, c in counts.items()}, tiebreak=[kind_of(mark), "eid"])
    events = r.where(of_stage).select("app_id", "stage_id", F.col("n_ev_run").alias("k"), (mark == completed + 1).alias("ok"))
    m = r.where(~of_stage & F.col("eid").isNotNull()).groupBy("app_id", "stage_id", F.col("eid").alias("job_id")).agg(
        *[F.max(F.when(mark == began, F.col(f"{v}_run"))).alias(f"s_{v}") for v in vals],
        *[F.max(F.when(mark == over, F.col(f"{v}_run"))).alias(f"e_{v}") for v in vals],
    )
    per_stage = m.join(events.withColumnRenamed("k", "e_n_ev"), ["app_id", "stage_id", "e_n_ev"], "left").select(
        "app_id", "job_id",
        (F.col("e_subs") - F.col("s_subs")).alias("subs"), (F.col("e_comps") - F.col("s_comps")).alias("comps"),
        (F.col("e_fails") - F.col("s_fails")).alias("fails"),
        ((F.col("e_n_ev") > F.col("s_n_ev")) & F.coalesce(F.col("ok"), F.lit(False))).alias("last_ok"),
    )
    agg = per_stage.groupBy("app_id", "job_id").agg(
        (F.sum("subs") - F.sum("comps")).cast("long").alias("active_stages"),
        F.count_if("last_ok").alias("completed_stages"),
        F.sum("fails").cast("long").alias("failed_stages"),
    )
    z = F.lit(0).cast("long")
    return jobs.select("app_id", "job_id").join(agg, ["app_id", "job_id"], "left").select(
        "app_id", "job_id", *[F.coalesce(c, z).alias(c) for c in ["active_stages", "completed_stages", "failed_stages"]]
    )


# A6 ----------------------------------------------------------------------
def job_stage_counters_naive(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """Frontend rule: every completion event of a planned stage is counted, at any time."""
    per_stage = _stage_events(lc).groupBy("app_id", "stage_id").agg(
        F.count_if("is_submit").alias("subs"),
        F.count_if(~F.col("is_submit") & ~F.col("failed")).alias("oks"),
        F.count_if("failed").alias("fails"),
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("subs", "oks", "fails")]
    planned = job_stage_infos(jobs).join(per_stage, ["app_id", "stage_id"], "left").select("app_id", "job_id", "subs", "oks", "fails")
    # a row without events for each job, so that jobs without stages are kept
    a = planned.unionByName(jobs.select("app_id", "job_id", *none)).groupBy("app_id", "job_id").agg(
        F.sum(F.coalesce(F.col("subs") - F.col("oks") - F.col("fails"), F.lit(0))).cast("long").alias("active_stages"),
        F.sum(F.coalesce("oks", F.lit(0))).cast("long").alias("completed_stages"),
        F.sum(F.coalesce("fails", F.lit(0))).cast("long").alias("failed_stages"),
    )
    return a


# A7 ----------------------------------------------------------------------
def job_badges(jobs: DataFrame, by: tuple[str, ...] = ("app_id",)) -> DataFrame:
    return jobs.groupBy(*by).agg(
        F.count_if(F.col("status") == "RUNNING").alias("running_jobs"),
        F.count_if(F.col("status") == "SUCCEEDED").alias("completed_jobs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_jobs"),
    )


# A8 ----------------------------------------------------------------------
def capacity_totals(executors: DataFrame) -> DataFrame:
    """Executors and cores now: added minus removed."""
    live = F.col("removed_ms").isNull()
    return executors.groupBy("app_id").agg(
        F.count_if(live & F.col("added_ms").isNotNull()).alias("num_executors"),
        F.sum(F.when(live, F.col("cores")).otherwise(F.lit(0))).cast("long").alias("total_cores"),
        F.count(F.lit(1)).alias("executors_seen"),
    )


# A9 ----------------------------------------------------------------------
def time_extent(lc: Lifecycle) -> DataFrame:
    """First job start and the time of the last job/task event (canonical order ends on max t)."""
    first = lc.job_start.groupBy("app_id").agg(F.min("t").alias("first_job_start_ms"))
    ts = [lc.job_start, lc.job_end, lc.task_start, lc.task_end]
    last = None
    for d in ts:
        p = d.groupBy("app_id").agg(F.max("t").alias("latest_ms"))
        last = p if last is None else last.unionByName(p)
    last = last.groupBy("app_id").agg(F.max("latest_ms").alias("latest_ms"))
    return first.join(last, "app_id", "full")


# A10 ---------------------------------------------------------------------
def launch_per_stage(lc: Lifecycle) -> DataFrame:
    """First launch and last launch (what the frontend stores as 'firsttaskstart') per stage attempt."""
    return lc.task_start.groupBy("app_id", "stage_id", "stage_attempt").agg(
        F.min("t").alias("first_launch_ms"), F.max("t").alias("last_launch_ms")
    )


# A11 ---------------------------------------------------------------------
def jobs_by_group(jobs: DataFrame) -> DataFrame:
    """Jobs per job group; an absent group is a group of its own (NULL).

    The set itself is ``job_group_members`` (one row per member); a group may
    hold any number of jobs, so it is summarised, never collected into one row.
    """
    return jobs.groupBy("app_id", "job_group").agg(
        F.count(F.lit(1)).alias("num_jobs"),
        F.min("job_id").alias("first_job_id"),
        F.max("job_id").alias("last_job_id"),
        F.count_if(F.col("status") == "RUNNING").alias("running_jobs"),
    )


def job_group_members(jobs: DataFrame) -> DataFrame:
    return jobs.select("app_id", "job_group", "job_id")


# A12 ---------------------------------------------------------------------
def killed_by_reason(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """Killed task ends per (job, reason), jobs by the planned rule; pre-aggregated per stage first."""
    per_stage = (
        routable_task_ends(lc.task_end)
        .where(F.col("end_reason") == "TaskKilled")
        .groupBy("app_id", "stage_id", F.col("end_reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        job_stage_infos(jobs).select("app_id", "job_id", "stage_id")
        .join(per_stage, ["app_id", "stage_id"])
        .groupBy("app_id", "job_id", "reason")
        .agg(F.sum("n").cast("long").alias("num_killed"))
    )


def killed_by_reason_map(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """Same as a map column per job (the listener's declared shape)."""
    return killed_by_reason(lc, jobs).groupBy("app_id", "job_id").agg(
        F.map_from_entries(F.collect_list(F.struct("reason", "num_killed"))).alias("reason_to_num_killed")
    )


# A13 ---------------------------------------------------------------------
def executor_load(tasks: DataFrame) -> DataFrame:
    """Tasks and busy time per executor group (executorId-host)."""
    return tasks.groupBy("app_id", executor_group("executor_id", "host").alias("executor_group")).agg(
        F.count(F.lit(1)).alias("num_tasks"),
        F.count_if(F.col("status") == "FAILED").alias("failed_tasks"),
        F.sum(F.col("finish_ms") - F.col("launch_ms")).cast("long").alias("busy_ms"),
        F.max(F.col("finish_ms") - F.col("launch_ms")).alias("longest_ms"),
    )


# A21 ---------------------------------------------------------------------
def rollup_counters(tasks: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """The same task counters at app, job and stage level in one rollup.

    Paired tasks carry no job; they get the smallest id among the jobs that plan their stage (NULL if none
    does), so each task is counted once.
    """
    if "job_id" not in tasks.columns:
        if jobs is None:
            raise ValueError("tasks without job_id need the jobs table")
        owner = jobs.select("app_id", "job_id", F.explode("stage_ids").alias("stage_id"))
        owner = owner.groupBy("app_id", "stage_id").agg(F.min("job_id").alias("job_id"))
        tasks = tasks.join(owner, ["app_id", "stage_id"], "left")
    return tasks.rollup("app_id", "job_id", "stage_id").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("num_tasks"),
        F.count_if(F.col("status") == "SUCCESS").alias("completed_tasks"),
        F.count_if(F.col("status").isin("FAILED", "KILLED")).alias("failed_tasks"),
        F.count_if(F.col("status") == "RUNNING").alias("active_tasks"),
    )


def planned_task_counters(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """A1 under the frontend rule."""
    return attribute_planned(lc, jobs).groupBy("app_id", "job_id").agg(
        F.sum("n_started").cast("long").alias("n_started"),
        F.sum("n_succeeded").cast("long").alias("n_succeeded"),
        F.sum("n_failed").cast("long").alias("n_failed"),
    )
