"""Attribution of stage and task events to jobs: J5, J6, J8, J12, J13.

Two rules exist (SURVEY §7.3):

* ``planned`` (frontend): an event on stage s counts for every job that
  planned s, at any time. Counts are pre-aggregated per stage and only then
  joined to the (job, stage) pairs, so the task table is never fanned out.
* ``active`` (listener): it counts only for jobs active at the event, i.e.
  job start < event < job end in canonical order. Instead of an interval
  join of tasks x jobs, the job start/end markers are put into the stage's
  event stream and one bucketed running count per (app, stage) gives each
  marker the number of events before it; a job's count is end - start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.entities import job_stage_infos
from tracefold.operators.series import K_JOB_END, K_JOB_START, K_STAGE_SUBMITTED, K_TASK_END, K_TASK_START
from tracefold.operators.sweep import running_sums
from tracefold.sources.lifecycle import Lifecycle

END_OF_TIME = 9_000_000_000_000_000  # ms, later than any event
TASK_COUNTS = ["n_started", "n_succeeded", "n_failed", "n_killed"]
MARKS = 4  # an event's kind and what else a sweep asks of it, in one number


def kind_of(mark: Column) -> Column:
    return F.shiftright(mark, 2)


def task_deltas(lc: Lifecycle) -> DataFrame:
    """Task starts and routable task ends as count deltas, one row per event.

    P24: an end whose stage attempt is -1 (or unknown) is not counted.
    """
    s = lc.task_start.select(
        "app_id", "stage_id", "t", F.lit(K_TASK_START).alias("kind_rank"), F.col("task_id").alias("eid"),
        F.lit(1).alias("n_started"), F.lit(0).alias("n_succeeded"), F.lit(0).alias("n_failed"), F.lit(0).alias("n_killed"),
    )
    ok = F.col("end_reason") == "Success"
    killed = F.col("end_reason") == "TaskKilled"
    e = routable_task_ends(lc.task_end).select(
        "app_id", "stage_id", "t", F.lit(K_TASK_END).alias("kind_rank"), F.col("task_id").alias("eid"),
        F.lit(0).alias("n_started"),
        ok.cast("int").alias("n_succeeded"),
        (~ok).cast("int").alias("n_failed"),
        killed.cast("int").alias("n_killed"),
    )
    return s.unionByName(e)


def routable_task_ends(task_end: DataFrame) -> DataFrame:
    """Task ends the counters may use."""
    return task_end.where(F.col("stage_attempt").isNotNull() & (F.col("stage_attempt") != -1))


def stage_task_totals(lc: Lifecycle) -> DataFrame:
    """Per (app, stage): all task counts, pre-aggregated (map-side combine)."""
    return task_deltas(lc).groupBy("app_id", "stage_id").agg(*[F.sum(c).alias(c) for c in TASK_COUNTS])


def planned_pairs(jobs: DataFrame) -> DataFrame:
    """(job, stage) pairs with the job's interval in canonical order."""
    return job_stage_infos(jobs).select("app_id", "job_id", "stage_id", "num_tasks")


def attribute_planned(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """Per (job, stage) the task counts of the stage (frontend rule)."""
    pairs = planned_pairs(jobs)
    tot = stage_task_totals(lc)
    out = pairs.join(tot, ["app_id", "stage_id"], "left")
    return out.select("app_id", "job_id", "stage_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in TASK_COUNTS])


def attribute_active(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """Per (job, stage) the task counts of events inside the job's active interval."""
    pairs = job_stage_infos(jobs, ("completion_ms", "has_start")).withColumnRenamed("completion_ms", "end_t").where(
        F.col("has_start") & F.col("submission_ms").isNotNull())
    # a row is (app, stage, time, mark, id); a mark is the event's kind and, for a task end, its outcome
    started, ended, began, over = (k * MARKS for k in (K_TASK_START, K_TASK_END, K_JOB_START, K_JOB_END))
    reason = F.col("end_reason")
    outcome = F.when(reason == "Success", 1).when(reason == "TaskKilled", 3).when(reason.isNotNull(), 2).otherwise(0)
    row = lambda df, t, mark, eid: df.select("app_id", "stage_id", t.alias("t"), mark.alias("mark"), F.col(eid).alias("eid"))
    # a job still running counts everything after its start: its end marker sits after every event,
    # so the same sweep yields the stage total and no second pass over the task events is needed
    u = (
        row(lc.task_start, F.col("t"), F.lit(started), "task_id")
        .unionByName(row(routable_task_ends(lc.task_end), F.col("t"), F.lit(ended) + outcome, "task_id"))
        .unionByName(row(pairs, F.col("submission_ms"), F.lit(began), "job_id"))
        .unionByName(row(pairs, F.coalesce("end_t", F.lit(END_OF_TIME)), F.lit(over), "job_id"))
    )
    mark = F.col("mark")
    counts = dict(zip(TASK_COUNTS, [c.cast("int") for c in (
        mark == started, mark == ended + 1, mark.isin(ended + 2, ended + 3), mark == ended + 3)], strict=True))
    r = running_sums(u, ["app_id", "stage_id"], "t", counts, tiebreak=[kind_of(mark), "eid"])
    marks = r.where(mark.isin(began, over) & F.col("eid").isNotNull()).groupBy("app_id", F.col("eid").alias("job_id"), "stage_id").agg(
        *[F.max(F.when(mark == began, F.col(f"{c}_run"))).alias(f"s_{c}") for c in TASK_COUNTS],
        *[F.max(F.when(mark == over, F.col(f"{c}_run"))).alias(f"e_{c}") for c in TASK_COUNTS],
    )
    return marks.select(
        "app_id", "job_id", "stage_id",
        *[(F.col(f"e_{c}") - F.col(f"s_{c}")).cast("long").alias(c) for c in TASK_COUNTS],
    )


def job_task_counts(lc: Lifecycle, jobs: DataFrame, mode: str = "active") -> DataFrame:
    """Per job: started / succeeded / failed / killed task events under the chosen rule."""
    per = attribute_active(lc, jobs) if mode == "active" else attribute_planned(lc, jobs)
    agg = per.groupBy("app_id", "job_id").agg(*[F.sum(c).cast("long").alias(c) for c in TASK_COUNTS])
    return jobs.select("app_id", "job_id").join(agg, ["app_id", "job_id"], "left").select(
        "app_id", "job_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in TASK_COUNTS]
    )


# J8 ----------------------------------------------------------------------
def skipped_stages(lc: Lifecycle, jobs: DataFrame, mode: str = "listener") -> DataFrame:
    """Planned stages never submitted by the time the job ended.

    ``listener``: no submission of the stage id (by any job) before the job end.
    ``replanned`` (frontend): every job start re-plans its stages as pending, so a
    stage is skipped for a job when no submission follows the latest planning of
    the stage (by any job) before this job's end. In set form, per (app, stage):
    running counts of plannings and submissions over planning, submission and
    job-end rows; the job end reads the index k of the latest planning and the
    submissions counted there, an equi-join on (app, stage, k) fetches the
    count at that planning, and the stage is skipped iff the two are equal.
    """
    pairs = job_stage_infos(jobs, ("completion_ms",))
    ended = pairs.where(F.col("completion_ms").isNotNull())
    subs = lc.stage_submitted.select("app_id", "stage_id", F.col("t").alias("sub_t"), "stage_attempt")
    # first stage info wins for the task count (first job start that planned it)
    first_info = pairs.groupBy("app_id", "stage_id").agg(
        F.min_by("num_tasks", F.struct("submission_ms", "job_id")).alias("info_tasks")
    )
    if mode == "listener":
        first_sub = subs.groupBy("app_id", "stage_id").agg(F.min("sub_t").alias("first_sub"))
        c = ended.join(first_sub, ["app_id", "stage_id"], "left")
        # a submission (kind 3) at the same ms as the job end (kind 7) comes first
        sk = c.where(F.col("first_sub").isNull() | (F.col("first_sub") > F.col("completion_ms")))
    elif mode == "replanned":
        row = lambda df, t, kind, eid: df.select("app_id", "stage_id", F.col(t).alias("t"), F.lit(kind).alias("kind_rank"), F.col(eid).cast("long").alias("eid"))
        events = (
            row(pairs.where(F.col("submission_ms").isNotNull()), "submission_ms", K_JOB_START, "job_id")
            .unionByName(row(subs, "sub_t", K_STAGE_SUBMITTED, "stage_attempt"))
            .unionByName(row(ended, "completion_ms", K_JOB_END, "job_id"))
        )
        kind = F.col("kind_rank")
        counts = {"d_plan": (kind == K_JOB_START).cast("int"), "d_sub": (kind == K_STAGE_SUBMITTED).cast("int")}
        r = running_sums(events, ["app_id", "stage_id"], "t", counts, tiebreak=["kind_rank", "eid"])
        at_plan = r.where(kind == K_JOB_START).select(
            "app_id", "stage_id", F.col("d_plan_run").alias("k"), F.col("d_sub_run").alias("subs_at_plan"))
        at_end = r.where((kind == K_JOB_END) & F.col("eid").isNotNull()).select(
            "app_id", "stage_id", F.col("eid").alias("job_id"), F.col("d_plan_run").alias("k"),
            F.col("d_sub_run").alias("subs_at_end"))
        hit = at_end.join(at_plan, ["app_id", "stage_id", "k"]).where(F.col("subs_at_end") == F.col("subs_at_plan"))
        sk = ended.join(hit.select("app_id", "stage_id", "job_id"), ["app_id", "stage_id", "job_id"], "left_semi")
    else:
        raise ValueError(mode)
    return sk.join(first_info, ["app_id", "stage_id"], "left").select(
        "app_id", "job_id", "stage_id", F.coalesce("info_tasks", "num_tasks").alias("num_tasks")
    )


# J12 ---------------------------------------------------------------------
def unattributed(lc: Lifecycle, jobs: DataFrame) -> DataFrame:
    """Events whose parent is unknown, counted per kind: task events on a stage no job
    planned, stage events on such a stage, job ends without a start."""
    planned = job_stage_infos(jobs).select("app_id", "stage_id").distinct()
    ts = lc.task_start.select("app_id", "stage_id").join(planned, ["app_id", "stage_id"], "left_anti").select(
        "app_id", F.lit("task_start").alias("kind"))
    te = lc.task_end.select("app_id", "stage_id").join(planned, ["app_id", "stage_id"], "left_anti").select(
        "app_id", F.lit("task_end").alias("kind"))
    ss = lc.stage_submitted.select("app_id", "stage_id").join(planned, ["app_id", "stage_id"], "left_anti").select(
        "app_id", F.lit("stage_submitted").alias("kind"))
    je = jobs.where(~F.col("has_start")).select("app_id", F.lit("job_end").alias("kind"))
    return ts.unionByName(te).unionByName(ss).unionByName(je).groupBy("app_id", "kind").agg(
        F.count(F.lit(1)).alias("n_events"))


# J13 ---------------------------------------------------------------------
def stage_edges(stages: DataFrame) -> DataFrame:
    """Child -> parent stage edges with the parent's name (self join on the stage key)."""
    e = stages.select("app_id", "stage_id", "stage_attempt", "name", F.explode("parent_ids").alias("parent_id"))
    names = stages.groupBy("app_id", "stage_id").agg(F.max_by("name", "stage_attempt").alias("parent_name"))
    names = names.withColumnRenamed("stage_id", "parent_id")
    return e.join(names, ["app_id", "parent_id"], "left").select(
        "app_id", "stage_id", "stage_attempt", "parent_id", F.col("name").alias("stage_name"), "parent_name"
    )
