"""Entity tables from lifecycle events: J1–J4, J7, W6, P6, P7.

Pairing is a union of the start and end projections followed by one
``groupBy`` on the entity key (one shuffle of the plain rows):
the start side is first-write-wins (``min_by`` on time), the end side
last-write-wins (``max_by``). An event whose time is missing still counts; one
with a time goes before it, and equal times are told apart by a hash of the
event. An end without a start still gives a row (placeholder: start fields
NULL), a start without an end is still running.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.sources.lifecycle import Lifecycle


def _typed_null(df: DataFrame, struct_col: Column) -> Column:
    dt = df.select(struct_col.alias("x")).schema["x"].dataType
    return F.lit(None).cast(dt)


def _parts(start: DataFrame, end: DataFrame, keys: list[str], start_fields: list, end_fields: list) -> DataFrame:
    """One row per event: the key and what it says of the start (``s``) or of the end (``e``)."""
    s_struct = F.struct(*start_fields)
    e_struct = F.struct(*end_fields)
    s = start.select(*keys, s_struct.alias("s"), _typed_null(end, e_struct).alias("e"))
    return s.unionByName(end.select(*keys, _typed_null(start, s_struct).alias("s"), e_struct.alias("e")))


def merge_parts(parts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row per key. Merging merged rows again, in any grouping and order, gives the same (live tables rely on it)."""
    first = F.struct(F.col("s.t").isNull(), F.col("s.t"), F.xxhash64("s"))
    last = F.struct(F.col("e.t").isNotNull(), F.col("e.t"), F.xxhash64("e"))
    # a key has few rows, so combining before the exchange saves nothing and would sort (and spill) all rows once more
    return parts.repartition(*keys).groupBy(*keys).agg(
        F.min_by("s", F.when(F.col("s").isNotNull(), first)).alias("s"),
        F.max_by("e", F.when(F.col("e").isNotNull(), last)).alias("e"),
        *more,
    )


# P6 ----------------------------------------------------------------------
def job_status(result: Column) -> Column:
    """Listener status: no end yet -> RUNNING, JobSucceeded -> SUCCEEDED, other result -> FAILED."""
    return F.when(result.isNull(), "RUNNING").when(result == "JobSucceeded", "SUCCEEDED").otherwise("FAILED")


def job_display_status(status: Column) -> Column:
    """Frontend status: SUCCEEDED is shown as COMPLETED."""
    return F.when(status == "SUCCEEDED", "COMPLETED").otherwise(status)


# P7 ----------------------------------------------------------------------
def stage_status(submitted: Column, completed: Column, failure_reason: Column) -> Column:
    return (
        F.when(completed & failure_reason.isNull(), "COMPLETED")
        .when(completed, "FAILED")
        .when(submitted, "RUNNING")
        .otherwise("PENDING")
    )


def task_status(end_reason: Column) -> Column:
    return (
        F.when(end_reason.isNull(), "RUNNING")
        .when(end_reason == "Success", "SUCCESS")
        .when(end_reason == "TaskKilled", "KILLED")
        .otherwise("FAILED")
    )


# J1 ----------------------------------------------------------------------
JOB_KEY = ["app_id", "job_id"]
START_OF_JOB = ["t", "job_group", "name", "call_site", "stage_ids", "stage_infos"]


def job_parts(lc: Lifecycle) -> DataFrame:
    return _parts(lc.job_start, lc.job_end, JOB_KEY, START_OF_JOB, ["t", "result"])


def pair_jobs(lc: Lifecycle) -> DataFrame:
    return jobs_of(merge_parts(job_parts(lc), JOB_KEY))


def pair_job_plans(lc: Lifecycle) -> DataFrame:
    """J1 for the jobs that have a start, cut to ``submission_ms, completion_ms, stage_ids``: the values of ``pair_jobs``, but of a
    start only its time, its stage ids and the hash of the whole event (which tells equal times apart) move, of an end its time."""
    s = lc.job_start.select(*JOB_KEY, F.lit(False).alias("is_end"), "t", F.xxhash64(F.struct(*START_OF_JOB)).alias("h"), "stage_ids")
    e = lc.job_end.select(*JOB_KEY, F.lit(True).alias("is_end"), "t", F.lit(None).cast("long").alias("h"), F.lit(None).cast("array<bigint>").alias("stage_ids"))
    is_end = F.col("is_end")
    merged = s.unionByName(e).repartition(*JOB_KEY).groupBy(*JOB_KEY).agg(
        F.min_by(F.struct("t", "stage_ids"), F.when(~is_end, F.struct(F.col("t").isNull(), "t", "h"))).alias("s"),
        F.max(F.when(is_end, F.col("t"))).alias("completion_ms"))
    return merged.where(F.col("s").isNotNull()).select(
        *JOB_KEY, F.col("s.t").alias("submission_ms"), "completion_ms", F.coalesce(F.col("s.stage_ids"), F.array().cast("array<bigint>")).alias("stage_ids"))


def jobs_of(merged: DataFrame, *more: str) -> DataFrame:
    return merged.select(
        "app_id", "job_id",
        F.col("s.job_group").alias("job_group"),
        F.col("s.name").alias("name"),
        F.col("s.call_site").alias("call_site"),
        job_status(F.col("e.result")).alias("status"),
        F.col("s.t").alias("submission_ms"),
        F.col("e.t").alias("completion_ms"),
        F.col("s").isNotNull().alias("has_start"),
        F.coalesce(F.col("s.stage_ids"), F.array().cast("array<bigint>")).alias("stage_ids"),
        F.col("s.stage_infos").alias("stage_infos"),
        *more,
    )


# J2 ----------------------------------------------------------------------
STAGE_KEY = ["app_id", "stage_id", "stage_attempt"]
COMPLETED_FIELDS = ["t", "submission_ms", "num_tasks", "failure_reason"]


def stage_parts(lc: Lifecycle) -> DataFrame:
    return _parts(lc.stage_submitted, lc.stage_completed, STAGE_KEY, ["t", "name", "num_tasks", "parent_ids"], COMPLETED_FIELDS)


def pair_stages(lc: Lifecycle) -> DataFrame:
    return stages_of(merge_parts(stage_parts(lc), STAGE_KEY))


def pair_stage_status(lc: Lifecycle) -> DataFrame:
    """J2 cut to the status: the rows of ``pair_stages`` with their key and status. Of a submission only its key moves, of a
    completion its time, the hash of the whole event and whether it failed; the rows of a stage's attempts lie together."""
    s = lc.stage_submitted.select(*STAGE_KEY, F.lit(None).cast("struct<timed:boolean,t:bigint,h:bigint>").alias("last"), F.lit(None).cast("boolean").alias("failed"))
    e = lc.stage_completed.select(
        *STAGE_KEY, F.struct(F.col("t").isNotNull().alias("timed"), "t", F.xxhash64(F.struct(*COMPLETED_FIELDS)).alias("h")).alias("last"),
        F.col("failure_reason").isNotNull().alias("failed"))
    merged = s.unionByName(e).repartition("app_id", "stage_id").groupBy(*STAGE_KEY).agg(
        F.count_if(F.col("last").isNull()).alias("n_submitted"), F.max_by("failed", "last").alias("failed"))
    reason = F.when(F.col("failed"), "failed")
    return merged.select(*STAGE_KEY, stage_status(F.col("n_submitted") > 0, F.col("failed").isNotNull(), reason).alias("status"))


def stages_of(merged: DataFrame, *more: str) -> DataFrame:
    return merged.select(
        "app_id", "stage_id", "stage_attempt",
        F.col("s.name").alias("name"),
        F.coalesce(F.col("s.num_tasks"), F.col("e.num_tasks")).alias("num_tasks"),
        F.coalesce(F.col("s.t"), F.col("e.submission_ms")).alias("submission_ms"),
        F.col("e.t").alias("completion_ms"),
        stage_status(F.col("s").isNotNull(), F.col("e").isNotNull(), F.col("e.failure_reason")).alias("status"),
        F.col("e.failure_reason").alias("failure_reason"),
        F.coalesce(F.col("s.parent_ids"), F.array().cast("array<bigint>")).alias("parent_ids"),
        *more,
    )


# J3 ----------------------------------------------------------------------
TASK_INFO = ["stage_id", "stage_attempt", "task_index", "attempt", "executor_id", "host", "speculative"]


TASK_KEY = ["app_id", "task_id"]
START_FIELDS = ["t", *TASK_INFO]
END_FIELDS = ["t", "launch_ms", *TASK_INFO, "task_type", "end_reason", "error_message", "getting_result_at", "metrics"]


def task_parts(lc: Lifecycle) -> DataFrame:
    return _parts(lc.task_start, lc.task_end, TASK_KEY, START_FIELDS, END_FIELDS)


def pair_tasks(lc: Lifecycle) -> DataFrame:
    return tasks_of(merge_parts(task_parts(lc), TASK_KEY))


def pair_task_info(lc: Lifecycle, *info: str) -> DataFrame:
    """J3 for some columns of ``TASK_INFO``: the rows and values of ``pair_tasks``, but only these columns, the event's time
    and the hash of the whole event (which tells equal times apart) move."""

    def part(events: DataFrame, is_end: bool, *fields: str) -> DataFrame:
        return events.select(*TASK_KEY, F.lit(is_end).alias("is_end"), "t", F.xxhash64(F.struct(*fields)).alias("h"), *info)

    parts = part(lc.task_start, False, *START_FIELDS).unionByName(part(lc.task_end, True, *END_FIELDS))
    is_end, x = F.col("is_end"), F.struct(*info)
    merged = parts.repartition(*TASK_KEY).groupBy(*TASK_KEY).agg(
        F.min_by(x, F.when(~is_end, F.struct(F.col("t").isNull(), "t", "h"))).alias("s"),
        F.max_by(x, F.when(is_end, F.struct(F.col("t").isNotNull(), "t", "h"))).alias("e"))
    return merged.select(*TASK_KEY, *[F.coalesce(F.col(f"s.{c}"), F.col(f"e.{c}")).alias(c) for c in info])


def tasks_of(merged: DataFrame, *more: str) -> DataFrame:
    info = [F.coalesce(F.col(f"s.{c}"), F.col(f"e.{c}")).alias(c) for c in TASK_INFO]
    return merged.select(
        "app_id", "task_id", *info,
        task_status(F.col("e.end_reason")).alias("status"),
        F.coalesce(F.col("s.t"), F.col("e.launch_ms")).alias("launch_ms"),
        F.col("e.t").alias("finish_ms"),
        F.col("e.task_type").alias("task_type"),
        F.col("e.end_reason").alias("end_reason"),
        F.col("e.error_message").alias("error_message"),
        F.col("e.getting_result_at").alias("getting_result_at"),
        F.col("e.metrics").alias("metrics"),
        F.col("s").isNotNull().alias("has_start"),
        *more,
    )


# J4 ----------------------------------------------------------------------
def pair_executors(lc: Lifecycle) -> DataFrame:
    """Added left-joined with removed (one groupBy); cores of an unknown executor count 0."""
    parts = _parts(lc.exec_added, lc.exec_removed, ["app_id", "executor_id"], ["t", "host", "cores"], ["t", "reason"])
    return merge_parts(parts, ["app_id", "executor_id"]).select(
        "app_id", "executor_id",
        F.col("s.host").alias("host"),
        F.coalesce(F.col("s.cores"), F.lit(0).cast("long")).alias("cores"),
        F.col("s.t").alias("added_ms"),
        F.col("e.t").alias("removed_ms"),
        F.col("e.reason").alias("removed_reason"),
    )


class Paired:
    """The four entity tables of a lifecycle, each paired when asked for."""

    def __init__(self, lc):
        self._lc = lc

    jobs = property(lambda self: pair_jobs(self._lc))
    stages = property(lambda self: pair_stages(self._lc))
    tasks = property(lambda self: pair_tasks(self._lc))
    executors = property(lambda self: pair_executors(self._lc))


# J7 / X1 -----------------------------------------------------------------
def job_stage_infos(jobs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per (job, planned stage) from the stage infos of the job start.

    ``carry`` names job columns to keep on every row (saves a join back to the jobs).
    """
    return jobs.select("app_id", "job_id", "submission_ms", *carry, F.explode("stage_infos").alias("i")).select(
        "app_id", "job_id", "submission_ms", *carry,
        F.col("i.stage_id").alias("stage_id"),
        F.col("i.num_tasks").alias("num_tasks"),
        F.col("i.name").alias("name"),
        F.col("i.completion_ms").alias("completion_known_ms"),
    )


def explode_stage_ids(jobs: DataFrame) -> DataFrame:
    """(job, stage id) from the plain id list."""
    return jobs.select("app_id", "job_id", F.explode("stage_ids").alias("stage_id"))


def stage_info_map(jobs: DataFrame) -> DataFrame:
    """The job's stage infos as a map keyed by stage id."""
    return jobs.select(
        "app_id", "job_id",
        F.map_from_entries(F.transform("stage_infos", lambda i: F.struct(i["stage_id"], i))).alias("stage_info_map"),
    )


# W6 ----------------------------------------------------------------------
def first_last_stage_info(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Stage info as the listener keeps it: the first job start that plans a stage wins
    (getOrElseUpdate), later submit/complete events overwrite (last write wins)."""
    i = job_stage_infos(jobs)
    first = i.groupBy("app_id", "stage_id").agg(
        F.min_by("num_tasks", F.struct("submission_ms", "job_id")).alias("first_info_tasks"),
        F.min_by("job_id", F.struct("submission_ms", "job_id")).alias("first_planner"),
    )
    last = stages.groupBy("app_id", "stage_id").agg(
        F.max_by("name", F.struct(F.coalesce("completion_ms", "submission_ms"), "stage_attempt")).alias("last_name"),
        F.max_by("status", F.struct(F.coalesce("completion_ms", "submission_ms"), "stage_attempt")).alias("last_status"),
    )
    return first.join(last, ["app_id", "stage_id"], "left")
