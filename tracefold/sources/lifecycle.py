"""Typed lifecycle events: the common model of every source.

A ``Lifecycle`` is ten DataFrames, one per event kind, every one keyed by
``app_id`` and carrying its event time ``t`` (epoch ms). Readers of event
logs, of framed messages and the test-data adapter all produce it; the
pairing operators turn it into entity tables.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_TYPE = T.StructType([
    T.StructField("run_ms", T.LongType()),
    T.StructField("deser_ms", T.LongType()),
    T.StructField("ser_ms", T.LongType()),
    T.StructField("fetch_wait_ms", T.LongType()),
    T.StructField("shuffle_write_ns", T.LongType()),
    T.StructField("result_size", T.LongType()),
    T.StructField("gc_ms", T.LongType()),
    T.StructField("memory_spilled", T.LongType()),
    T.StructField("disk_spilled", T.LongType()),
    T.StructField("peak_memory", T.LongType()),
])

STAGE_INFO_TYPE = T.StructType([
    T.StructField("stage_id", T.LongType()),
    T.StructField("num_tasks", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("completion_ms", T.LongType()),
])


@dataclass
class Lifecycle:
    app_start: DataFrame  # app_id, t, app_name, user, attempt_id
    app_end: DataFrame  # app_id, t
    job_start: DataFrame  # app_id, job_id, t, job_group, name, call_site, stage_ids, stage_infos
    job_end: DataFrame  # app_id, job_id, t, result
    stage_submitted: DataFrame  # app_id, stage_id, stage_attempt, t, name, num_tasks, parent_ids
    stage_completed: DataFrame  # app_id, stage_id, stage_attempt, t, submission_ms, num_tasks, failure_reason
    task_start: DataFrame  # app_id, stage_id, stage_attempt, task_id, task_index, attempt, executor_id, host, speculative, t
    task_end: DataFrame  # task_start cols + launch_ms, task_type, end_reason, error_message, getting_result_at, metrics
    exec_added: DataFrame  # app_id, executor_id, t, host, cores
    exec_removed: DataFrame  # app_id, executor_id, t, reason

    def kinds(self) -> list[str]:
        return [f.name for f in fields(self)]


class TraceEvents:
    """The test-data entity tables split into their start/end events, table by table (as ``Lifecycle``, each when asked for)."""

    def __init__(self, tr):
        self._tr = tr

    @cached_property
    def _infos(self) -> DataFrame:
        # stage infos as the job start sees them: completion known only if it came before the job start
        sc = self._tr.stages.select("app_id", "stage_id", F.col("completion_ms").alias("stage_completion_ms"))
        js = self._tr.jobs.select("app_id", "job_id", "submission_ms")
        return (
            self._tr.planned.join(js, ["app_id", "job_id"])
            .join(sc, ["app_id", "stage_id"], "left")
            .groupBy("app_id", "job_id")
            .agg(
                F.sort_array(F.collect_list("stage_id")).alias("stage_ids"),
                F.sort_array(F.collect_list(F.struct(
                    F.col("stage_id"),
                    F.col("planned_tasks").cast("long").alias("num_tasks"),
                    F.col("stage_name").alias("name"),
                    F.when(F.col("stage_completion_ms") < F.col("submission_ms"), F.col("stage_completion_ms")).alias("completion_ms"),
                ))).alias("stage_infos"),
            )
        )

    @cached_property
    def job_start(self) -> DataFrame:
        return self._tr.jobs.join(self._infos, ["app_id", "job_id"], "left").select(
            "app_id", "job_id", F.col("submission_ms").alias("t"), "job_group", "name", "call_site",
            F.coalesce("stage_ids", F.array().cast("array<bigint>")).alias("stage_ids"),
            F.coalesce("stage_infos", F.array().cast(T.ArrayType(STAGE_INFO_TYPE))).alias("stage_infos"),
        )

    @cached_property
    def job_end(self) -> DataFrame:
        return self._tr.jobs.where(F.col("completion_ms").isNotNull()).select(
            "app_id", "job_id", F.col("completion_ms").alias("t"),
            F.when(F.col("status") == "SUCCEEDED", "JobSucceeded").otherwise("JobFailed").alias("result"),
        )

    @cached_property
    def stage_submitted(self) -> DataFrame:
        return self._tr.stages.select(
            "app_id", "stage_id", "stage_attempt", F.col("submission_ms").alias("t"), "name",
            F.col("num_tasks").cast("long").alias("num_tasks"), "parent_ids",
        )

    @cached_property
    def stage_completed(self) -> DataFrame:
        return self._tr.stages.where(F.col("completion_ms").isNotNull()).select(
            "app_id", "stage_id", "stage_attempt", F.col("completion_ms").alias("t"), "submission_ms",
            F.col("num_tasks").cast("long").alias("num_tasks"),
            F.when(F.col("status") == "FAILED", F.lit("Stage failed: more than half of the task attempts failed")).alias("failure_reason"),
        )

    @staticmethod
    def _task_info() -> list:
        return ["app_id", "stage_id", "stage_attempt", "task_id", "task_index", "attempt",
                F.col("executor_id").cast("string").alias("executor_id"), "host", F.lit(False).alias("speculative")]

    @cached_property
    def task_start(self) -> DataFrame:
        return self._tr.tasks.select(*self._task_info(), F.col("launch_ms").alias("t"))

    @cached_property
    def task_end(self) -> DataFrame:
        metrics = F.when(F.col("has_metrics") == 1, F.struct(
            "run_ms", "deser_ms", "ser_ms", "fetch_wait_ms", "shuffle_write_ns",
            F.lit(0).cast("long").alias("result_size"), F.lit(0).cast("long").alias("gc_ms"),
            F.lit(0).cast("long").alias("memory_spilled"), F.lit(0).cast("long").alias("disk_spilled"),
            F.lit(0).cast("long").alias("peak_memory"),
        ))
        return self._tr.tasks.where(F.col("finish_ms").isNotNull()).select(
            *self._task_info(), F.col("finish_ms").alias("t"), "launch_ms", F.lit("ResultTask").alias("task_type"), "end_reason",
            F.lit(None).cast("string").alias("error_message"), "getting_result_at", metrics.alias("metrics"),
        )

    @cached_property
    def exec_added(self) -> DataFrame:
        return self._tr.executors.select("app_id", F.col("executor_id").cast("string").alias("executor_id"),
                                         F.col("added_ms").alias("t"), "host", F.col("cores").cast("long").alias("cores"))

    @cached_property
    def exec_removed(self) -> DataFrame:
        return self._tr.executors.where(F.col("removed_ms").isNotNull()).select(
            "app_id", F.col("executor_id").cast("string").alias("executor_id"), F.col("removed_ms").alias("t"),
            F.lit("decommissioned").alias("reason"),
        )

    @cached_property
    def _apps(self) -> DataFrame:
        return self._tr.jobs.groupBy("app_id").agg(F.min("submission_ms").alias("t0"), F.max("completion_ms").alias("t1"))

    @cached_property
    def app_start(self) -> DataFrame:
        return self._apps.select("app_id", (F.col("t0") - 1000).alias("t"),
                                 F.concat(F.lit("app-"), F.col("app_id").cast("string")).alias("app_name"),
                                 F.lit("tracefold").alias("user"), F.lit(None).cast("string").alias("attempt_id"))

    @cached_property
    def app_end(self) -> DataFrame:
        return self._apps.select("app_id", (F.col("t1") + 1000).alias("t"))


def from_trace(tr) -> Lifecycle:
    """Split the test-data entity tables into their start/end events."""
    ev = TraceEvents(tr)
    return Lifecycle(*[getattr(ev, f.name) for f in fields(Lifecycle)])
