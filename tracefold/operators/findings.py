"""Findings for drill-down: stragglers (A16), failures (A17, P20, P26), slowest tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.columns import error_message
from tracefold.operators.sweep import running_sums

STAGE_KEY = ["app_id", "stage_id", "stage_attempt"]


def stage_median_duration(tasks: DataFrame, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Median task duration per stage attempt.

    Exact form, by rank: counts per (stage, duration), their running sum over the durations (bucketed, so a
    stage of any size is spread over tasks), and the one or two durations in whose ranks the middle lies. No
    group buffers its durations. ``approx=True`` uses ``percentile_approx`` (fixed memory per group).
    """
    d = tasks.where(F.col("finish_ms").isNotNull()).select(*STAGE_KEY, (F.col("finish_ms") - F.col("launch_ms")).alias("d"))
    if approx:
        return d.groupBy(*STAGE_KEY).agg(
            F.percentile_approx("d", 0.5, accuracy).cast("double").alias("median_ms"), F.count(F.lit(1)).alias("n_finished"))
    per_value = d.groupBy(*STAGE_KEY, "d").agg(F.count(F.lit(1)).alias("freq"))
    r = running_sums(per_value, STAGE_KEY, "d", ["freq"], total_suffix="_all")
    n, upto = F.col("freq_all"), F.col("freq_run")
    below = upto - F.col("freq")
    holds = lambda rank: (below <= rank) & (rank < upto)
    lower, upper = F.floor((n - 1) / 2), F.floor(n / 2)  # ranks from 0; the same one if n is odd
    middle = r.where(holds(lower) | holds(upper))
    return middle.groupBy(*STAGE_KEY).agg(
        ((F.min("d") + F.max("d")) / 2).cast("double").alias("median_ms"), F.max("freq_all").alias("n_finished"))


def stragglers(tasks: DataFrame, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """Finished tasks slower than ``factor`` x the median of their stage attempt, whatever its size."""
    med = stage_median_duration(tasks, approx)
    d = tasks.where(F.col("finish_ms").isNotNull()).select(
        *STAGE_KEY, "task_id", (F.col("finish_ms") - F.col("launch_ms")).alias("duration_ms"))
    j = d.join(med, STAGE_KEY)
    return j.where(F.col("duration_ms") > F.lit(factor) * F.col("median_ms")).select(
        *STAGE_KEY, "task_id", "duration_ms", "median_ms",
        (F.col("duration_ms") / F.col("median_ms")).alias("ratio"), "n_finished",
    )


def straggler_stages(tasks: DataFrame, factor: float = 1.5) -> DataFrame:
    """Stages held up by stragglers: count and worst ratio."""
    return stragglers(tasks, factor).groupBy(*STAGE_KEY).agg(
        F.count(F.lit(1)).alias("num_stragglers"), F.max("ratio").alias("max_ratio"))


def slowest_tasks(tasks: DataFrame, k: int = 10, by: str = "duration", per: tuple[str, ...] = ("app_id",),
                  salt_buckets: int = 64) -> DataFrame:
    """Top-k tasks per group by duration (or a phase column), ties by task id.

    Two levels: top-k within (group, task_id mod salt) first, so no single
    window partition holds a whole hot application; then top-k over those.
    """
    if by == "duration":
        t = tasks.where(F.col("finish_ms").isNotNull()).withColumn("metric_ms", F.col("finish_ms") - F.col("launch_ms"))
    else:
        t = tasks.where(F.col("phases").isNotNull()).withColumn("metric_ms", F.col(f"phases.{by}_ms"))
    t = t.select(*per, "task_id", "stage_id", "metric_ms")
    order = [F.col("metric_ms").desc(), F.col("task_id").asc()]
    salted = t.withColumn("_salt", F.pmod(F.col("task_id"), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*per, "_salt").orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*per).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


def failed_tasks(tasks: DataFrame) -> DataFrame:
    """P26 + P20: failed and killed tasks with their message (NULL text for successes)."""
    return tasks.where(F.col("status").isin("FAILED", "KILLED")).select(
        "app_id", "task_id", "stage_id", "stage_attempt", "status",
        error_message("end_reason", "error_message").alias("error_message"),
    )


def failure_summary(jobs: DataFrame, stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failed jobs, stages and tasks per reason: count and the first failing entity."""
    j = jobs.where(F.col("status") == "FAILED").select(
        "app_id", F.lit("job").alias("kind"), F.lit("JobFailed").alias("reason"),
        F.col("completion_ms").alias("t"), F.col("job_id").alias("entity_id"))
    s = stages.where(F.col("status") == "FAILED").select(
        "app_id", F.lit("stage").alias("kind"), F.coalesce("failure_reason", F.lit("unknown")).alias("reason"),
        F.col("completion_ms").alias("t"), F.col("stage_id").alias("entity_id"))
    t = tasks.where(F.col("status").isin("FAILED", "KILLED")).select(
        "app_id", F.lit("task").alias("kind"), F.col("end_reason").alias("reason"),
        F.col("finish_ms").alias("t"), F.col("task_id").alias("entity_id"))
    u = j.unionByName(s).unionByName(t)
    return u.groupBy("app_id", "kind", "reason").agg(
        F.count(F.lit(1)).alias("num_failed"),
        F.min_by("entity_id", F.struct("t", "entity_id")).alias("first_id"),
        F.min("t").alias("first_ms"),
    )
