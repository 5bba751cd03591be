"""Arrival order (T3), retention of finished jobs/stages (W4) and attempt history.

W4 in closed form: items are appended one at a time to a list limited to N;
on overflow the oldest ``max(N div 10, 1)`` are evicted (more if the list is
further over). After n appends, ``evicted(n) = 0`` if n <= N, else
``k * (1 + (n - N - 1) div k)`` with ``k = max(1, N div 10)``; an item with
arrival number a is kept iff ``a > evicted(n)``.
Arrival numbers are a bucketed running count (no window over a whole app).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.series import K_JOB_END, K_STAGE_COMPLETED
from tracefold.operators.sweep import running_sums



def finished_lists(jobs: DataFrame, stages: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Finished entities in the lists the listener keeps: (app_id, list, item_key, t, kind_rank, tiebreak)."""
    j = jobs.where(F.col("completion_ms").isNotNull()).select(
        "app_id", F.when(F.col("status") == "SUCCEEDED", "completedJobs").otherwise("failedJobs").alias("list"),
        F.col("job_id").cast("string").alias("item_key"), F.col("completion_ms").alias("t"),
        F.lit(K_JOB_END).alias("kind_rank"),
        F.struct(F.col("job_id").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("tiebreak"))
    s = stages.where(F.col("completion_ms").isNotNull()).select(
        "app_id", F.when(F.col("status") == "COMPLETED", "completedStages").otherwise("failedStages").alias("list"),
        F.concat(F.col("stage_id").cast("string"), F.lit("."), F.col("stage_attempt").cast("string")).alias("item_key"),
        F.col("completion_ms").alias("t"), F.lit(K_STAGE_COMPLETED).alias("kind_rank"),
        F.struct(F.col("stage_id").cast("long").alias("a"), F.col("stage_attempt").cast("long").alias("b")).alias("tiebreak"))
    out = j.unionByName(s)
    if skipped is not None:
        k = skipped.select(
            "app_id", F.lit("skippedStages").alias("list"), F.col("stage_id").cast("string").alias("item_key"),
            F.col("completion_ms").alias("t"), F.lit(K_JOB_END).alias("kind_rank"),
            F.struct(F.col("job_id").cast("long").alias("a"), F.col("stage_id").cast("long").alias("b")).alias("tiebreak"))
        out = out.unionByName(k)
    return out


def _arrivals(items: DataFrame) -> DataFrame:
    r = running_sums(items.withColumn("one", F.lit(1)), ["app_id", "list"], "t", ["one"],
                     tiebreak=["kind_rank", "tiebreak"], total_suffix="_total")
    return r.select("app_id", "list", "item_key", "t", F.col("one_run").alias("arrival_no"), F.col("one_total").alias("n"))


def arrival_order(items: DataFrame) -> DataFrame:
    """Arrival number per (app, list) in canonical order."""
    return _arrivals(items).drop("n")


def retain_recent(items: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows still retained after all appends, per (app, list)."""
    a = _arrivals(items)
    k = max(1, limit // 10)
    evicted = F.when(F.col("n") <= limit, F.lit(0)).otherwise(
        F.lit(k) * (F.lit(1) + F.expr(f"(n - {limit} - 1) div {k}")))
    return a.where(F.col("arrival_no") > evicted).select(
        "app_id", "list", "item_key", "arrival_no")


def attempt_history(tasks: DataFrame) -> DataFrame:
    """Attempts and speculative copies of one partition (stage, index), in attempt order.

    The window is per (app, stage, attempt, index): bounded by the retries of one partition.
    """
    w = Window.partitionBy("app_id", "stage_id", "stage_attempt", "task_index").orderBy("attempt", "task_id")
    return tasks.select(
        "app_id", "stage_id", "stage_attempt", "task_index", "attempt", "task_id", "status", "speculative",
        F.row_number().over(w).cast("long").alias("attempt_rank"),
        F.lag("status").over(w).alias("prev_status"),
        F.count(F.lit(1)).over(Window.partitionBy("app_id", "stage_id", "stage_attempt", "task_index")).alias("num_attempts"),
    )
