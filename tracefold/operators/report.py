"""The job table: T1 with P4, P5, P8, P9, P18, P19 (frontend counting rules).

One row per job in id order. Task counts use the planned rule (J5), stage
counts the per-event rule (A6), totals are reduced by skipped stages (A2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.columns import duration_ms, format_duration, short_name
from tracefold.operators.attribution import task_deltas
from tracefold.operators.counters import _stage_events
from tracefold.operators.entities import job_display_status, job_stage_infos
from tracefold.sources.lifecycle import Lifecycle


def job_name_or_stage(jobs: DataFrame) -> DataFrame:
    """P4 + P5: short name; the name "null" is replaced by the short name of the largest planned stage."""
    last = job_stage_infos(jobs).groupBy("app_id", "job_id").agg(F.max_by("name", "stage_id").alias("_last_stage_name"))
    j = jobs.join(last, ["app_id", "job_id"], "left")
    sn = short_name(F.col("name"))
    # "null" on the wire and NULL after ingest (P1) both mean: no name
    return j.withColumn("display_name", F.when(sn.isNull() | (sn == "null"), short_name(F.col("_last_stage_name")))
                        .otherwise(sn)).drop(
        "_last_stage_name")


def progress_text(completed: Column, active: Column, total: Column) -> Column:
    """``c + a / n`` (the active part only when a > 0), NULL when n is 0."""
    txt = F.concat(
        completed.cast("string"),
        F.when(active > 0, F.concat(F.lit(" + "), active.cast("string"), F.lit(" "))).otherwise(F.lit("")),
        F.lit(" / "), total.cast("string"),
    )
    return F.when(total > 0, txt)


def progress_pct(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def stage_summary_text(done: Column, total: Column, skipped: Column, active: Column) -> Column:
    """``done/total`` + `` (k skipped)`` or 8 blanks + ``(a active) `` when a > 0."""
    return F.concat(
        done.cast("string"), F.lit("/"), total.cast("string"),
        F.when(skipped > 0, F.concat(F.lit(" ("), skipped.cast("string"), F.lit(" skipped)"))).otherwise(F.lit(" " * 8)),
        F.when(active > 0, F.concat(F.lit("("), active.cast("string"), F.lit(" active) "))).otherwise(F.lit("")),
    )


def job_table(lc: Lifecycle, jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """T1 in narrow shuffles: strings of a job move once, with its own row.

    1. Per (app, stage), each as an aggregate of its own that carries only its numbers: task counts and stage events,
       the last status, the task count of the job that planned it first.
    2. The (job, stage) pairs, ids and times only, are joined to those facts on (app, stage).
    3. One ``groupBy(app, job)`` over the pairs' results and the jobs computes all counters, texts and the stage list.
    """
    stage = ["app_id", "stage_id"]
    none, z = F.lit(None), F.lit(0).cast("long")
    td = task_deltas(lc).select(
        *stage, "n_started", "n_succeeded", "n_failed", none.cast("long").alias("sub_t"), F.lit(0).alias("subs"),
        F.lit(0).alias("oks"), F.lit(0).alias("fails"))
    se = _stage_events(lc).select(
        *stage, F.lit(0).alias("n_started"), F.lit(0).alias("n_succeeded"), F.lit(0).alias("n_failed"),
        F.when(F.col("is_submit"), F.col("t")).alias("sub_t"), F.col("is_submit").cast("int").alias("subs"),
        (~F.col("is_submit") & ~F.col("failed")).cast("int").alias("oks"), F.col("failed").cast("int").alias("fails"))
    facts = td.unionByName(se).groupBy(*stage).agg(
        F.sum("n_started").alias("n_started"), F.sum("n_succeeded").alias("n_succeeded"), F.sum("n_failed").alias("n_failed"),
        F.min("sub_t").alias("first_sub"), F.sum("subs").alias("subs"), F.sum("oks").alias("oks"), F.sum("fails").alias("fails"))
    last = stages.groupBy(*stage).agg(F.max_by("status", F.col("stage_attempt").cast("int")).alias("last_status"))
    p = jobs.select("app_id", "job_id", "submission_ms", "completion_ms", F.explode("stage_infos").alias("i")).select(
        "app_id", "job_id", "submission_ms", "completion_ms", F.col("i.stage_id").alias("stage_id"), F.col("i.num_tasks").alias("num_tasks"))
    p = p.where(F.col("stage_id").isNotNull())
    planned = p.groupBy(*stage).agg(F.min_by("num_tasks", F.struct("submission_ms", "job_id")).alias("first_info_tasks"))
    pj = p.drop("submission_ms").join(facts, stage, "left").join(last, stage, "left").join(planned, stage, "left")
    # J8 listener rule: no submission of the stage before the job end (a submission at the same ms comes first)
    skipped = F.col("completion_ms").isNotNull() & (F.col("first_sub").isNull() | (F.col("first_sub") > F.col("completion_ms")))
    st = F.when(skipped, "SKIPPED").otherwise(F.coalesce("last_status", F.lit("PENDING")))
    found = pj.select(
        "app_id", "job_id", F.struct("stage_id", st.alias("st")).alias("stage"), F.col("n_succeeded").alias("c"),
        (F.col("n_started") - F.col("n_succeeded") - F.col("n_failed")).alias("a"),
        F.when(skipped, 1).otherwise(0).alias("ss"),
        F.when(skipped, F.coalesce("first_info_tasks", "num_tasks")).alias("stk"),
        (F.col("subs") - F.col("oks") - F.col("fails")).alias("act_st"), F.col("oks").alias("done_st"))
    infos = F.coalesce("stage_infos", F.array())
    own = jobs.select(
        "app_id", "job_id", "name", "status", "submission_ms", "completion_ms",
        F.aggregate(infos, z, lambda n, i: n + F.when(i["completion_ms"].isNull(), F.coalesce(i["num_tasks"], z)).otherwise(z)).alias("num_tasks"),
        F.size(F.filter(infos, lambda i: i["stage_id"].isNotNull())).alias("num_stages"),
        F.array_max(F.transform(F.filter(infos, lambda i: i["stage_id"].isNotNull()), lambda i: F.struct(i["stage_id"], i["name"].alias("name")))).alias("last_stage"))
    # rows of a job lie in many places, so combining before the exchange would only widen them
    rows = own.unionByName(found, allowMissingColumns=True).repartition("app_id", "job_id")
    total = lambda c: F.coalesce(F.sum(c), z).cast("long").alias(c)
    g = rows.groupBy("app_id", "job_id").agg(
        *[F.any_value(c, True).alias(c) for c in ("name", "status", "submission_ms", "completion_ms")],
        *[total(c) for c in ("c", "a", "num_tasks", "num_stages", "ss", "stk", "act_st", "done_st")],
        F.max("last_stage")["name"].alias("last_stage_name"),
        F.array_join(F.transform(F.sort_array(F.collect_list("stage")),
                                 lambda x: F.concat(x["stage_id"].cast("string"), F.lit(":"), x["st"])), ",").alias("stage_list"),
    )
    sn = short_name(F.col("name"))
    name = F.when(sn.isNull() | (sn == "null"), short_name(F.col("last_stage_name"))).otherwise(sn)
    n = F.col("num_tasks") - F.col("stk")
    c, a = F.col("c"), F.col("a")
    dur = F.when(F.col("status") != "RUNNING", duration_ms("submission_ms", "completion_ms"))
    return g.select(
        "app_id", "job_id", name.alias("name"),
        job_display_status(F.col("status")).alias("status"),
        "submission_ms", dur.alias("duration_ms"), format_duration(dur).alias("duration_text"),
        progress_text(c, a, n).alias("progress_text"),
        progress_pct(c, n).alias("completed_pct"), progress_pct(a, n).alias("active_pct"),
        stage_summary_text(F.col("done_st"), F.col("num_stages") - F.col("ss"), F.col("ss"), F.col("act_st"))
        .alias("stages_text"),
        F.when(F.col("num_stages") > 0, F.col("stage_list")).alias("stage_list"),
    )
