"""Queries: pairing, attribution and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import attribution, counters, entities
from tracefold.plans.context import Ctx
from tracefold.plans.oracle import with_adapter
from tracefold.plans.registry import register


@register("J1_pair_jobs", with_adapter(
    "SELECT app_id, job_id, job_group, name, call_site, status, submission_ms, completion_ms FROM v_jobs"))
def q_pair_jobs(spark, sf_dir):
    return Ctx(spark, sf_dir).jobs.select(
        "app_id", "job_id", "job_group", "name", "call_site", "status", "submission_ms", "completion_ms")


@register("J2_pair_stages", with_adapter(
    "SELECT app_id, stage_id, stage_attempt, name, num_tasks, submission_ms, completion_ms, status FROM v_stages"))
def q_pair_stages(spark, sf_dir):
    return Ctx(spark, sf_dir).stages.select(
        "app_id", "stage_id", "stage_attempt", "name", "num_tasks", "submission_ms", "completion_ms", "status")


@register("J3_pair_tasks", with_adapter(
    """SELECT app_id, task_id, stage_id, stage_attempt, task_index, attempt, CAST(executor_id AS VARCHAR) AS executor_id,
              host, status, launch_ms, finish_ms, end_reason FROM v_tasks"""))
def q_pair_tasks(spark, sf_dir):
    return Ctx(spark, sf_dir).tasks.select(
        "app_id", "task_id", "stage_id", "stage_attempt", "task_index", "attempt", "executor_id", "host",
        "status", "launch_ms", "finish_ms", "end_reason")


@register("J4_pair_executors", with_adapter(
    "SELECT app_id, CAST(executor_id AS VARCHAR) AS executor_id, host, cores, added_ms, removed_ms FROM v_executors"))
def q_pair_executors(spark, sf_dir):
    return Ctx(spark, sf_dir).executors.select("app_id", "executor_id", "host", "cores", "added_ms", "removed_ms")


@register("J7_job_stage_infos", with_adapter(
    "SELECT app_id, job_id, stage_id, CAST(planned_tasks AS BIGINT) AS num_tasks, stage_name AS name FROM v_planned"))
def q_job_stage_infos(spark, sf_dir):
    return entities.job_stage_infos(Ctx(spark, sf_dir).jobs).select("app_id", "job_id", "stage_id", "num_tasks", "name")


@register("X1_explode_stage_ids", with_adapter("SELECT app_id, job_id, stage_id FROM v_planned"))
def q_explode_stage_ids(spark, sf_dir):
    return entities.explode_stage_ids(Ctx(spark, sf_dir).jobs)


@register("X2_stage_info_map", with_adapter(
    """SELECT app_id, job_id, count(*) AS n_entries, arg_max(stage_name, stage_id) AS last_stage_name
       FROM v_planned GROUP BY app_id, job_id"""))
def q_stage_info_map(spark, sf_dir):
    m = entities.stage_info_map(Ctx(spark, sf_dir).jobs)
    return m.select(
        "app_id", "job_id", F.size("stage_info_map").cast("long").alias("n_entries"),
        F.col("stage_info_map")[F.array_max(F.map_keys("stage_info_map"))]["name"].alias("last_stage_name"),
    )


_TASK_EV = """
tev AS (
  SELECT app_id, stage_id, launch_ms AS t, 1 AS st, 0 AS ok, 0 AS fl, 0 AS kl FROM v_tasks
  UNION ALL
  SELECT app_id, stage_id, finish_ms AS t, 0, CASE WHEN end_reason = 'Success' THEN 1 ELSE 0 END,
         CASE WHEN end_reason <> 'Success' THEN 1 ELSE 0 END, CASE WHEN end_reason = 'TaskKilled' THEN 1 ELSE 0 END
  FROM v_tasks WHERE finish_ms IS NOT NULL AND stage_attempt <> -1)
"""

_ACTIVE_PAIRS = _TASK_EV + """,
act AS (
  SELECT p.app_id, p.job_id, p.stage_id,
         coalesce(sum(e.st), 0) AS n_started, coalesce(sum(e.ok), 0) AS n_succeeded,
         coalesce(sum(e.fl), 0) AS n_failed, coalesce(sum(e.kl), 0) AS n_killed
  FROM v_planned p JOIN v_jobs j ON p.app_id = j.app_id AND p.job_id = j.job_id
  LEFT JOIN tev e ON e.app_id = p.app_id AND e.stage_id = p.stage_id
       AND e.t >= j.submission_ms AND (j.completion_ms IS NULL OR e.t <= j.completion_ms)
  GROUP BY p.app_id, p.job_id, p.stage_id)
"""


@register("J5_attribute_planned", with_adapter(
    """SELECT p.app_id, p.job_id, p.stage_id, CAST(coalesce(n_started, 0) AS BIGINT) AS n_started,
              CAST(coalesce(n_succeeded, 0) AS BIGINT) AS n_succeeded, CAST(coalesce(n_failed, 0) AS BIGINT) AS n_failed,
              CAST(coalesce(n_killed, 0) AS BIGINT) AS n_killed
       FROM v_planned p LEFT JOIN tot ON tot.app_id = p.app_id AND tot.stage_id = p.stage_id""",
    _TASK_EV + """, tot AS (SELECT app_id, stage_id, sum(st) AS n_started, sum(ok) AS n_succeeded, sum(fl) AS n_failed,
                                   sum(kl) AS n_killed FROM tev GROUP BY app_id, stage_id)"""))
def q_attribute_planned(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return attribution.attribute_planned(c.lc, c.jobs)


@register("J6_attribute_active", with_adapter(
    """SELECT app_id, job_id, stage_id, CAST(n_started AS BIGINT) AS n_started, CAST(n_succeeded AS BIGINT) AS n_succeeded,
              CAST(n_failed AS BIGINT) AS n_failed, CAST(n_killed AS BIGINT) AS n_killed FROM act""", _ACTIVE_PAIRS))
def q_attribute_active(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return attribution.attribute_active(c.lc, c.jobs)


_NTASKS = """
ntasks AS (
  SELECT p.app_id, p.job_id, count(*) AS num_stages,
         sum(CASE WHEN s.completion_ms IS NOT NULL AND s.completion_ms < j.submission_ms THEN 0 ELSE p.planned_tasks END) AS num_tasks
  FROM v_planned p JOIN v_jobs j ON p.app_id = j.app_id AND p.job_id = j.job_id
  LEFT JOIN v_stages s ON s.app_id = p.app_id AND s.stage_id = p.stage_id
  GROUP BY p.app_id, p.job_id)
"""


@register("A1_job_task_counters", with_adapter(
    """SELECT j.app_id, j.job_id, CAST(coalesce(n.num_tasks, 0) AS BIGINT) AS num_tasks,
              CAST(coalesce(a.st - a.ok - a.fl, 0) AS BIGINT) AS active_tasks,
              CAST(coalesce(a.ok, 0) AS BIGINT) AS completed_tasks, CAST(coalesce(a.fl, 0) AS BIGINT) AS failed_tasks
       FROM v_jobs j LEFT JOIN ntasks n ON n.app_id = j.app_id AND n.job_id = j.job_id
       LEFT JOIN (SELECT app_id, job_id, sum(n_started) AS st, sum(n_succeeded) AS ok, sum(n_failed) AS fl
                  FROM act GROUP BY app_id, job_id) a ON a.app_id = j.app_id AND a.job_id = j.job_id""",
    _ACTIVE_PAIRS + "," + _NTASKS))
def q_job_task_counters(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.job_task_counters(c.lc, c.jobs, "active")


_SKIPPED = """
sk AS (
  SELECT p.app_id, p.job_id, p.stage_id, CAST(p.planned_tasks AS BIGINT) AS num_tasks
  FROM v_planned p JOIN v_jobs j ON p.app_id = j.app_id AND p.job_id = j.job_id
  LEFT JOIN v_stages s ON s.app_id = p.app_id AND s.stage_id = p.stage_id
  WHERE j.completion_ms IS NOT NULL AND (s.submission_ms IS NULL OR s.submission_ms > j.completion_ms))
"""


@register("J8_skipped_stages", with_adapter("SELECT app_id, job_id, stage_id, num_tasks FROM sk", _SKIPPED))
def q_skipped_stages(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return attribution.skipped_stages(c.lc, c.jobs, "listener")


@register("A2_job_skip_counters", with_adapter(
    """SELECT j.app_id, j.job_id, CAST(coalesce(n.num_stages, 0) AS BIGINT) AS num_stages,
              CAST(coalesce(k.ss, 0) AS BIGINT) AS skipped_stages, CAST(coalesce(k.st, 0) AS BIGINT) AS skipped_tasks,
              CAST(coalesce(n.num_stages, 0) - coalesce(k.ss, 0) AS BIGINT) AS effective_stages,
              CAST(coalesce(n.num_tasks, 0) - coalesce(k.st, 0) AS BIGINT) AS effective_tasks
       FROM v_jobs j LEFT JOIN ntasks n ON n.app_id = j.app_id AND n.job_id = j.job_id
       LEFT JOIN (SELECT app_id, job_id, count(*) AS ss, sum(num_tasks) AS st FROM sk GROUP BY app_id, job_id) k
         ON k.app_id = j.app_id AND k.job_id = j.job_id""",
    _SKIPPED + "," + _NTASKS))
def q_job_skip_counters(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.job_skip_counters(c.lc, c.jobs, "listener")


@register("A3_stage_task_counters", with_adapter(
    """SELECT s.app_id, s.stage_id, s.stage_attempt, s.num_tasks,
              CAST(count(*) - count(t.finish_ms) AS BIGINT) AS active_tasks,
              count(*) FILTER (WHERE t.end_reason = 'Success') AS completed_tasks,
              count(*) FILTER (WHERE t.end_reason <> 'Success') AS failed_tasks,
              count(*) FILTER (WHERE t.end_reason = 'TaskKilled') AS killed_tasks,
              count(DISTINCT CASE WHEN t.end_reason = 'Success' THEN t.task_index END) AS completed_indices
       FROM v_stages s JOIN v_tasks t ON t.app_id = s.app_id AND t.stage_id = s.stage_id AND t.stage_attempt = s.stage_attempt
       GROUP BY s.app_id, s.stage_id, s.stage_attempt, s.num_tasks"""))
def q_stage_task_counters(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.stage_task_counters(c.lc, c.stages)


@register("A4_distinct_completed_indices", with_adapter(
    """SELECT app_id, stage_id, stage_attempt, count(*) FILTER (WHERE end_reason = 'Success') AS completed_attempts,
              count(DISTINCT CASE WHEN end_reason = 'Success' THEN task_index END) AS completed_indices
       FROM v_tasks GROUP BY app_id, stage_id, stage_attempt"""))
def q_distinct_completed(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.stage_task_counters(c.lc, c.stages).select(
        "app_id", "stage_id", "stage_attempt", F.col("completed_tasks").alias("completed_attempts"), "completed_indices")


_STAGE_EV = """
sev AS (
  SELECT app_id, stage_id, submission_ms AS t, 3 AS k, true AS is_submit, false AS ok, false AS failed FROM v_stages
  UNION ALL
  SELECT app_id, stage_id, completion_ms AS t, 6 AS k, false, status = 'COMPLETED', status = 'FAILED'
  FROM v_stages WHERE completion_ms IS NOT NULL)
"""


@register("A5_job_stage_counters", with_adapter(
    """SELECT j.app_id, j.job_id, CAST(coalesce(a.active_stages, 0) AS BIGINT) AS active_stages,
              CAST(coalesce(a.completed_stages, 0) AS BIGINT) AS completed_stages,
              CAST(coalesce(a.failed_stages, 0) AS BIGINT) AS failed_stages
       FROM v_jobs j LEFT JOIN (
         SELECT app_id, job_id, sum(subs) - sum(comps) AS active_stages, count(*) FILTER (WHERE last_ok) AS completed_stages,
                sum(fails) AS failed_stages
         FROM (SELECT p.app_id, p.job_id, p.stage_id, count(*) FILTER (WHERE e.is_submit) AS subs, count(*) FILTER (WHERE NOT e.is_submit) AS comps,
                      count(*) FILTER (WHERE e.failed) AS fails, arg_max(e.ok, e.t * 10 + e.k) AS last_ok
               FROM v_planned p JOIN v_jobs j ON p.app_id = j.app_id AND p.job_id = j.job_id
               JOIN sev e ON e.app_id = p.app_id AND e.stage_id = p.stage_id
               WHERE (e.t > j.submission_ms OR (e.t = j.submission_ms AND e.k > 2))
                 AND (j.completion_ms IS NULL OR e.t < j.completion_ms OR (e.t = j.completion_ms AND e.k < 7))
               GROUP BY p.app_id, p.job_id, p.stage_id) x
         GROUP BY app_id, job_id) a ON a.app_id = j.app_id AND a.job_id = j.job_id""", _STAGE_EV))
def q_job_stage_counters(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.job_stage_counters(c.lc, c.jobs)


@register("A6_job_stage_counters_naive", with_adapter(
    """SELECT p.app_id, p.job_id,
              CAST(sum(coalesce(x.subs - x.oks - x.fails, 0)) AS BIGINT) AS active_stages,
              CAST(sum(coalesce(x.oks, 0)) AS BIGINT) AS completed_stages,
              CAST(sum(coalesce(x.fails, 0)) AS BIGINT) AS failed_stages
       FROM v_planned p LEFT JOIN (
         SELECT app_id, stage_id, count(*) FILTER (WHERE is_submit) AS subs, count(*) FILTER (WHERE NOT is_submit AND NOT failed) AS oks,
                count(*) FILTER (WHERE failed) AS fails FROM sev GROUP BY app_id, stage_id) x
         ON x.app_id = p.app_id AND x.stage_id = p.stage_id
       GROUP BY p.app_id, p.job_id""", _STAGE_EV))
def q_job_stage_counters_naive(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.job_stage_counters_naive(c.lc, c.jobs)


@register("A7_job_badges", with_adapter(
    """SELECT app_id, count(*) FILTER (WHERE status = 'RUNNING') AS running_jobs, count(*) FILTER (WHERE status = 'SUCCEEDED') AS completed_jobs,
              count(*) FILTER (WHERE status = 'FAILED') AS failed_jobs FROM v_jobs GROUP BY app_id"""))
def q_job_badges(spark, sf_dir):
    return counters.job_badges(Ctx(spark, sf_dir).jobs)


@register("A8_capacity_totals", with_adapter(
    """SELECT app_id, count(*) FILTER (WHERE removed_ms IS NULL AND added_ms IS NOT NULL) AS num_executors,
              CAST(sum(CASE WHEN removed_ms IS NULL THEN cores ELSE 0 END) AS BIGINT) AS total_cores,
              count(*) AS executors_seen FROM v_executors GROUP BY app_id"""))
def q_capacity_totals(spark, sf_dir):
    return counters.capacity_totals(Ctx(spark, sf_dir).executors)


@register("A9_time_extent", with_adapter(
    """SELECT j.app_id, j.first_job_start_ms, greatest(j.last_job_ms, t.last_task_ms) AS latest_ms
       FROM (SELECT app_id, min(submission_ms) AS first_job_start_ms,
                    greatest(max(submission_ms), max(completion_ms)) AS last_job_ms FROM v_jobs GROUP BY app_id) j
       JOIN (SELECT app_id, greatest(max(launch_ms), max(finish_ms)) AS last_task_ms FROM v_tasks GROUP BY app_id) t
         ON j.app_id = t.app_id"""))
def q_time_extent(spark, sf_dir):
    return counters.time_extent(Ctx(spark, sf_dir).lc)


@register("A10_launch_per_stage", with_adapter(
    """SELECT app_id, stage_id, stage_attempt, min(launch_ms) AS first_launch_ms, max(launch_ms) AS last_launch_ms
       FROM v_tasks GROUP BY app_id, stage_id, stage_attempt"""))
def q_launch_per_stage(spark, sf_dir):
    return counters.launch_per_stage(Ctx(spark, sf_dir).lc)


@register("A11_jobs_by_group", with_adapter(
    """SELECT app_id, job_group, count(*) AS num_jobs, min(job_id) AS first_job_id, max(job_id) AS last_job_id,
              count(*) FILTER (WHERE status = 'RUNNING') AS running_jobs
       FROM v_jobs GROUP BY app_id, job_group"""))
def q_jobs_by_group(spark, sf_dir):
    return counters.jobs_by_group(Ctx(spark, sf_dir).jobs)


@register("A12_killed_by_reason", with_adapter(
    """SELECT p.app_id, p.job_id, t.end_reason AS reason, count(*) AS num_killed
       FROM v_planned p JOIN v_tasks t ON t.app_id = p.app_id AND t.stage_id = p.stage_id
       WHERE t.end_reason = 'TaskKilled' AND t.finish_ms IS NOT NULL
       GROUP BY p.app_id, p.job_id, t.end_reason"""))
def q_killed_by_reason(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.killed_by_reason(c.lc, c.jobs)


@register("A13_executor_load", with_adapter(
    """SELECT app_id, concat_ws('-', CAST(executor_id AS VARCHAR), host) AS executor_group, count(*) AS num_tasks,
              count(*) FILTER (WHERE status = 'FAILED') AS failed_tasks, CAST(sum(finish_ms - launch_ms) AS BIGINT) AS busy_ms,
              max(finish_ms - launch_ms) AS longest_ms
       FROM v_tasks GROUP BY app_id, concat_ws('-', CAST(executor_id AS VARCHAR), host)"""))
def q_executor_load(spark, sf_dir):
    return counters.executor_load(Ctx(spark, sf_dir).tasks)


@register("A21_rollup_counters", with_adapter(
    """SELECT app_id, job_id, stage_id, CAST(GROUPING(app_id, job_id, stage_id) AS BIGINT) AS level,
              count(*) AS num_tasks, count(*) FILTER (WHERE status = 'SUCCESS') AS completed_tasks,
              count(*) FILTER (WHERE status IN ('FAILED', 'KILLED')) AS failed_tasks, count(*) FILTER (WHERE status = 'RUNNING') AS active_tasks
       FROM v_tasks GROUP BY ROLLUP (app_id, job_id, stage_id)"""))
def q_rollup_counters(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return counters.rollup_counters(c.tasks, c.jobs).withColumn("level", F.col("level").cast("long"))


@register("P24_routable_task_ends", with_adapter(
    """SELECT app_id, count(*) AS routable_ends FROM v_tasks
       WHERE finish_ms IS NOT NULL AND stage_attempt <> -1 GROUP BY app_id"""))
def q_routable(spark, sf_dir):
    lc = Ctx(spark, sf_dir).lc
    return attribution.routable_task_ends(lc.task_end).groupBy("app_id").agg(F.count(F.lit(1)).alias("routable_ends"))


@register("P25_missing_stages", with_adapter(
    """SELECT p.app_id, p.job_id, p.stage_id, CAST(p.planned_tasks AS BIGINT) AS num_tasks
       FROM v_planned p JOIN v_jobs j ON p.app_id = j.app_id AND p.job_id = j.job_id
       LEFT JOIN v_stages s ON s.app_id = p.app_id AND s.stage_id = p.stage_id
       WHERE NOT (s.completion_ms IS NOT NULL AND s.completion_ms < j.submission_ms)"""))
def q_missing_stages(spark, sf_dir):
    i = entities.job_stage_infos(Ctx(spark, sf_dir).jobs)
    return i.where(F.col("completion_known_ms").isNull()).select("app_id", "job_id", "stage_id", "num_tasks")


@register("J12_unattributed", with_adapter(
    """SELECT app_id, kind, count(*) AS n_events FROM (
         SELECT t.app_id, 'task_start' AS kind FROM v_tasks t
         WHERE NOT EXISTS (SELECT 1 FROM v_planned p WHERE p.app_id = t.app_id AND p.stage_id = t.stage_id)
         UNION ALL
         SELECT t.app_id, 'task_end' FROM v_tasks t WHERE t.finish_ms IS NOT NULL
           AND NOT EXISTS (SELECT 1 FROM v_planned p WHERE p.app_id = t.app_id AND p.stage_id = t.stage_id)
         UNION ALL
         SELECT s.app_id, 'stage_submitted' FROM v_stages s
         WHERE NOT EXISTS (SELECT 1 FROM v_planned p WHERE p.app_id = s.app_id AND p.stage_id = s.stage_id)) u
       GROUP BY app_id, kind"""))
def q_unattributed(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return attribution.unattributed(c.lc, c.jobs)


@register("J13_stage_edges", with_adapter(
    """SELECT s.app_id, s.stage_id, s.stage_attempt, s.stage_id - 1 AS parent_id, s.name AS stage_name,
              p.name AS parent_name
       FROM v_stages s LEFT JOIN v_stages p ON p.app_id = s.app_id AND p.stage_id = s.stage_id - 1
       WHERE s.stage_id % 3 > 0"""))
def q_stage_edges(spark, sf_dir):
    return attribution.stage_edges(Ctx(spark, sf_dir).stages)


@register("P21_qualified_keys", with_adapter(
    """SELECT concat('app', CAST(p.app_id AS VARCHAR)) AS app_key,
              concat('app', CAST(p.app_id AS VARCHAR), 'job', CAST(p.job_id AS VARCHAR)) AS job_key,
              concat('app', CAST(p.app_id AS VARCHAR), 'stage', CAST(p.stage_id AS VARCHAR)) AS stage_key
       FROM v_planned p"""))
def q_qualified_keys(spark, sf_dir):
    from tracefold.functions.columns import qualified_key

    i = entities.job_stage_infos(Ctx(spark, sf_dir).jobs)
    return i.select(
        F.concat(F.lit("app"), F.col("app_id").cast("string")).alias("app_key"),
        qualified_key("job", "app_id", "job_id").alias("job_key"),
        qualified_key("stage", "app_id", "stage_id").alias("stage_key"),
    )


@register("W6_first_last_info", with_adapter(
    """SELECT f.app_id, f.stage_id, CAST(f.planned_tasks AS BIGINT) AS first_info_tasks, f.job_id AS first_planner,
              s.name AS last_name, s.status AS last_status
       FROM (SELECT p.app_id, p.stage_id, p.planned_tasks, p.job_id,
                    row_number() OVER (PARTITION BY p.app_id, p.stage_id ORDER BY j.submission_ms, p.job_id) AS rn
             FROM v_planned p JOIN v_jobs j ON p.app_id = j.app_id AND p.job_id = j.job_id) f
       LEFT JOIN v_stages s ON s.app_id = f.app_id AND s.stage_id = f.stage_id
       WHERE f.rn = 1"""))
def q_first_last_info(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return entities.first_last_stage_info(c.jobs, c.stages)


@register("J8_skipped_stages_replanned", with_adapter(
    """SELECT e.app_id, e.job_id, e.stage_id, CAST(e.planned_tasks AS BIGINT) AS num_tasks
       FROM (SELECT p.app_id, p.job_id, p.stage_id, p.planned_tasks, j.completion_ms,
                    (SELECT max(j2.submission_ms) FROM v_planned p2 JOIN v_jobs j2
                       ON p2.app_id = j2.app_id AND p2.job_id = j2.job_id
                     WHERE p2.app_id = p.app_id AND p2.stage_id = p.stage_id
                       AND j2.submission_ms <= j.completion_ms) AS replan_t
             FROM v_planned p JOIN v_jobs j ON p.app_id = j.app_id AND p.job_id = j.job_id
             WHERE j.completion_ms IS NOT NULL) e
       WHERE NOT EXISTS (SELECT 1 FROM v_stages s WHERE s.app_id = e.app_id AND s.stage_id = e.stage_id
                           AND s.submission_ms >= e.replan_t AND s.submission_ms <= e.completion_ms)"""))
def q_skipped_replanned(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return attribution.skipped_stages(c.lc, c.jobs, "replanned")
