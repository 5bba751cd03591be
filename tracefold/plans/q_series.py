"""Queries: concurrency, capacity and idle time."""

from __future__ import annotations

from tracefold.operators import series
from tracefold.plans.oracle import with_adapter
from tracefold.plans.registry import register
from tracefold.plans.context import Ctx


_POINTS = """
pts AS (
  SELECT app_id, task_id, launch_ms AS t, 4 AS kind_rank, 1 AS delta FROM v_tasks
  UNION ALL
  SELECT app_id, task_id, finish_ms AS t, 5 AS kind_rank, -1 AS delta FROM v_tasks WHERE finish_ms IS NOT NULL)
"""


@register("U1_event_points", with_adapter("SELECT app_id, task_id, t, kind_rank, delta FROM pts", _POINTS))
def q_event_points(spark, sf_dir):
    return series.event_points(Ctx(spark, sf_dir).tasks)


@register(
    "W1_active_tasks_series",
    with_adapter(
        """SELECT app_id, t, CAST(sum(delta) OVER (PARTITION BY app_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active
           FROM per_t""",
        _POINTS + ", per_t AS (SELECT app_id, t, sum(delta) AS delta FROM pts GROUP BY app_id, t)",
    ),
)
def q_active_tasks(spark, sf_dir):
    return series.active_tasks_series(Ctx(spark, sf_dir).tasks, "step")


@register(
    "W1_active_tasks_chart",
    with_adapter(
        """SELECT app_id, task_id, kind_rank, t, 0 AS side, CAST(after - delta AS BIGINT) AS active FROM run
           UNION ALL
           SELECT app_id, task_id, kind_rank, t, 1 AS side, CAST(after AS BIGINT) AS active FROM run""",
        _POINTS
        + """, run AS (SELECT *, sum(delta) OVER (PARTITION BY app_id ORDER BY t, kind_rank, task_id
                                              ROWS UNBOUNDED PRECEDING) AS after FROM pts)""",
    ),
)
def q_active_chart(spark, sf_dir):
    return series.active_tasks_series(Ctx(spark, sf_dir).tasks, "chart")


_CAP = """
cap AS (
  SELECT app_id, added_ms AS t, 1 AS kind_rank, CAST(executor_id AS VARCHAR) AS entity, cores AS dcores
  FROM v_executors WHERE added_ms IS NOT NULL
  UNION ALL
  SELECT app_id, removed_ms AS t, 8 AS kind_rank, CAST(executor_id AS VARCHAR) AS entity, -cores AS dcores
  FROM v_executors WHERE removed_ms IS NOT NULL)
"""


@register(
    "W2_cores_series",
    with_adapter(
        """SELECT app_id, t, CAST(sum(dcores) OVER (PARTITION BY app_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cores
           FROM per_t""",
        _CAP + ", per_t AS (SELECT app_id, t, sum(dcores) AS dcores FROM cap GROUP BY app_id, t)",
    ),
)
def q_cores_series(spark, sf_dir):
    return series.cores_series(Ctx(spark, sf_dir).executors)


@register(
    "J9_cores_asof",
    with_adapter(
        """SELECT app_id, task_id, kind_rank, t, CAST(active AS BIGINT) AS active, CAST(cores AS BIGINT) AS cores
           FROM run WHERE task_id IS NOT NULL""",
        _POINTS
        + ","
        + _CAP
        + """, ev AS (
              SELECT app_id, t, kind_rank, CAST(task_id AS VARCHAR) AS entity, task_id, delta AS dactive, 0 AS dcores FROM pts
              UNION ALL
              SELECT app_id, t, kind_rank, entity, NULL AS task_id, 0 AS dactive, dcores FROM cap),
            run AS (
              SELECT *, sum(dactive) OVER w AS active, sum(dcores) OVER w AS cores FROM ev
              WINDOW w AS (PARTITION BY app_id ORDER BY t, kind_rank, entity ROWS UNBOUNDED PRECEDING))""",
    ),
)
def q_cores_asof(spark, sf_dir):
    tr = Ctx(spark, sf_dir)
    return series.cores_asof(tr.tasks, tr.executors)


IDLE_SQL = with_adapter(
    """SELECT app_id,
              CAST(sum(greatest(cores - active, 0) * (next_t - t)) AS BIGINT) AS idle_core_ms,
              CAST(sum(least(active, cores) * (next_t - t)) AS BIGINT) AS busy_core_ms,
              CAST(sum(cores * (next_t - t)) AS BIGINT) AS capacity_core_ms,
              CAST(max(active) AS BIGINT) AS peak_active,
              CAST(max(cores) AS BIGINT) AS peak_cores
       FROM run WHERE next_t IS NOT NULL GROUP BY app_id""",
    _POINTS
    + ","
    + _CAP
    + """, per_t AS (
          SELECT app_id, t, sum(dactive) AS dactive, sum(dcores) AS dcores FROM (
            SELECT app_id, t, delta AS dactive, 0 AS dcores FROM pts
            UNION ALL SELECT app_id, t, 0, dcores FROM cap) u
          GROUP BY app_id, t),
        run AS (
          SELECT app_id, t, sum(dactive) OVER w AS active, sum(dcores) OVER w AS cores,
                 lead(t) OVER (PARTITION BY app_id ORDER BY t) AS next_t
          FROM per_t WINDOW w AS (PARTITION BY app_id ORDER BY t ROWS UNBOUNDED PRECEDING))""",
)


@register("A15_idle_core_time", IDLE_SQL)
def q_idle_core_time(spark, sf_dir):
    tr = Ctx(spark, sf_dir)
    return series.idle_core_time(tr.tasks, tr.executors)


@register(
    "P22_job_markers",
    with_adapter(
        """SELECT app_id, job_id, submission_ms AS t, concat('Job ', CAST(job_id AS VARCHAR), ' started') AS label
           FROM v_jobs WHERE submission_ms IS NOT NULL
           UNION ALL
           SELECT app_id, job_id, completion_ms AS t, concat('Job ', CAST(job_id AS VARCHAR), ' ended') AS label
           FROM v_jobs WHERE completion_ms IS NOT NULL"""
    ),
)
def q_job_markers(spark, sf_dir):
    return series.job_markers(Ctx(spark, sf_dir).jobs)
