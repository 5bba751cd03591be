"""Queries: timeline (U2, P15–P17, P23, R5, W8), cells (W3, W5, J10, J11, R6, R10), retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import attribution, cells, retention, timeline
from tracefold.plans.context import Ctx
from tracefold.plans.oracle import with_adapter
from tracefold.plans.q_entities import _SKIPPED
from tracefold.plans.q_phases import _short
from tracefold.plans.registry import register

NOW_MS = 946684800000  # fixed "now" for open intervals: 2000-01-01 UTC
SESSION_GAP_MS = 3_600_000
RETAINED = 1000

_ITEMS = f"""
items AS (
  SELECT app_id, 'job' AS item_type, concat('job', job_id) AS item_id, 'jobs' AS grp,
         concat(job_id, ':', {_short('name')}) AS content, submission_ms AS start_ms,
         coalesce(completion_ms, {NOW_MS}) AS end_ms, CASE WHEN completion_ms IS NULL THEN 'ongoing' ELSE 'done' END AS mode,
         concat(CASE WHEN completion_ms IS NULL THEN 'itemrunning' WHEN status = 'SUCCEEDED' THEN 'itemfinished'
                     ELSE 'itemfailed' END, ' job') AS class_name
  FROM v_jobs
  UNION ALL
  SELECT app_id, 'stage', concat('stage', stage_id, '_', stage_attempt), 'stages', concat(stage_id, ':', {_short('name')}),
         submission_ms, coalesce(completion_ms, {NOW_MS}), CASE WHEN completion_ms IS NULL THEN 'ongoing' ELSE 'done' END,
         concat(CASE WHEN completion_ms IS NULL THEN 'itemrunning' WHEN status = 'COMPLETED' THEN 'itemfinished'
                     ELSE 'itemfailed' END, ' stage')
  FROM v_stages
  UNION ALL
  SELECT app_id, 'task', concat('task', task_id), concat_ws('-', CAST(executor_id AS VARCHAR), host), CAST(task_id AS VARCHAR),
         launch_ms, coalesce(finish_ms, {NOW_MS}), CASE WHEN finish_ms IS NULL THEN 'ongoing' ELSE 'done' END,
         concat(CASE WHEN finish_ms IS NULL THEN 'itemrunning' WHEN status = 'SUCCESS' THEN 'itemfinished'
                     ELSE 'itemfailed' END, ' task')
  FROM v_tasks)
"""


def _items(c: Ctx):
    return timeline.timeline_items(c.jobs, c.stages, c.tasks, NOW_MS)


@register("U2_timeline_items", with_adapter("SELECT * FROM items", _ITEMS))
def q_timeline_items(spark, sf_dir):
    return _items(Ctx(spark, sf_dir))


@register("R5_open_intervals", with_adapter(
    "SELECT app_id, item_type, item_id, start_ms, end_ms FROM items WHERE mode = 'ongoing'", _ITEMS))
def q_open_intervals(spark, sf_dir):
    return _items(Ctx(spark, sf_dir)).where(F.col("mode") == "ongoing").select(
        "app_id", "item_type", "item_id", "start_ms", "end_ms")


@register("P15_executor_group", with_adapter(
    """SELECT DISTINCT app_id, concat_ws('-', CAST(executor_id AS VARCHAR), host) AS grp,
              concat('Tasks: ', executor_id, ' ', host) AS label FROM v_tasks"""))
def q_executor_groups(spark, sf_dir):
    return timeline.executor_groups(Ctx(spark, sf_dir).task_info("executor_id", "host"))


@register("P17_item_class_counts", with_adapter(
    "SELECT app_id, item_type, mode, class_name, count(*) AS num_items FROM items GROUP BY ALL", _ITEMS))
def q_item_classes(spark, sf_dir):
    return _items(Ctx(spark, sf_dir)).groupBy("app_id", "item_type", "mode", "class_name").agg(
        F.count(F.lit(1)).alias("num_items"))


@register("P23_padded_range", with_adapter(
    """SELECT app_id, CAST(trunc(a - (b - a) / 15) AS BIGINT) AS range_start_ms,
              CAST(trunc(b + (b - a) / 15) AS BIGINT) AS range_end_ms
       FROM (SELECT app_id, min(start_ms) AS a, max(end_ms) AS b FROM items GROUP BY app_id) x""", _ITEMS))
def q_padded_range(spark, sf_dir):
    return timeline.padded_range(_items(Ctx(spark, sf_dir)))


@register("W8_assign_lanes")
def q_assign_lanes(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return timeline.assign_lanes(_items(c))


_RUNS = """
sig AS (SELECT kernel_id, seq, cell_id, ts_ms, signal, CASE WHEN signal = 'execute' THEN 1 ELSE -1 END AS d,
               CASE WHEN signal = 'execute' THEN 1 ELSE 0 END AS is_exec FROM v_signals),
s1 AS (SELECT *, sum(d) OVER w AS S, CAST(sum(is_exec) OVER w AS BIGINT) AS exec_no FROM sig
       WINDOW w AS (PARTITION BY kernel_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, least(0, min(S) OVER (PARTITION BY kernel_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING)) AS M,
              least(0, coalesce(min(S) OVER (PARTITION BY kernel_id ORDER BY ts_ms, seq
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS M_prev
       FROM s1),
idl AS (SELECT kernel_id, row_number() OVER (PARTITION BY kernel_id ORDER BY ts_ms, seq) AS run_no, ts_ms AS end_ms
        FROM s2 WHERE signal = 'idle' AND M = M_prev),
ex AS (SELECT kernel_id, exec_no AS run_no, cell_id, ts_ms AS exec_ms FROM s2 WHERE signal = 'execute'),
runs AS (
  SELECT ex.kernel_id, ex.run_no, ex.cell_id, ex.exec_ms,
         CASE WHEN ex.run_no = 1 THEN ex.exec_ms WHEN p.end_ms IS NOT NULL THEN greatest(ex.exec_ms, p.end_ms) END AS start_ms,
         i.end_ms
  FROM ex LEFT JOIN idl i ON i.kernel_id = ex.kernel_id AND i.run_no = ex.run_no
  LEFT JOIN idl p ON p.kernel_id = ex.kernel_id AND p.run_no = ex.run_no - 1),
jc AS (
  SELECT j.kernel_id, j.job_id, j.start_ms, r.run_no, r.cell_id
  FROM v_kernel_jobs j LEFT JOIN runs r ON r.kernel_id = j.kernel_id AND r.start_ms IS NOT NULL
       AND r.start_ms <= j.start_ms AND (r.end_ms IS NULL OR j.start_ms < r.end_ms))
"""


def _runs(c: Ctx):
    return c.runs


@register("W3_cell_runs", with_adapter("SELECT * FROM runs", _RUNS))
def q_cell_runs(spark, sf_dir):
    return _runs(Ctx(spark, sf_dir))


@register("W5_latest_run_per_cell", with_adapter(
    """SELECT kernel_id, cell_id, run_no, start_ms, end_ms, num_runs FROM (
         SELECT *, row_number() OVER (PARTITION BY kernel_id, cell_id ORDER BY start_ms DESC, run_no DESC) AS rn,
                count(*) OVER (PARTITION BY kernel_id, cell_id) AS num_runs
         FROM runs WHERE start_ms IS NOT NULL) x WHERE rn = 1""", _RUNS))
def q_latest_run(spark, sf_dir):
    return cells.latest_run_per_cell(_runs(Ctx(spark, sf_dir)).where(F.col("start_ms").isNotNull()))


@register("J10_attribute_cells", with_adapter("SELECT * FROM jc", _RUNS))
def q_attribute_cells(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return cells.attribute_cells(c.tr.kernel_jobs, _runs(c))


@register("J11_inherit_cell", with_adapter(
    """SELECT j.kernel_id, j.job_id, j.end_ms, jc.run_no, jc.cell_id
       FROM v_kernel_jobs j LEFT JOIN jc ON jc.kernel_id = j.kernel_id AND jc.job_id = j.job_id""", _RUNS))
def q_inherit_cell(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    jc = cells.attribute_cells(c.tr.kernel_jobs, _runs(c))
    ends = c.tr.kernel_jobs.select("kernel_id", "job_id", "end_ms")
    return cells.inherit_cell(ends, jc, ["kernel_id", "job_id"])


_STAGE_CELLS = _RUNS + """,
sc AS (
  SELECT j.kernel_id, j.job_id % 5 AS stage_id, j.job_id, j.start_ms + 1000 AS t, r.run_no, r.cell_id
  FROM v_kernel_jobs j LEFT JOIN runs r ON r.kernel_id = j.kernel_id AND r.start_ms IS NOT NULL
       AND r.start_ms <= j.start_ms + 1000 AND (r.end_ms IS NULL OR j.start_ms + 1000 < r.end_ms)),
tev AS (
  SELECT kernel_id, job_id % 5 AS stage_id, job_id * 2 + i AS task_id, 'task_start' AS event, start_ms + 2000 + i * 1000 AS t
  FROM v_kernel_jobs CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) x
  UNION ALL
  SELECT kernel_id, job_id % 5, job_id * 2 + i, 'task_end', end_ms + 3000 + i * 500
  FROM v_kernel_jobs CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) x)
"""


@register("J10_attribute_stages", with_adapter("SELECT kernel_id, stage_id, job_id, t, run_no, cell_id FROM sc", _STAGE_CELLS))
def q_attribute_stages(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return cells.attribute_stages(c.tr.kernel_stages, _runs(c))


@register("J11_inherit_task_cells", with_adapter(
    """SELECT e.kernel_id, e.stage_id, e.task_id, e.event, e.t, s.run_no, s.cell_id
       FROM tev e ASOF LEFT JOIN (SELECT * FROM sc WHERE cell_id IS NOT NULL) s
         ON e.kernel_id = s.kernel_id AND e.stage_id = s.stage_id AND e.t >= s.t""", _STAGE_CELLS))
def q_inherit_task_cells(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    at = cells.attribute_stages(c.tr.kernel_stages, _runs(c))
    events = c.tr.kernel_task_events.withColumn("event_id", F.col("task_id") * 2 + (F.col("event") == "task_end").cast("int"))
    return cells.inherit_stage_cell(events, at).select("kernel_id", "stage_id", "task_id", "event", "t", "run_no", "cell_id")


R6_SQL = """SELECT r.kernel_id, r.run_no, r.cell_id, r.end_ms, coalesce(e.num_jobs, 0) AS num_jobs,
              CASE WHEN coalesce(e.open_jobs, 0) = 0 THEN greatest(r.end_ms, e.last_job_end_ms) END AS completed_ms
       FROM runs r LEFT JOIN (
         SELECT jc.kernel_id, jc.run_no, max(j.end_ms) AS last_job_end_ms, count(*) AS num_jobs,
                count(*) FILTER (WHERE j.end_ms IS NULL) AS open_jobs
         FROM jc JOIN v_kernel_jobs j ON j.kernel_id = jc.kernel_id AND j.job_id = jc.job_id
         WHERE jc.run_no IS NOT NULL GROUP BY jc.kernel_id, jc.run_no) e
         ON e.kernel_id = r.kernel_id AND e.run_no = r.run_no
       WHERE r.end_ms IS NOT NULL"""


@register("R6_completion_signal", with_adapter(R6_SQL, _RUNS))
def q_completion_signal(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    runs = _runs(c)
    jc = cells.attribute_cells(c.tr.kernel_jobs, runs)
    return cells.completion_signal(runs, jc, c.tr.kernel_jobs)


R10_SQL = f"""SELECT kernel_id, min(start_ms) AS first_ms, max(start_ms) AS last_ms, count(*) AS num_jobs
        FROM (SELECT *, sum(CASE WHEN prev IS NULL OR start_ms - prev >= {SESSION_GAP_MS} THEN 1 ELSE 0 END)
                          OVER (PARTITION BY kernel_id ORDER BY start_ms, job_id ROWS UNBOUNDED PRECEDING) AS sid
              FROM (SELECT *, lag(start_ms) OVER (PARTITION BY kernel_id ORDER BY start_ms, job_id) AS prev
                    FROM v_kernel_jobs) a) b
        GROUP BY kernel_id, sid"""


@register("R10_cell_sessions", with_adapter(R10_SQL))
def q_cell_sessions(spark, sf_dir):
    return cells.cell_sessions(Ctx(spark, sf_dir).tr.kernel_jobs, SESSION_GAP_MS)


_LISTS = _SKIPPED + """,
lists AS (
  SELECT app_id, CASE WHEN status = 'SUCCEEDED' THEN 'completedJobs' ELSE 'failedJobs' END AS list,
         CAST(job_id AS VARCHAR) AS item_key, completion_ms AS t, 7 AS kind_rank, job_id AS tiebreak
  FROM v_jobs WHERE completion_ms IS NOT NULL
  UNION ALL
  SELECT app_id, CASE WHEN status = 'COMPLETED' THEN 'completedStages' ELSE 'failedStages' END,
         concat(stage_id, '.', stage_attempt), completion_ms, 6, stage_id * 1000 + stage_attempt
  FROM v_stages WHERE completion_ms IS NOT NULL
  UNION ALL
  SELECT sk.app_id, 'skippedStages', CAST(sk.stage_id AS VARCHAR), j.completion_ms, 7, sk.job_id * 1000000 + sk.stage_id
  FROM sk JOIN v_jobs j ON j.app_id = sk.app_id AND j.job_id = sk.job_id),
arr AS (SELECT app_id, list, item_key, t,
               row_number() OVER (PARTITION BY app_id, list ORDER BY t, kind_rank, tiebreak) AS arrival_no,
               count(*) OVER (PARTITION BY app_id, list) AS n
        FROM lists)
"""


def _lists(c: Ctx):
    sk = attribution.skipped_stages(c.lc, c.jobs).join(c.jobs.select("app_id", "job_id", "completion_ms"), ["app_id", "job_id"])
    return retention.finished_lists(c.jobs, c.stages, sk)


@register("T3_arrival_order", with_adapter("SELECT app_id, list, item_key, t, arrival_no FROM arr", _LISTS))
def q_arrival_order(spark, sf_dir):
    return retention.arrival_order(_lists(Ctx(spark, sf_dir)))


@register("W4_retain_recent", with_adapter(
    f"""SELECT app_id, list, item_key, arrival_no FROM arr
        WHERE arrival_no > CASE WHEN n <= {RETAINED} THEN 0
                                ELSE {max(1, RETAINED // 10)} * (1 + (n - {RETAINED} - 1) // {max(1, RETAINED // 10)}) END""",
    _LISTS))
def q_retain_recent(spark, sf_dir):
    return retention.retain_recent(_lists(Ctx(spark, sf_dir)), RETAINED)


@register("W7_attempt_history", with_adapter(
    """SELECT app_id, stage_id, stage_attempt, task_index, attempt, task_id, status, false AS speculative,
              row_number() OVER w AS attempt_rank, lag(status) OVER w AS prev_status,
              count(*) OVER (PARTITION BY app_id, stage_id, stage_attempt, task_index) AS num_attempts
       FROM v_tasks WINDOW w AS (PARTITION BY app_id, stage_id, stage_attempt, task_index ORDER BY attempt, task_id)"""))
def q_attempt_history(spark, sf_dir):
    return retention.attempt_history(Ctx(spark, sf_dir).tasks)
