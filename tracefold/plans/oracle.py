"""DuckDB oracle text: the trace adapter as CTEs, shared by every oracle query.

This is the same mapping as ``tracefold.sources.testdata`` written in plain
SQL. Only the timestamp conversion differs between engines: DuckDB floors
microseconds with ``epoch_us(x) // 1000`` (``epoch_ms`` would round).
"""

from __future__ import annotations


def MS(x: str) -> str:
    return f"(epoch_us({x}) // 1000)"


ADAPTER_CTES = f"""
v_jobs0 AS (
  SELECT o_custkey % 4 AS app_id, o_orderkey AS job_id, o_orderpriority AS job_group,
         concat(o_orderpriority, ' at line ', CAST(o_orderkey AS VARCHAR)) AS call_site,
         CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status,
         {MS('o_orderdate')} + (o_orderkey % 1000) * 1000 AS submission_ms,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'null'
              ELSE concat(o_orderpriority, ' at line ', CAST(o_orderkey AS VARCHAR)) END AS name
  FROM orders),
v_tasks0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_shipdate,
              l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS attempt,
         CAST(l_quantity AS BIGINT) * 21600000 AS dur_ms,
         CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem),
v_tasks1 AS (
  SELECT j.app_id, t.l_orderkey AS job_id,
         t.l_orderkey * 3 + CASE t.l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS stage_id,
         0 AS stage_attempt, (t.l_orderkey * 8 + t.l_linenumber) * 100 + t.attempt AS task_id,
         t.l_linenumber AS task_index, t.attempt, t.l_suppkey AS executor_id,
         concat('host-', CAST(s.s_nationkey AS VARCHAR)) AS host,
         CASE WHEN t.tax >= 8 THEN 'FAILED' WHEN t.disc >= 10 THEN 'KILLED'
              WHEN j.status = 'RUNNING' AND t.l_linenumber = 7 AND t.l_partkey % 10 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
         j.submission_ms + t.l_linenumber * 3600000 + t.attempt * 86400000 AS launch_ms,
         t.dur_ms, t.disc, t.tax, t.l_partkey
  FROM v_tasks0 t JOIN v_jobs0 j ON t.l_orderkey = j.job_id JOIN supplier s ON t.l_suppkey = s.s_suppkey),
v_tasks AS (
  SELECT *, CASE WHEN status <> 'RUNNING' THEN launch_ms + dur_ms END AS finish_ms,
         CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END AS has_metrics,
         CAST(floor(dur_ms * 7 / 10) AS BIGINT) AS run_ms, CAST(floor(dur_ms / 20) AS BIGINT) AS deser_ms,
         CAST(floor(dur_ms / 50) AS BIGINT) AS ser_ms, CAST(floor(dur_ms * disc / 100) AS BIGINT) AS fetch_wait_ms,
         tax * dur_ms * 10000 AS shuffle_write_ns,
         CASE WHEN task_index = 7 THEN launch_ms + dur_ms - CAST(floor(dur_ms / 25) AS BIGINT) ELSE 0 END AS getting_result_at,
         CASE status WHEN 'SUCCESS' THEN 'Success' WHEN 'FAILED' THEN 'ExceptionFailure' WHEN 'KILLED' THEN 'TaskKilled' END AS end_reason
  FROM v_tasks1),
v_jobs AS (
  SELECT j.*, CASE WHEN j.status <> 'RUNNING' THEN greatest(coalesce(m.last_ms, 0), j.submission_ms) + 1000 END AS completion_ms
  FROM v_jobs0 j LEFT JOIN (SELECT job_id, max(launch_ms + dur_ms) AS last_ms FROM v_tasks1 GROUP BY job_id) m ON j.job_id = m.job_id),
v_planned0 AS (
  SELECT app_id, job_id, job_id * 3 + k AS stage_id, 1 + (job_id + k) % 7 AS planned_tasks
  FROM v_jobs0 CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x
  UNION ALL
  SELECT b.app_id, a.job_id, (a.job_id - 1) * 3 + 2, 1 + (a.job_id + 1) % 7
  FROM v_jobs0 a JOIN v_jobs0 b ON a.job_id = b.job_id + 1 AND a.app_id = b.app_id WHERE a.job_id % 5 < 3),
v_planned AS (
  SELECT *, concat('count at cell:', CAST(stage_id % 9 AS VARCHAR)) AS stage_name FROM v_planned0),
v_stages AS (
  SELECT app_id, stage_id, 0 AS stage_attempt, concat('count at cell:', CAST(stage_id % 9 AS VARCHAR)) AS name,
         count(DISTINCT task_index) AS num_tasks, min(launch_ms) - 500 AS submission_ms,
         CASE WHEN count(*) = count(finish_ms) THEN max(finish_ms) END AS completion_ms,
         CASE WHEN count(*) <> count(finish_ms) THEN 'RUNNING'
              WHEN sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) * 2 < count(*) THEN 'FAILED' ELSE 'COMPLETED' END AS status
  FROM v_tasks GROUP BY app_id, stage_id),
v_executors AS (
  SELECT s_suppkey % 4 AS app_id, s_suppkey AS executor_id, concat('host-', CAST(s_nationkey AS VARCHAR)) AS host,
         1 + s_suppkey % 8 AS cores, 788918400000 + s_suppkey * 3600000 AS added_ms,
         CASE WHEN s_suppkey % 10 = 0 THEN 788918400000 + s_suppkey * 3600000 + 86400000000 END AS removed_ms
  FROM supplier),
v_signals AS (
  SELECT user_id AS kernel_id, event_id AS seq, event_id % 12 AS cell_id, {MS('ts')} AS ts_ms,
         CASE event_type WHEN 'click' THEN 'execute' ELSE 'idle' END AS signal
  FROM events WHERE event_type IN ('click', 'purchase')),
v_kernel_jobs AS (
  SELECT user_id AS kernel_id, event_id AS job_id, {MS('ts')} AS start_ms,
         {MS('ts')} + CAST(floor(value * 60000) AS BIGINT) AS end_ms,
         CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status
  FROM events WHERE event_type IN ('view', 'error', 'signup'))
"""


def with_adapter(select: str, ctes: str = "") -> str:
    """Full oracle query: adapter CTEs, optional extra CTEs, final SELECT."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {ADAPTER_CTES.strip()}{extra}\n{select.strip()}"
