"""Queries: task phases, profile, findings and the job table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions.columns import format_duration
from tracefold.operators import findings, phases, report
from tracefold.plans.context import Ctx
from tracefold.plans.oracle import with_adapter
from tracefold.plans.q_entities import _NTASKS, _SKIPPED, _STAGE_EV, _TASK_EV
from tracefold.plans.registry import register

_PH = """
ph0 AS (
  SELECT app_id, task_id, stage_id, finish_ms - launch_ms AS total, coalesce(fetch_wait_ms, 0) AS sr,
         coalesce(shuffle_write_ns // 1000000, 0) AS sw, coalesce(ser_ms, 0) AS ser, coalesce(deser_ms, 0) AS de,
         CASE WHEN getting_result_at <> 0 THEN finish_ms - getting_result_at ELSE 0 END AS gr, run_ms, getting_result_at
  FROM v_tasks WHERE finish_ms IS NOT NULL AND has_metrics = 1),
ph1 AS (SELECT *, coalesce(run_ms, total - (ser + de) - gr) AS run FROM ph0),
ph AS (
  SELECT app_id, task_id, stage_id, total, getting_result_at,
         greatest(0, total - run - (ser + de) - gr) AS scheduler_delay, de AS deserialization, sr AS shuffle_read,
         run - sr - sw AS computing, sw AS shuffle_write, ser AS serialization, gr AS getting_result
  FROM ph1),
pp0 AS (
  SELECT *, CAST(scheduler_delay AS DOUBLE) / nullif(total, 0) * 100 AS p_scheduler_delay,
         CAST(deserialization AS DOUBLE) / nullif(total, 0) * 100 AS p_deserialization,
         CAST(shuffle_read AS DOUBLE) / nullif(total, 0) * 100 AS p_shuffle_read,
         CAST(shuffle_write AS DOUBLE) / nullif(total, 0) * 100 AS p_shuffle_write,
         CAST(serialization AS DOUBLE) / nullif(total, 0) * 100 AS p_serialization,
         CAST(getting_result AS DOUBLE) / nullif(total, 0) * 100 AS p_getting_result
  FROM ph),
pp AS (
  SELECT *, greatest(CAST(100 AS DOUBLE) - p_scheduler_delay - p_shuffle_read - p_shuffle_write - p_serialization
                     - p_deserialization - p_getting_result, CAST(0 AS DOUBLE)) AS p_computing
  FROM pp0)
"""


def _pos_sql(k: str) -> str:
    before = phases.PHASES[: phases.PHASES.index(k)]
    return "CAST(0 AS DOUBLE)" + "".join(f" + p_{b}" for b in before)


@register("P11_task_phases", with_adapter(
    "SELECT app_id, task_id, " + ", ".join(f"{k} AS {k}_ms" for k in phases.PHASES) + " FROM ph", _PH))
def q_task_phases(spark, sf_dir):
    t = phases.task_phases(Ctx(spark, sf_dir).tasks).where(F.col("phases").isNotNull())
    return t.select("app_id", "task_id", *[F.col(f"phases.{k}_ms").alias(f"{k}_ms") for k in phases.PHASES])


@register("P10_to_proportion", with_adapter(
    "SELECT app_id, task_id, " + ", ".join(f"p_{k} AS {k}_pct" for k in phases.PHASES) + " FROM pp", _PH))
def q_proportions(spark, sf_dir):
    t = phases.task_phases(Ctx(spark, sf_dir).tasks).where(F.col("phases").isNotNull())
    return t.select("app_id", "task_id", *[F.col(f"phases.{k}_pct").alias(f"{k}_pct") for k in phases.PHASES])


@register("P12_phase_positions", with_adapter(
    "SELECT app_id, task_id, " + ", ".join(f"{_pos_sql(k)} AS {k}_pos" for k in phases.PHASES) + " FROM pp", _PH))
def q_positions(spark, sf_dir):
    t = phases.task_phases(Ctx(spark, sf_dir).tasks).where(F.col("phases").isNotNull())
    return t.select("app_id", "task_id", *[F.col(f"phases.{k}_pos").alias(f"{k}_pos") for k in phases.PHASES])


@register("P13_task_raw_metrics", with_adapter(
    """SELECT app_id, task_id, CAST(0 AS BIGINT) AS result_size, CAST(0 AS BIGINT) AS jvm_gc_ms,
              CAST(0 AS BIGINT) AS memory_bytes_spilled, CAST(0 AS BIGINT) AS disk_bytes_spilled,
              CAST(0 AS BIGINT) AS peak_execution_memory, getting_result_at FROM ph""", _PH))
def q_raw_metrics(spark, sf_dir):
    t = phases.task_phases(Ctx(spark, sf_dir).tasks).where(F.col("phases").isNotNull())
    cols = ["result_size", "jvm_gc_ms", "memory_bytes_spilled", "disk_bytes_spilled", "peak_execution_memory",
            "getting_result_at"]
    return t.select("app_id", "task_id", *[F.col(f"phases.{c}").alias(c) for c in cols])


@register("P14_phases_long", with_adapter(
    "\nUNION ALL\n".join(
        f"SELECT app_id, task_id, {i} AS phase_order, '{k}' AS phase, '{phases.LABELS[k]}' AS label, "
        f"{k} AS time_ms, p_{k} AS pct, {_pos_sql(k)} AS pos FROM pp"
        for i, k in enumerate(phases.PHASES)), _PH))
def q_phases_long(spark, sf_dir):
    return phases.phases_long(phases.task_phases(Ctx(spark, sf_dir).tasks))


@register("A14_phase_profile", with_adapter(
    "SELECT app_id, stage_id, count(*) AS num_tasks, "
    + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}_ms" for k in phases.PHASES)
    + ", CASE WHEN sum(shuffle_read) + sum(shuffle_write) > sum(computing) THEN 'IO' ELSE 'CPU' END AS bound"
    + " FROM ph GROUP BY app_id, stage_id", _PH))
def q_phase_profile(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    t = phases.task_phases(c.tasks)
    return phases.phase_profile(t, ("app_id", "stage_id"))


_DUR = """
dd AS (SELECT app_id, stage_id, stage_attempt, task_id, finish_ms - launch_ms AS duration_ms
       FROM v_tasks WHERE finish_ms IS NOT NULL),
med AS (SELECT app_id, stage_id, stage_attempt, quantile_cont(duration_ms, 0.5) AS median_ms, count(*) AS n
        FROM dd GROUP BY app_id, stage_id, stage_attempt)
"""


@register("A16_stragglers", with_adapter(
    """SELECT d.app_id, d.stage_id, d.stage_attempt, d.task_id, d.duration_ms, m.median_ms,
              d.duration_ms / m.median_ms AS ratio, m.n AS n_finished
       FROM dd d JOIN med m ON d.app_id = m.app_id AND d.stage_id = m.stage_id AND d.stage_attempt = m.stage_attempt
       WHERE d.duration_ms > 1.5 * m.median_ms""", _DUR))
def q_stragglers(spark, sf_dir):
    return findings.stragglers(Ctx(spark, sf_dir).tasks, 1.5)


@register("A16_straggler_stages", with_adapter(
    """SELECT d.app_id, d.stage_id, d.stage_attempt, count(*) AS num_stragglers, max(d.duration_ms / m.median_ms) AS max_ratio
       FROM dd d JOIN med m ON d.app_id = m.app_id AND d.stage_id = m.stage_id AND d.stage_attempt = m.stage_attempt
       WHERE d.duration_ms > 1.5 * m.median_ms
       GROUP BY d.app_id, d.stage_id, d.stage_attempt""", _DUR))
def q_straggler_stages(spark, sf_dir):
    return findings.straggler_stages(Ctx(spark, sf_dir).tasks, 1.5)


@register("T2_slowest_tasks", with_adapter(
    """SELECT * FROM (
         SELECT app_id, task_id, stage_id, finish_ms - launch_ms AS metric_ms,
                row_number() OVER (PARTITION BY app_id ORDER BY finish_ms - launch_ms DESC, task_id) AS rank
         FROM v_tasks WHERE finish_ms IS NOT NULL) x WHERE rank <= 10"""))
def q_slowest(spark, sf_dir):
    return findings.slowest_tasks(Ctx(spark, sf_dir).tasks, 10).withColumn("rank", F.col("rank").cast("long"))


@register("T2_slowest_result_fetch", with_adapter(
    """SELECT * FROM (
         SELECT app_id, task_id, stage_id, getting_result AS metric_ms,
                row_number() OVER (PARTITION BY app_id ORDER BY getting_result DESC, task_id) AS rank
         FROM ph) x WHERE rank <= 5""", _PH))
def q_slowest_fetch(spark, sf_dir):
    t = phases.task_phases(Ctx(spark, sf_dir).tasks)
    return findings.slowest_tasks(t, 5, by="getting_result").withColumn("rank", F.col("rank").cast("long"))


@register("P26_visible_status", with_adapter(
    """SELECT app_id, task_id, stage_id, stage_attempt, status, end_reason AS error_message
       FROM v_tasks WHERE status IN ('FAILED', 'KILLED')"""))
def q_failed_tasks(spark, sf_dir):
    return findings.failed_tasks(Ctx(spark, sf_dir).tasks)


@register("P20_error_message", with_adapter(
    """SELECT app_id, task_id, status,
              CASE WHEN end_reason IS NOT NULL AND end_reason <> 'Success' THEN end_reason END AS error_message
       FROM v_tasks"""))
def q_error_message(spark, sf_dir):
    from tracefold.functions.columns import error_message

    t = Ctx(spark, sf_dir).tasks
    return t.select("app_id", "task_id", "status", error_message("end_reason", "error_message").alias("error_message"))


@register("A17_failure_summary", with_adapter(
    """SELECT g.app_id, g.kind, g.reason, g.num_failed,
              (SELECT min(u.entity_id) FROM u WHERE u.app_id = g.app_id AND u.kind = g.kind AND u.reason = g.reason
                 AND u.t = g.first_ms) AS first_id, g.first_ms
       FROM (SELECT app_id, kind, reason, count(*) AS num_failed, min(t) AS first_ms FROM u GROUP BY app_id, kind, reason) g""",
    """u AS (
         SELECT app_id, 'job' AS kind, 'JobFailed' AS reason, completion_ms AS t, job_id AS entity_id
         FROM v_jobs WHERE status = 'FAILED'
         UNION ALL
         SELECT app_id, 'stage', 'Stage failed: more than half of the task attempts failed', completion_ms, stage_id
         FROM v_stages WHERE status = 'FAILED'
         UNION ALL
         SELECT app_id, 'task', end_reason, finish_ms, task_id FROM v_tasks WHERE status IN ('FAILED', 'KILLED'))"""))
def q_failure_summary(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return findings.failure_summary(c.jobs, c.stages, c.tasks)


def fmt_duration_sql(x: str) -> str:
    """DuckDB text of functions.columns.format_duration (no millis)."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN concat("
        f"CASE WHEN {x} // 86400000 > 0 THEN concat({x} // 86400000, 'd ') ELSE '' END, "
        f"CASE WHEN {x} >= 3600000 THEN concat(({x} % 86400000) // 3600000, 'h:') ELSE '' END, "
        f"CASE WHEN {x} >= 3600000 THEN lpad(CAST(({x} % 3600000) // 60000 AS VARCHAR), 2, '0') "
        f"ELSE CAST(({x} % 3600000) // 60000 AS VARCHAR) END, 'm:', "
        f"lpad(CAST(({x} % 60000) // 1000 AS VARCHAR), 2, '0'), 's') END"
    )


def _short(x: str) -> str:
    return f"split_part(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' ', 1)"


@register("P9_format_duration", with_adapter(
    f"""SELECT app_id, task_id, finish_ms - launch_ms AS duration_ms,
               {fmt_duration_sql('(finish_ms - launch_ms)')} AS duration_text FROM v_tasks"""))
def q_format_duration(spark, sf_dir):
    t = Ctx(spark, sf_dir).tasks
    d = F.col("finish_ms") - F.col("launch_ms")
    return t.select("app_id", "task_id", d.alias("duration_ms"), format_duration(d).alias("duration_text"))


@register("P5_job_name_or_stage", with_adapter(
    f"""SELECT j.app_id, j.job_id,
               CASE WHEN {_short('j.name')} = 'null' THEN {_short('l.last_name')} ELSE {_short('j.name')} END AS display_name
        FROM v_jobs j LEFT JOIN (SELECT app_id, job_id, arg_max(stage_name, stage_id) AS last_name
                                 FROM v_planned GROUP BY app_id, job_id) l
          ON l.app_id = j.app_id AND l.job_id = j.job_id"""))
def q_job_name(spark, sf_dir):
    return report.job_name_or_stage(Ctx(spark, sf_dir).jobs).select("app_id", "job_id", "display_name")


_T1 = _TASK_EV + "," + _SKIPPED + "," + _NTASKS + "," + _STAGE_EV + """,
tot AS (SELECT app_id, stage_id, sum(st) AS st, sum(ok) AS ok, sum(fl) AS fl FROM tev GROUP BY app_id, stage_id),
tk AS (SELECT p.app_id, p.job_id, sum(coalesce(ok, 0)) AS c, sum(coalesce(st, 0)) - sum(coalesce(ok, 0)) - sum(coalesce(fl, 0)) AS a
       FROM v_planned p LEFT JOIN tot ON tot.app_id = p.app_id AND tot.stage_id = p.stage_id GROUP BY p.app_id, p.job_id),
skc AS (SELECT app_id, job_id, count(*) AS ss, sum(num_tasks) AS stk FROM sk GROUP BY app_id, job_id),
nv AS (SELECT p.app_id, p.job_id, sum(coalesce(x.subs - x.oks - x.fails, 0)) AS act_st, sum(coalesce(x.oks, 0)) AS done_st
       FROM v_planned p LEFT JOIN (
         SELECT app_id, stage_id, count(*) FILTER (WHERE is_submit) AS subs,
                count(*) FILTER (WHERE NOT is_submit AND NOT failed) AS oks, count(*) FILTER (WHERE failed) AS fails
         FROM sev GROUP BY app_id, stage_id) x ON x.app_id = p.app_id AND x.stage_id = p.stage_id
       GROUP BY p.app_id, p.job_id),
sl AS (SELECT p.app_id, p.job_id,
              string_agg(concat(p.stage_id, ':', CASE WHEN k.stage_id IS NOT NULL THEN 'SKIPPED'
                                                      ELSE coalesce(s.status, 'PENDING') END), ',' ORDER BY p.stage_id) AS stage_list
       FROM v_planned p LEFT JOIN sk k ON k.app_id = p.app_id AND k.job_id = p.job_id AND k.stage_id = p.stage_id
       LEFT JOIN v_stages s ON s.app_id = p.app_id AND s.stage_id = p.stage_id
       GROUP BY p.app_id, p.job_id),
lastn AS (SELECT app_id, job_id, arg_max(stage_name, stage_id) AS last_name FROM v_planned GROUP BY app_id, job_id),
t1 AS (
  SELECT j.*, l.last_name, coalesce(tk.c, 0) AS c, coalesce(tk.a, 0) AS a,
         coalesce(n.num_tasks, 0) - coalesce(skc.stk, 0) AS n, coalesce(n.num_stages, 0) - coalesce(skc.ss, 0) AS ns,
         coalesce(skc.ss, 0) AS ss, coalesce(nv.act_st, 0) AS act_st, coalesce(nv.done_st, 0) AS done_st, sl.stage_list,
         CASE WHEN j.status <> 'RUNNING' THEN j.completion_ms - j.submission_ms END AS dur
  FROM v_jobs j
  LEFT JOIN lastn l ON l.app_id = j.app_id AND l.job_id = j.job_id
  LEFT JOIN tk ON tk.app_id = j.app_id AND tk.job_id = j.job_id
  LEFT JOIN ntasks n ON n.app_id = j.app_id AND n.job_id = j.job_id
  LEFT JOIN skc ON skc.app_id = j.app_id AND skc.job_id = j.job_id
  LEFT JOIN nv ON nv.app_id = j.app_id AND nv.job_id = j.job_id
  LEFT JOIN sl ON sl.app_id = j.app_id AND sl.job_id = j.job_id)
"""


@register("T1_job_table", with_adapter(
    f"""SELECT app_id, job_id,
               CASE WHEN {_short('name')} = 'null' THEN {_short('last_name')} ELSE {_short('name')} END AS name,
               CASE WHEN status = 'SUCCEEDED' THEN 'COMPLETED' ELSE status END AS status,
               submission_ms, dur AS duration_ms, {fmt_duration_sql('dur')} AS duration_text,
               CASE WHEN n > 0 THEN concat(c, CASE WHEN a > 0 THEN concat(' + ', a, ' ') ELSE '' END, ' / ', n) END AS progress_text,
               CASE WHEN n > 0 THEN c / n * 100 ELSE CAST(0 AS DOUBLE) END AS completed_pct,
               CASE WHEN n > 0 THEN a / n * 100 ELSE CAST(0 AS DOUBLE) END AS active_pct,
               concat(done_st, '/', ns, CASE WHEN ss > 0 THEN concat(' (', ss, ' skipped)') ELSE '        ' END,
                      CASE WHEN act_st > 0 THEN concat('(', act_st, ' active) ') ELSE '' END) AS stages_text,
               stage_list
        FROM t1""", _T1))
def q_job_table(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return report.job_table(c.lc, c.jobs, c.stage_status)
