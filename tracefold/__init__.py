"""tracefold: execution-trace analytics on Spark DataFrames.

Reads Spark application event logs or framed lifecycle messages, turns them
into job / stage / task / executor / cell-run tables, and computes on them
with DataFrames, SQL and Structured Streaming.

Typical use::

    from tracefold import read_event_log, write_trace, open_entities, open_events
    lc = read_event_log(spark, "hdfs:///spark-history")      # ten typed event tables
    write_trace(lc, "hdfs:///traces/2026-12")                  # ingest once (events + entities)
    ent, ev = open_entities(spark, "hdfs:///traces/2026-12"), open_events(spark, "hdfs:///traces/2026-12")
    idle = idle_core_time(ent.tasks, ent.executors)
"""

__version__ = "0.1.0"

from tracefold.operators.attribution import attribute_active, attribute_planned, skipped_stages  # noqa: E402
from tracefold.operators.counters import job_stage_counters, job_task_counters  # noqa: E402
from tracefold.operators.entities import pair_executors, pair_jobs, pair_stages, pair_tasks  # noqa: E402
from tracefold.operators.phases import phase_profile, task_phases  # noqa: E402
from tracefold.operators.report import job_table  # noqa: E402
from tracefold.operators.series import active_tasks_series, cores_series, idle_core_time  # noqa: E402
from tracefold.sources.eventlog import read_event_log  # noqa: E402
from tracefold.sources.messages import parse_messages, read_messages, to_lifecycle, to_messages  # noqa: E402
from tracefold.sources.store import open_entities, open_events, write_trace  # noqa: E402

__all__ = [
    "read_event_log", "read_messages", "parse_messages", "to_lifecycle", "to_messages",
    "write_trace", "open_entities", "open_events",
    "pair_jobs", "pair_stages", "pair_tasks", "pair_executors",
    "attribute_active", "attribute_planned", "skipped_stages",
    "job_task_counters", "job_stage_counters", "task_phases", "phase_profile", "job_table",
    "active_tasks_series", "cores_series", "idle_core_time",
]
