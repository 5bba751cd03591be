"""Notebook cells: W3 run intervals from execute/idle signals, J10/J11 attribution, W5, R6.

W3 replays the page's FIFO queue in set form: per kernel, ``S`` = running
sum of (+1 execute, -1 idle), ``M = least(0, running min of S)``; an idle is
effective iff ``M`` did not drop at it (an idle on an empty queue is
ignored). The k-th execute pairs with the k-th effective idle; the k-th run
starts at ``greatest(execute_k, end_{k-1})``.

Every running aggregate is bucketed (see ``sweep``), so a kernel with a huge
signal history is spread over its time buckets; pairing is an equi-join on
(kernel, k), never a window over a whole kernel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.sweep import BUCKET, SPLIT, running_sums, with_bucket



def _running_min(df: DataFrame, key: str, t: str, tiebreak: str, v: str) -> DataFrame:
    """Add ``<v>_min`` (running min incl. the row) and ``<v>_min_prev`` (before the row), bucketed."""
    bm = df.where(SPLIT).groupBy(key, BUCKET).agg(F.min(v).alias("_bmin"))  # a key of one bucket has nothing before it
    wb = Window.partitionBy(key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    bm = bm.select(key, BUCKET, F.min("_bmin").over(wb).alias("_prev_min"))
    j = df.join(F.broadcast(bm.where(F.col("_prev_min").isNotNull())), [key, BUCKET], "left")
    w = Window.partitionBy(key, BUCKET).orderBy(t, tiebreak)
    incl = F.min(v).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    excl = F.min(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return j.select(
        *df.columns,
        F.least(F.col("_prev_min"), incl).alias(f"{v}_min"),
        F.least(F.col("_prev_min"), excl).alias(f"{v}_min_prev"),
    )


def cell_runs(signals: DataFrame) -> DataFrame:
    """(kernel_id, run_no, cell_id, exec_ms, start_ms, end_ms); end NULL = still running or queued."""
    s = signals.select(
        "kernel_id", "seq", "cell_id", "ts_ms", "signal",
        F.when(F.col("signal") == "execute", 1).otherwise(-1).alias("d"),
        F.when(F.col("signal") == "execute", 1).otherwise(0).alias("is_exec"),
    )
    s = with_bucket(s, ["kernel_id"], "ts_ms")  # one set of borders for all sweeps below
    r = running_sums(s, ["kernel_id"], "ts_ms", ["d", "is_exec"], tiebreak=["seq"])
    r = r.withColumnRenamed("d_run", "S").withColumnRenamed("is_exec_run", "exec_no")
    r = _running_min(r, "kernel_id", "ts_ms", "seq", "S")
    zero = F.lit(0).cast("long")
    m = F.least(zero, F.col("S_min"))
    m_prev = F.least(zero, F.coalesce(F.col("S_min_prev"), zero))
    r = r.withColumn("eff", ((F.col("signal") == "idle") & (m == m_prev)).cast("int"))
    r = r.select("kernel_id", "seq", "cell_id", "ts_ms", "signal", "exec_no", "eff", BUCKET, SPLIT)
    idles = running_sums(r.where(F.col("eff") == 1), ["kernel_id"], "ts_ms", ["eff"], tiebreak=["seq"])
    # the k-th effective idle ends run k and lets run k+1 start: one keyed aggregate, no self join
    ends = idles.select(
        "kernel_id",
        F.explode(F.array(
            F.struct(F.col("eff_run").alias("run_no"), F.col("ts_ms").alias("end_ms"), F.lit(None).cast("long").alias("prev")),
            F.struct((F.col("eff_run") + 1).alias("run_no"), F.lit(None).cast("long").alias("end_ms"), F.col("ts_ms").alias("prev")),
        )).alias("e"),
    ).groupBy("kernel_id", F.col("e.run_no").alias("run_no")).agg(
        F.max("e.end_ms").alias("end_ms"), F.max("e.prev").alias("prev_end_ms"))
    execs = r.where(F.col("signal") == "execute").select(
        "kernel_id", F.col("exec_no").alias("run_no"), "cell_id", F.col("ts_ms").alias("exec_ms"))
    out = execs.join(ends, ["kernel_id", "run_no"], "left")
    return out.select(
        "kernel_id", "run_no", "cell_id", "exec_ms",
        # run 1 starts at its execute; a later run only once the previous one ended
        F.when(F.col("run_no") == 1, F.col("exec_ms"))
        .when(F.col("prev_end_ms").isNotNull(), F.greatest(F.col("exec_ms"), F.col("prev_end_ms")))
        .alias("start_ms"),
        "end_ms",
    )


def latest_run_per_cell(runs: DataFrame) -> DataFrame:
    """A re-run replaces the previous monitor of the same cell (one groupBy, no window)."""
    return runs.groupBy("kernel_id", "cell_id").agg(
        F.max_by(F.struct("run_no", "start_ms", "end_ms"), F.struct("start_ms", "run_no")).alias("r"),
        F.count(F.lit(1)).alias("num_runs"),
    ).select("kernel_id", "cell_id", "r.run_no", "r.start_ms", "r.end_ms", "num_runs")


def attribute_cells(kernel_jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """A job belongs to the cell running at its start (NULL if none: J12)."""
    return _running_cell(kernel_jobs.select("kernel_id", "job_id", "start_ms"), "job_id", "start_ms", runs)


def attribute_stages(submissions: DataFrame, runs: DataFrame) -> DataFrame:
    """J10 for stages: each submission ``(kernel_id, job_id, stage_id, t)`` belongs to the cell running at its time."""
    own = submissions.select("kernel_id", "job_id", "stage_id", "t", F.xxhash64("stage_id", "job_id").alias("_id"))
    at = _running_cell(own.select("kernel_id", "_id", "t"), "_id", "t", runs)
    return own.join(at, ["kernel_id", "_id", "t"]).select("kernel_id", "stage_id", "job_id", "t", "run_no", "cell_id")


def inherit_stage_cell(events: DataFrame, stage_cells: DataFrame) -> DataFrame:
    """J11 for tasks: an event ``(kernel_id, stage_id, event_id, t, ...)`` takes the cell of the latest submission of its stage.

    A stage may be submitted again from another cell, so this is an as-of look-up: one marker sweep per
    (kernel, stage) numbers the submissions, an event reads the number before it and fetches that submission by an
    equi-join. Submissions without a running cell leave the stage where it was; at equal times the submission is first.
    """
    known = stage_cells.where(F.col("cell_id").isNotNull())
    carried = [c for c in events.columns if c not in ("kernel_id", "stage_id", "t", "event_id")]
    marks = known.select("kernel_id", "stage_id", "t", F.lit(0).alias("kind"), F.col("job_id").alias("eid"), F.lit(1).alias("d"),
                         *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in carried])
    asks = events.select("kernel_id", "stage_id", "t", F.lit(1).alias("kind"), F.col("event_id").alias("eid"), F.lit(0).alias("d"), *carried)
    r = running_sums(marks.unionByName(asks), ["kernel_id", "stage_id"], "t", ["d"], tiebreak=["kind", "eid"])
    numbered = running_sums(known.withColumn("d", F.lit(1)), ["kernel_id", "stage_id"], "t", ["d"], tiebreak=["job_id"])
    numbered = numbered.select("kernel_id", "stage_id", F.col("d_run").alias("k"), "run_no", "cell_id")
    asked = r.where("kind = 1").select("kernel_id", "stage_id", "t", F.col("eid").alias("event_id"), *carried, F.col("d_run").alias("k"))
    return asked.join(numbered, ["kernel_id", "stage_id", "k"], "left").drop("k")


def _running_cell(events: DataFrame, key: str, time_col: str, runs: DataFrame) -> DataFrame:
    """``events(kernel_id, key, time)`` with the run and cell that were running, or NULLs.

    As-of in set form: the number of run starts at or before the event
    is the run number of the latest started run; it owns the event iff that
    comes before the run ended.
    """
    started = runs.where(F.col("start_ms").isNotNull())
    marks = started.select("kernel_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"),
                           F.col("run_no").alias("eid"), F.lit(1).alias("d"), F.lit(None).cast("long").alias("own_id"))
    rows = events.select("kernel_id", F.col(time_col).alias("t"), F.lit(1).alias("kind"),
                         F.col(key).alias("eid"), F.lit(0).alias("d"), F.col(key).alias("own_id"))
    r = running_sums(marks.unionByName(rows), ["kernel_id"], "t", ["d"], tiebreak=["kind", "eid"])
    j = r.where(F.col("kind") == 1).select("kernel_id", F.col("own_id").alias(key), F.col("t").alias(time_col),
                                           F.col("d_run").alias("run_no"))
    rr = started.select("kernel_id", "run_no", "cell_id", F.col("end_ms").alias("run_end_ms"))
    out = j.join(rr, ["kernel_id", "run_no"], "left")
    inside = F.col("cell_id").isNotNull() & (F.col("run_end_ms").isNull() | (F.col(time_col) < F.col("run_end_ms")))
    return out.select(
        "kernel_id", key, time_col,
        F.when(inside, F.col("run_no")).alias("run_no"), F.when(inside, F.col("cell_id")).alias("cell_id"),
    )


def inherit_cell(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Child events take the cell of their parent (equi left join on the parent key)."""
    return children.join(parents.select(*key, "run_no", "cell_id"), key, "left")


def completion_signal(runs: DataFrame, job_cells: DataFrame, kernel_jobs: DataFrame) -> DataFrame:
    """R6 (batch): a finished cell is complete once its last attributed job ended too."""
    ends = job_cells.where(F.col("run_no").isNotNull()).join(
        kernel_jobs.select("kernel_id", "job_id", "end_ms"), ["kernel_id", "job_id"]
    ).groupBy("kernel_id", "run_no").agg(
        F.max("end_ms").alias("last_job_end_ms"), F.count(F.lit(1)).alias("num_jobs"),
        F.count_if(F.col("end_ms").isNull()).alias("open_jobs"))
    r = runs.where(F.col("end_ms").isNotNull()).join(ends, ["kernel_id", "run_no"], "left")
    return r.select(
        "kernel_id", "run_no", "cell_id", "end_ms",
        F.coalesce("num_jobs", F.lit(0).cast("long")).alias("num_jobs"),
        F.when(F.coalesce("open_jobs", F.lit(0)) == 0, F.greatest("end_ms", "last_job_end_ms")).alias("completed_ms"),
    )


def cell_sessions(kernel_jobs: DataFrame, gap_ms: int) -> DataFrame:
    """R10 (batch form): bursts of jobs of one kernel separated by more than ``gap_ms``."""
    ts = F.timestamp_millis(F.col("start_ms"))
    g = kernel_jobs.groupBy("kernel_id", F.session_window(ts, f"{gap_ms} milliseconds").alias("w")).agg(
        F.count(F.lit(1)).alias("num_jobs"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    return g.select("kernel_id", "first_ms", "last_ms", "num_jobs")
