"""R6 and R10 on streams: cell runs complete, and bursts of jobs, from rows that come late and across batches.

``LiveCells`` (for ``foreachBatch``) holds the rows of a kernel since its last quiet point, and runs the batch operators
(queue, attribution, completion) over them in each micro-batch, so a late row is put in its place before anything is
counted. A kernel is quiet after a run if the queue is empty there, all runs up to it are complete, and all of that lies
behind the kernel's mark (its greatest time less the delay): nothing before that point can change any more, its rows
leave the state, and a count of its runs stays. State is thus bounded by the delay and by runs and jobs that are still open.
Every held run is given anew in each batch; the latest one counts. A row that comes behind its kernel's quiet point
is kept in ``too_late``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators import cells
from tracefold.streaming.state import BATCH, Progress, Versions

KIND_SIGNAL, KIND_JOB_START, KIND_JOB_END, KIND_BASE = 0, 1, 2, -1
ROW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("kernel_id", T.LongType()), ("t", T.LongType()), ("kind", T.IntegerType()), ("seq", T.LongType()),
    ("signal", T.StringType()), ("cell_id", T.LongType()), ("job_id", T.LongType())]])
COLUMNS = ROW_SCHEMA.names


def kernel_rows(signals: DataFrame, kernel_jobs: DataFrame) -> DataFrame:
    """One row type for both inputs: (kernel_id, t, kind, seq, signal, cell_id, job_id)."""
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    s = signals.select("kernel_id", F.col("ts_ms").alias("t"), F.lit(KIND_SIGNAL).alias("kind"), "seq", "signal",
                       "cell_id", none.alias("job_id"))
    js = kernel_jobs.select("kernel_id", F.col("start_ms").alias("t"), F.lit(KIND_JOB_START).alias("kind"),
                            F.col("job_id").alias("seq"), text.alias("signal"), none.alias("cell_id"), "job_id")
    je = kernel_jobs.where(F.col("end_ms").isNotNull()).select(
        "kernel_id", F.col("end_ms").alias("t"), F.lit(KIND_JOB_END).alias("kind"), F.col("job_id").alias("seq"),
        text.alias("signal"), none.alias("cell_id"), "job_id")
    return s.unionByName(js).unionByName(je)


class LiveCells:
    def __init__(self, spark: SparkSession, path: str, delay_ms: int):
        self.state, self.runs, self.too_late = (Versions(spark, f"{path}/{n}") for n in ("rows", "runs", "too_late"))
        self.progress = Progress(spark, f"{path}/progress", delay_ms, T.LongType())

    def on_batch(self, rows: DataFrame, batch_id: int) -> None:
        held = self.state.before(batch_id, ROW_SCHEMA)
        base = held.where(F.col("kind") == KIND_BASE).select("kernel_id", F.col("t").alias("quiet_ms"), F.col("seq").alias("runs_before"))
        marks = self.progress.advance(rows.select(F.col("kernel_id").alias("app_id"), "t"), batch_id).withColumnRenamed("app_id", "kernel_id")
        new = rows.select(*COLUMNS).join(base.select("kernel_id", "quiet_ms"), "kernel_id", "left")
        behind = F.coalesce(F.col("t") <= F.col("quiet_ms"), F.lit(False))
        self.too_late.write(new.where(behind).select(*COLUMNS), batch_id)
        now = held.where(F.col("kind") != KIND_BASE).unionByName(new.where(~behind).select(*COLUMNS))
        now = Versions(rows.sparkSession, f"{self.state.path}_now").write(now, batch_id)  # read by several of the operators
        signals = now.where(F.col("kind") == KIND_SIGNAL).select("kernel_id", "seq", "cell_id", F.col("t").alias("ts_ms"), "signal")
        at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("t")))
        jobs = now.where(F.col("kind") != KIND_SIGNAL).groupBy("kernel_id", "job_id").agg(at(KIND_JOB_START).alias("start_ms"), at(KIND_JOB_END).alias("end_ms"))
        started = jobs.where(F.col("start_ms").isNotNull())
        found = Versions(rows.sparkSession, f"{self.state.path}_found").write(cells.cell_runs(signals), batch_id)
        done = cells.completion_signal(found, cells.attribute_cells(started, found), started)
        given = found.select("kernel_id", "run_no", "cell_id", "exec_ms", "start_ms").join(done.drop("cell_id"), ["kernel_id", "run_no"], "left")
        given = given.join(base, "kernel_id", "left").withColumn("run_no", F.col("run_no") + F.coalesce("runs_before", F.lit(0)))
        given = self.runs.write(given.select("kernel_id", "run_no", "cell_id", "exec_ms", "start_ms", "end_ms", "num_jobs", "completed_ms"), batch_id)
        self.state.write(self._kept(now, jobs, given, base, marks), batch_id)

    @staticmethod
    def _kept(now: DataFrame, jobs: DataFrame, given: DataFrame, base: DataFrame, marks: DataFrame) -> DataFrame:
        order = Window.partitionBy("kernel_id").orderBy("run_no")  # the held runs of a kernel
        settled = F.coalesce((F.col("completed_ms") <= F.col("upto")) & (F.col("end_ms") <= F.col("upto")), F.lit(False))
        r = given.join(marks, "kernel_id").withColumn("settled", settled)
        r = r.withColumn("all_settled", F.min("settled").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        r = r.withColumn("next_ms", F.lead("exec_ms").over(order))
        quiet = r.where(F.col("all_settled") & (F.col("next_ms").isNull() | (F.col("next_ms") > F.col("end_ms"))))
        quiet = quiet.groupBy("kernel_id").agg(F.max("end_ms").alias("quiet_ms"), F.max("run_no").alias("runs_before"))
        point = base.unionByName(quiet).groupBy("kernel_id").agg(F.max("quiet_ms").alias("quiet_ms"), F.max("runs_before").alias("runs_before"))
        # a job leaves with its start; an end without a start that the mark has passed belongs to such a job
        job_at = jobs.select("kernel_id", "job_id", F.coalesce("start_ms", F.lit(None).cast("long")).alias("job_ms"))
        rows = now.join(job_at, ["kernel_id", "job_id"], "left").join(point, "kernel_id", "left").join(marks, "kernel_id", "left")
        own = F.when(F.col("kind") == KIND_SIGNAL, F.col("t")).otherwise(F.coalesce("job_ms", F.when(F.col("t") <= F.col("upto"), F.col("quiet_ms"))))
        gone = F.coalesce(own <= F.col("quiet_ms"), F.lit(False))
        stay = rows.where(~gone).select(*COLUMNS)
        marker = point.select("kernel_id", F.col("quiet_ms").alias("t"), F.lit(KIND_BASE).alias("kind"), F.col("runs_before").alias("seq"),
                              F.lit(None).cast("string").alias("signal"), F.lit(None).cast("long").alias("cell_id"), F.lit(None).cast("long").alias("job_id"))
        return stay.unionByName(marker)

    def current(self) -> DataFrame:
        """All runs that ended, as ``completion_signal`` gives them."""
        last = F.max_by(F.struct("cell_id", "end_ms", "num_jobs", "completed_ms"), BATCH).alias("r")
        return self.runs.all().groupBy("kernel_id", "run_no").agg(last).select("kernel_id", "run_no", "r.*").where(F.col("end_ms").isNotNull())


def stream_cell_sessions(kernel_jobs: DataFrame, gap_ms: int, delay: str) -> DataFrame:
    """R10 on a stream ``(kernel_id, start_ms)``: bursts that merge while rows come, given once the watermark passes them (append mode).

    A row that lies between two open bursts joins them; a heartbeat row of any later time closes what is open.
    """
    timed = kernel_jobs.withColumn("_ts", F.timestamp_millis(F.col("start_ms"))).withWatermark("_ts", delay)
    g = timed.groupBy("kernel_id", F.session_window("_ts", f"{gap_ms} milliseconds").alias("w")).agg(
        F.count(F.lit(1)).alias("num_jobs"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    return g.select("kernel_id", "first_ms", "last_ms", "num_jobs")
