"""Adapter: the driver's TPC-H-ish tables seen as a trace of Spark applications.

One order is one job, one line item is one task attempt (repeated
(order, line) pairs are retries), suppliers are executors, click/purchase
events are execute/idle signals of a notebook kernel. The mapping is fixed
(see FIXTURES.md §4) and is shared with the DuckDB oracles in
``tracefold.plans.oracle``; both engines must give identical rows.

Partitioning: line items are hash-partitioned on the order key once; the
attempt numbering window, the job join and the per-job completion aggregate
all reuse that partitioning (one exchange per input table).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions.columns import epoch_ms

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the adapter (must equal the oracle text in plans/oracle.py).
HOUR_MS = 3600000
DAY_MS = 86400000
TASK_MS_PER_UNIT = 21600000  # one unit of l_quantity = 6 h of task time
EPOCH_1995_MS = 788918400000  # 1995-01-01 UTC, executors are added from here
N_APPS = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class TestdataTrace:
    """Entity tables of the trace, built lazily from the raw tables."""

    __test__ = False  # not a pytest class

    spark: SparkSession
    sf_dir: str
    _stored_tasks: Callable[[], DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- jobs ---------------------------------------------------------------
    @cached_property
    def jobs0(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            (F.col("o_custkey") % N_APPS).alias("app_id"),
            F.col("o_orderkey").alias("job_id"),
            F.col("o_orderpriority").alias("job_group"),
            F.concat(F.col("o_orderpriority"), F.lit(" at line "), F.col("o_orderkey").cast("string")).alias("call_site"),
            F.when(F.col("o_orderstatus") == "F", "SUCCEEDED")
            .when(F.col("o_orderstatus") == "P", "FAILED")
            .otherwise("RUNNING")
            .alias("status"),
            (epoch_ms("o_orderdate") + (F.col("o_orderkey") % 1000) * 1000).alias("submission_ms"),
            # adapter extension: low-priority jobs carry the name "null" (exercises P5)
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("null"))
            .otherwise(F.concat(F.col("o_orderpriority"), F.lit(" at line "), F.col("o_orderkey").cast("string")))
            .alias("name"),
        )

    def use_stored_tasks(self, tasks: Callable[[], DataFrame]) -> None:
        """Derive jobs and stages from a written tasks table."""
        self._stored_tasks = tasks

    @property
    def _all_tasks(self) -> DataFrame:
        return self._stored_tasks() if self._stored_tasks else self.tasks

    @cached_property
    def _tasks1(self) -> DataFrame:
        li = self.table("lineitem").repartition("l_orderkey")
        order_cols = [
            "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        ]
        w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order_cols)
        t0 = li.select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag",
            (F.row_number().over(w) - 1).cast("long").alias("attempt"),
            (F.col("l_quantity").cast("long") * TASK_MS_PER_UNIT).alias("dur_ms"),
            F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
            F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
        )
        j = self.jobs0.select("app_id", "job_id", "status", "submission_ms")
        s = self.table("supplier").select("s_suppkey", "s_nationkey")
        t = t0.join(j, t0.l_orderkey == j.job_id).join(s, t0.l_suppkey == s.s_suppkey)
        stage_k = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
        return t.select(
            "app_id",
            "job_id",
            (F.col("l_orderkey") * 3 + stage_k).alias("stage_id"),
            F.lit(0).alias("stage_attempt"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100 + F.col("attempt")).alias("task_id"),
            F.col("l_linenumber").alias("task_index"),
            "attempt",
            F.col("l_suppkey").alias("executor_id"),
            F.concat(F.lit("host-"), F.col("s_nationkey").cast("string")).alias("host"),
            F.when(F.col("tax") >= 8, "FAILED")
            .when(F.col("disc") >= 10, "KILLED")
            .when((F.col("status") == "RUNNING") & (F.col("l_linenumber") == 7) & (F.col("l_partkey") % 10 == 0), "RUNNING")
            .otherwise("SUCCESS")
            .alias("status"),
            (F.col("submission_ms") + F.col("l_linenumber") * HOUR_MS + F.col("attempt") * DAY_MS).alias("launch_ms"),
            "dur_ms",
            "disc",
            "tax",
            "l_partkey",
        )

    @cached_property
    def tasks(self) -> DataFrame:
        t = self._tasks1
        dur = F.col("dur_ms")
        return t.select(
            "*",
            F.when(F.col("status") != "RUNNING", F.col("launch_ms") + dur).alias("finish_ms"),
            F.when(F.col("l_partkey") % 50 == 0, 0).otherwise(1).alias("has_metrics"),
            F.floor(dur * 7 / 10).cast("long").alias("run_ms"),
            F.floor(dur / 20).cast("long").alias("deser_ms"),
            F.floor(dur / 50).cast("long").alias("ser_ms"),
            F.floor(dur * F.col("disc") / 100).cast("long").alias("fetch_wait_ms"),
            (F.col("tax") * dur * 10000).alias("shuffle_write_ns"),
            F.when(F.col("task_index") == 7, F.col("launch_ms") + dur - F.floor(dur / 25).cast("long"))
            .otherwise(F.lit(0).cast("long"))
            .alias("getting_result_at"),
            # end reason as the event log names it (adapter extension, same in the oracle)
            F.when(F.col("status") == "SUCCESS", "Success")
            .when(F.col("status") == "FAILED", "ExceptionFailure")
            .when(F.col("status") == "KILLED", "TaskKilled")
            .alias("end_reason"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        last = self._all_tasks.groupBy("job_id").agg(F.max(F.col("launch_ms") + F.col("dur_ms")).alias("last_ms"))
        j = self.jobs0
        out = j.join(last, "job_id", "left")
        return out.select(
            "app_id", "job_id", "job_group", "call_site", "name", "status", "submission_ms",
            F.when(
                F.col("status") != "RUNNING",
                F.greatest(F.coalesce(F.col("last_ms"), F.lit(0)), F.col("submission_ms")) + 1000,
            ).alias("completion_ms"),
        )

    # -- stages -------------------------------------------------------------
    @cached_property
    def planned(self) -> DataFrame:
        j = self.jobs0.select("app_id", "job_id")
        own = j.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(  # 3 own stages per job
            "app_id", "job_id",
            (F.col("job_id") * 3 + F.col("k")).alias("stage_id"),
            (1 + (F.col("job_id") + F.col("k")) % 7).alias("planned_tasks"),
        )
        a = j.alias("a")
        b = j.alias("b")
        nb = (
            a.join(b, (F.col("a.job_id") == F.col("b.job_id") + 1) & (F.col("a.app_id") == F.col("b.app_id")))
            .where(F.col("a.job_id") % 5 < 3)
            .select(
                F.col("b.app_id").alias("app_id"),
                F.col("a.job_id").alias("job_id"),
                ((F.col("a.job_id") - 1) * 3 + 2).alias("stage_id"),
                (1 + (F.col("a.job_id") + 1) % 7).alias("planned_tasks"),
            )
        )
        return own.unionByName(nb).withColumn(
            "stage_name", F.concat(F.lit("count at cell:"), (F.col("stage_id") % 9).cast("string"))
        )

    @cached_property
    def stages(self) -> DataFrame:
        t = self._all_tasks.select("app_id", "job_id", "stage_id", "task_index", "launch_ms", "finish_ms", "status")
        # one exchange serves the distinct count and the aggregate
        return t.repartition("job_id").groupBy("app_id", "job_id", "stage_id").agg(
            F.count_distinct("task_index").alias("num_tasks"),
            (F.min("launch_ms") - 500).alias("submission_ms"),
            F.when(F.count(F.lit(1)) == F.count("finish_ms"), F.max("finish_ms")).alias("completion_ms"),
            F.when(F.count(F.lit(1)) != F.count("finish_ms"), "RUNNING")
            .when(F.sum(F.when(F.col("status") == "SUCCESS", 1).otherwise(0)) * 2 < F.count(F.lit(1)), "FAILED")
            .otherwise("COMPLETED")
            .alias("status"),
        ).select(
            "app_id", "stage_id", F.lit(0).alias("stage_attempt"),
            F.concat(F.lit("count at cell:"), (F.col("stage_id") % 9).cast("string")).alias("name"),
            "num_tasks", "submission_ms", "completion_ms", "status",
            # adapter extension: stage k of a job depends on stage k-1
            F.when(F.col("stage_id") % 3 > 0, F.array(F.col("stage_id") - 1))
            .otherwise(F.array().cast("array<bigint>"))
            .alias("parent_ids"),
        )

    # -- executors and kernel signals --------------------------------------
    @cached_property
    def executors(self) -> DataFrame:
        s = self.table("supplier")
        added = F.lit(EPOCH_1995_MS) + F.col("s_suppkey") * HOUR_MS
        return s.select(
            (F.col("s_suppkey") % N_APPS).alias("app_id"),
            F.col("s_suppkey").alias("executor_id"),
            F.concat(F.lit("host-"), F.col("s_nationkey").cast("string")).alias("host"),
            (1 + F.col("s_suppkey") % 8).alias("cores"),
            added.alias("added_ms"),
            F.when(F.col("s_suppkey") % 10 == 0, added + 86400000000).alias("removed_ms"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        e = self.table("events").where(F.col("event_type").isin("click", "purchase"))
        return e.select(
            F.col("user_id").alias("kernel_id"),
            F.col("event_id").alias("seq"),
            (F.col("event_id") % 12).alias("cell_id"),
            epoch_ms("ts").alias("ts_ms"),
            F.when(F.col("event_type") == "click", "execute").otherwise("idle").alias("signal"),
        )

    @cached_property
    def kernel_jobs(self) -> DataFrame:
        """Adapter extension: view/error/signup events are Spark jobs started from that user's kernel,
        lasting ``value`` minutes; error events are failed jobs."""
        e = self.table("events").where(F.col("event_type").isin("view", "error", "signup"))
        start = epoch_ms("ts")
        return e.select(
            F.col("user_id").alias("kernel_id"),
            F.col("event_id").alias("job_id"),
            start.alias("start_ms"),
            (start + F.floor(F.col("value") * 60000).cast("long")).alias("end_ms"),
            F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("status"),
        )

    @cached_property
    def kernel_stages(self) -> DataFrame:
        """Adapter extension: stage submissions of the kernel jobs; a kernel has five stages, submitted again and again."""
        return self.kernel_jobs.select("kernel_id", (F.col("job_id") % 5).alias("stage_id"), "job_id", (F.col("start_ms") + 1000).alias("t"))

    @cached_property
    def kernel_task_events(self) -> DataFrame:
        """Adapter extension: two tasks per kernel job; they may end after their stage was submitted again."""
        j = self.kernel_jobs.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
        ev = F.explode(F.array(
            F.struct(F.lit("task_start").alias("event"), (F.col("start_ms") + 2000 + F.col("i") * 1000).alias("t")),
            F.struct(F.lit("task_end").alias("event"), (F.col("end_ms") + 3000 + F.col("i") * 500).alias("t")))).alias("e")
        return j.select("kernel_id", (F.col("job_id") % 5).alias("stage_id"), (F.col("job_id") * 2 + F.col("i")).alias("task_id"), ev).select(
            "kernel_id", "stage_id", "task_id", "e.event", "e.t")


def load(spark: SparkSession, sf_dir: str) -> TestdataTrace:
    return TestdataTrace(spark, sf_dir)
