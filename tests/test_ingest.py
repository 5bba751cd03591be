"""Tables written on first use, pairing without a sort before its exchange, compressed and unsorted writes."""

import glob
import os
from types import SimpleNamespace

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracefold.operators import entities, report
from tracefold.plans.catalog import all_queries
from tracefold.plans.context import Ctx
from tracefold.session import unsorted_folders
from tracefold.sources import eventlog, messages
from tracefold.sources.lifecycle import from_trace
from tracefold.sources.store import StoredTables
from tracefold.sources.testdata import TestdataTrace
from tracefold.streaming.state import Versions


def test_only_the_tables_asked_for(spark, scratch):
    path = os.path.join(scratch, "suppliers_only")
    rows = spark.createDataFrame([(1, 3), (10, 4), (10, 4), (None, 5)], "s_suppkey long, s_nationkey int")
    rows.write.parquet(f"{path}/supplier.parquet")
    c = Ctx(spark, path)  # there is no other table, so nothing else can have been read
    got = {(r.executor_id, r.host, r.removed_ms is not None) for r in c.executors.collect()}
    assert got == {("1", "host-3", False), ("10", "host-4", True), (None, "host-5", False)}


def test_rows_are_not_combined_before_they_move(spark):
    s = spark.createDataFrame([(1, 7, 5, "x"), (1, 7, 4, "y"), (None, 7, 1, "z")], "app_id int, executor_id int, t long, v string")
    parts = entities._parts(s, s, ["app_id", "executor_id"], ["t", "v"], ["t", "v"])
    merged = entities.merge_parts(parts, ["app_id", "executor_id"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]
    assert {(r.app_id, r.s.v, r.e.v) for r in merged.collect()} == {(1, "y", "x"), (None, "z", "z")}


def test_compressed_files_hold_all_records(spark, sf001, scratch):
    lc = from_trace(TestdataTrace(spark, sf001))
    msgs = messages.to_messages(lc).cache()
    messages.write_messages(msgs, f"{scratch}/gz", compression="gzip")
    assert glob.glob(f"{scratch}/gz/app_id=*/*.txt.gz") and not glob.glob(f"{scratch}/gz/app_id=*/*.txt")
    got = messages.read_messages(spark, f"{scratch}/gz").select(F.col("app_id").cast("long"), "value")
    assert got.exceptAll(msgs.select(F.col("app_id").cast("long"), "value")).isEmpty() and got.count() == msgs.count()
    eventlog.write_event_log(eventlog.to_event_log(lc), f"{scratch}/logs", compression="gzip")
    eventlog.store_events(eventlog.read_events(spark, f"{scratch}/logs"), f"{scratch}/events")
    counts = eventlog.event_counts(eventlog.open_stored(spark, f"{scratch}/events")).collect()
    assert sum(r.n for r in counts) == msgs.count() and {r.undecodable for r in counts} == {0}
    msgs.unpersist()


def test_folders_are_written_without_a_sort(spark, scratch):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    with unsorted_folders(spark):
        assert int(spark.conf.get(key)) > 1
    assert spark.conf.get(key, None) == before
    rows = spark.range(100).select("id", F.pmod("id", F.lit(3)).alias("side"))
    out = Versions(spark, f"{scratch}/versions", ("side",)).write(rows, 0)
    assert out.exceptAll(rows.select("id", "side")).isEmpty() and out.count() == 100


def test_folders_are_written_in_small_row_groups(spark, scratch):
    """A task holds a row group of each file that it writes, and whoever reads a split of the file all of its groups."""
    noise = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(8)])
    rows = spark.range(0, 100_000, 1, 1).select("id", (F.col("id") % 2 == 0).alias("held"), noise.alias("value"))
    Versions(spark, f"{scratch}/v", ("held",)).write(rows, 0)
    for held in ("true", "false"):
        [path] = glob.glob(f"{scratch}/v/batch=000000000/held={held}/*.parquet")
        meta = pq.ParquetFile(path).metadata
        assert meta.num_rows == 50_000 and meta.num_row_groups > 1
    assert spark.read.parquet(f"{scratch}/v/batch=000000000").agg(F.sum("id")).first()[0] == sum(range(100_000))


def test_stored_tables_are_compressed_well(spark, scratch):
    class Source:
        plain = spark.range(10)

    stored = StoredTables(spark, scratch, Source(), ["plain"])
    assert stored.plain.count() == 10
    [path, *_] = glob.glob(f"{scratch}/plain/*.parquet")
    assert pq.ParquetFile(path).metadata.row_group(0).column(0).compression == "ZSTD"


def _events(spark):
    info = "stage_id long, stage_attempt int, task_index int, attempt long, executor_id string, host string, speculative boolean"
    rows = [(1, 5, 10, 3, 0, 1, 0, "a", "h", False), (1, 5, 10, 3, 0, 1, 0, "b", None, False), (1, 5, 9, 3, 0, 1, 0, None, "g", False),
            (1, 6, None, 3, 0, 1, 0, "c", "h", True), (None, 7, 4, 3, 0, 1, 0, "d", "i", None), (1, None, 4, 3, 0, 1, 0, "e", "j", None)]
    start = spark.createDataFrame(rows, f"app_id int, task_id long, t long, {info}")
    ended = spark.createDataFrame([*rows[:4], (1, 8, 7, 3, 0, 1, 0, "z", "y", False)], start.schema).select(
        "*", F.col("t").alias("launch_ms"), F.lit("R").alias("task_type"), F.lit("Success").alias("end_reason"), F.lit(None).cast("string").alias("error_message"),
        F.lit(0).alias("getting_result_at"), F.lit(None).cast("long").alias("metrics"))
    stage = spark.createDataFrame([(1, 1, 0, 5, "n", 2), (1, 1, 0, 5, "m", 2), (1, 2, 0, None, "n", 2), (None, 3, 1, 5, "n", 2)],
                                  "app_id int, stage_id long, stage_attempt int, t long, name string, num_tasks long").withColumn("parent_ids", F.array(F.lit(1)))
    done = spark.createDataFrame([(1, 1, 0, 9, 5, 2, None), (1, 1, 0, 9, 5, 2, "bad"), (1, 1, 0, 8, 5, 2, "bad"), (1, 2, 0, None, 5, 2, "bad"), (1, 4, None, 9, 5, 2, None)],
                                 "app_id int, stage_id long, stage_attempt int, t long, submission_ms long, num_tasks long, failure_reason string")
    return SimpleNamespace(task_start=start, task_end=ended, stage_submitted=stage, stage_completed=done)


def test_narrow_pairing_gives_the_rows_of_the_whole(spark):
    lc = _events(spark)
    for whole, narrow in ((entities.pair_tasks(lc).select("app_id", "task_id", "executor_id", "host"), entities.pair_task_info(lc, "executor_id", "host")),
                          (entities.pair_stages(lc).select(*entities.STAGE_KEY, "status"), entities.pair_stage_status(lc))):
        assert narrow.exceptAll(whole).isEmpty() and narrow.count() == whole.count()
        plan = narrow._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and not {"task_type", "parent_ids"} & set(plan.split("Exchange")[0].replace("#", " ").split())


def test_groups_and_job_table_write_no_wide_tables(spark, sf001, scratch):
    path = os.path.join(scratch, "sf")
    os.symlink(sf001, path)
    groups = all_queries()["P15_executor_group"].fn(spark, path)
    assert groups.count() > 0
    table = all_queries()["T1_job_table"].fn(spark, path)
    assert table.count() > 0
    written = Ctx(spark, path)._ent.written
    assert written("jobs") and not written("tasks") and not written("stages")


def test_job_texts_do_not_move_with_each_stage(spark, sf001):
    c = Ctx(spark, sf001)
    table = report.job_table(c.lc, c.jobs, c.stage_status)
    plan = table._jdf.queryExecution().explainString(table._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [block.split("Input", 1)[1].splitlines()[0] for block in plan.split("\n\n") if ") Exchange" in block and "stage_id" in block.split("Arguments", 1)[-1]]
    assert moved and not any(f"{name}#" in m for m in moved for name in (" name", "[name", "stage_name", "call_site"))
