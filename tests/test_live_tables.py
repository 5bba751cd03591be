"""Live tables: replay of a batch, bounded state, late rows, chunks cut anywhere."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tracefold.operators import cells as batch_cells
from tracefold.sources.messages import EOD
from tracefold.streaming.cells import LiveCells, kernel_rows
from tracefold.streaming.chunks import ChunkedRecords, stream_chunks
from tracefold.streaming.state import Versions
from tracefold.streaming.tables import LiveSeries, LiveTrace


def _task(kind, task, stage, t, launch=0):
    m = {"msgtype": f"sparkTask{kind}", "taskId": task, "stageId": stage, "stageAttemptId": 0, "index": task, "attemptNumber": 0, "executorId": "1", "host": "h"}
    return m | ({"launchTime": t} if kind == "Start" else {"launchTime": launch, "finishTime": t, "status": "SUCCESS"})


def _job(job, t, stages):
    infos = {str(s): {"attemptId": 0, "name": "n", "numTasks": 2, "completionTime": -1, "submissionTime": -1} for s in stages}
    return {"msgtype": "sparkJobStart", "jobId": job, "jobGroup": "null", "submissionTime": t, "stageIds": stages, "stageInfos": infos, "name": "j"}


def _job_end(job, t):
    return {"msgtype": "sparkJobEnd", "jobId": job, "status": "SUCCEEDED", "completionTime": t}


def _records(spark, *messages):
    return spark.createDataFrame([("a", json.dumps(m)) for m in messages], "app_id string, value string")


BATCHES = [
    [_job(1, 10, [5]), _task("Start", 1, 5, 11), _task("Start", 2, 5, 12), _task("End", 1, 5, 20, 11)],
    [_job(2, 30, [5, 6]), _task("Start", 3, 6, 31), _job_end(1, 40)],
    [_task("End", 2, 5, 25, 12), _task("End", 3, 6, 50, 31), _task("Start", 4, 6, 51)],  # the first one is late: job 1 is closed
]


@pytest.fixture(scope="module")
def live(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("live"))
    trace, series = LiveTrace(spark, base), LiveSeries(spark, base, 10)
    trace.listeners.append(series.on_points)
    for n, batch in enumerate(BATCHES):
        trace.on_batch(_records(spark, *batch), n)
    return trace, series


def test_counts_held_and_late(live):
    trace, series = live
    jobs = {r.job_id: r for r in trace.jobs.current().collect()}
    assert (jobs[1].status, jobs[1].held, jobs[1].n_started, jobs[1].n_succeeded) == ("SUCCEEDED", False, 2, 2)  # the late end too
    assert (jobs[2].status, jobs[2].held, jobs[2].n_started, jobs[2].n_succeeded) == ("RUNNING", True, 2, 1)
    tasks = {r.task_id: (r.status, r.held) for r in trace.tasks.current().collect()}
    assert tasks == {1: ("SUCCESS", False), 2: ("SUCCESS", False), 3: ("SUCCESS", False), 4: ("RUNNING", True)}
    assert [(r.kind, r.entity_id, r.t, r.batch) for r in trace.late.all().collect()] == [("task_end", 2, 25, 2)]
    state = trace.tasks.store.rows(2).where("held")
    assert [r.task_id for r in state.collect()] == [4]  # the state is what is open
    assert {r.window_ms: r.active for r in series.current().collect()} == {10: 2, 20: 0, 30: 1, 50: 1}


def test_changes_are_the_touched_rows(live):
    trace, _ = live
    fed = {(r.batch, r.job_id) for r in trace.jobs.changes().collect()}
    assert fed == {(0, 1), (1, 1), (1, 2), (2, 1), (2, 2)}
    assert {(r.batch, r.task_id) for r in trace.tasks.changes().collect()} == {(0, 1), (0, 2), (1, 3), (2, 2), (2, 3), (2, 4)}


def test_a_repeated_batch_changes_nothing(spark, live):
    trace, series = live
    tables = [trace.jobs.current, trace.tasks.current, trace.stages.current, trace.jobs.changes, series.current, trace.late.all]
    seen = [sorted(map(str, f().collect())) for f in tables]
    trace.on_batch(_records(spark, *BATCHES[2]), 2)
    assert [sorted(map(str, f().collect())) for f in tables] == seen


def test_replaced_versions_can_go(spark, tmp_path):
    trace = LiveTrace(spark, str(tmp_path), keep_changes=False)
    for n, batch in enumerate(BATCHES):
        trace.on_batch(_records(spark, *batch), n)
    assert not os.path.exists(f"{trace.tasks.store.folder(0)}/held=true") and os.path.exists(f"{trace.tasks.store.folder(1)}/held=true")
    assert {r.task_id: r.status for r in trace.tasks.current().collect()}[4] == "RUNNING"


def test_chunks_cut_at_every_byte(spark, tmp_path):
    """One application per cut; the second half of a cut comes a batch later, for every third one before the first half."""
    data = EOD.join(['{"a": "é;EO"}', "{}", '{"b":\n "漢"}', "", '{"c": 1}']).encode() + EOD.encode() + b"rest"
    out = ChunkedRecords(spark, str(tmp_path))
    halves = [(str(c), [(0, data[:c]), (c, data[c:])]) for c in range(len(data) + 1)]
    schema = "app_id string, offset long, content binary"
    for n in (0, 1):
        rows = [(app, *parts[n if int(app) % 3 else 1 - n]) for app, parts in halves]
        out.on_batch(spark.createDataFrame(rows, schema), n)
    # again a chunk that is known, and one that overlaps what is known
    out.on_batch(spark.createDataFrame([("7", 0, data[:7]), ("8", 3, data[3:] + b"!" + EOD.encode())], schema), 2)
    got: dict = {}
    for r in out.records.all().collect():
        got.setdefault(r.app_id, []).append(r.value)
    want = ['{"a": "é;EO"}', "{}", '{"b":\n "漢"}', '{"c": 1}']
    for app, _ in halves:
        assert sorted(got[app]) == sorted(want + (["rest!"] if app == "8" else [])), app
    left = {r.app_id: bytes(r.content) for r in out.unfinished().collect()}
    assert left == {app: b"rest" for app, _ in halves if app != "8"}


def test_chunk_files(spark, tmp_path):
    """A record over three files, the middle one without a separator; the application starts with a gap."""
    land = tmp_path / "land" / "app_id=x"
    os.makedirs(land)
    data = b'{"k": "' + b"v" * 30 + b'"}' + EOD.encode() + b'{"z": 1}' + EOD.encode()
    out = ChunkedRecords(spark, str(tmp_path / "out"))
    for names in ([20, 10], [0]):
        for at in names:
            (land / f"{at:020d}.chunk").write_bytes(data[at : at + 10] if at < 20 else data[at:])
        q = stream_chunks(spark, str(tmp_path / "land")).writeStream.foreachBatch(out.on_batch)
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.value for r in out.records.all().collect()) == sorted(['{"k": "' + "v" * 30 + '"}', '{"z": 1}'])


def test_cells_with_late_rows(spark, tmp_path):
    day = 86_400_000
    signals = [(1, k, k % 3, k * day // 2, "execute" if k % 2 == 0 else "idle") for k in range(40)] + [(2, 100, 7, 0, "idle"), (2, 101, 8, 5, "execute")]
    signals = spark.createDataFrame(signals, "kernel_id long, seq long, cell_id long, ts_ms long, signal string")
    jobs = [(1, k, k * day + 1, k * day + (day if k % 5 else 2 * day)) for k in range(20)] + [(2, 50, 6, None)]
    jobs = spark.createDataFrame(jobs, "kernel_id long, job_id long, start_ms long, end_ms long")
    rows = kernel_rows(signals, jobs).withColumn("slice", F.floor(F.col("t") / (5 * day)) + (F.col("seq") % 4 == 1).cast("int"))
    rows = Versions(spark, str(tmp_path / "given")).write(rows, 0)
    live = LiveCells(spark, str(tmp_path / "live"), 5 * day)
    for n in range(5):
        live.on_batch(rows.where(F.col("slice") == n).drop("slice"), n)
    live.on_batch(rows.where("slice = 4").drop("slice"), 4)  # again
    runs = batch_cells.cell_runs(signals)
    want = batch_cells.completion_signal(runs, batch_cells.attribute_cells(jobs, runs), jobs)
    cols = ["kernel_id", "run_no", "cell_id", "end_ms", "num_jobs", "completed_ms"]
    assert sorted(map(str, live.current().select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert live.too_late.all().isEmpty()
    assert live.state.rows(4).where("kernel_id = 1").count() < rows.where("kernel_id = 1").count() / 2  # old rows have left
