"""Sources, sinks and streaming: framing edge cases, message round trip, live event log, batch = stream."""

from __future__ import annotations

import glob
import os

import pandas as pd
from pyspark.sql import functions as F

from tracefold.operators import entities, hist, links, workload
from tracefold.sources import eventlog, messages
from tracefold.sources.lifecycle import from_trace
from tracefold.sources.testdata import TestdataTrace
from tracefold.streaming import live

JOB_COLS = ["app_id", "job_id", "job_group", "call_site", "status", "submission_ms", "completion_ms"]


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_framing_edge_cases(spark, scratch):
    p = os.path.join(scratch, "m.txt")
    recs = [
        '{"msgtype": "sparkJobStart", "jobId": 1, "jobGroup": "null", "submissionTime": 5, "stageIds": [1],'
        ' "stageInfos": {"1": {"attemptId": 0, "name": "x y", "numTasks": 2, "completionTime": -1, "submissionTime": -1}},'
        ' "name": "null", "numTasks": 2}',
        '{\n  "msgtype": "sparkTaskEnd",\n  "taskId": 3, "stageId": 1, "stageAttemptId": 0, "launchTime": 6,'
        ' "finishTime": 9, "status": "SUCCESS", "metrics": {"": ""}\n}',
        '{"msgtype": "somethingElse"}',
        '{"msgtype": "sparkJobEnd", "jobId": ',  # broken
    ]
    with open(p, "w") as f:
        f.write(";EOD:".join(recs) + ";EOD:" + '{"msgtype": "sparkJobEnd", "jobI')  # unfinished tail
    parsed = messages.parse_messages(messages.read_messages(spark, p).withColumn("app_id", F.lit("a")))
    counts = {(r["kind"], r["msgtype"]): r["n"] for r in messages.type_counts(parsed).collect()}
    assert counts[("known", "sparkJobStart")] == 1 and counts[("unknown", "somethingElse")] == 1
    assert counts[("missing", None)] == 2  # the broken record and the unfinished tail
    lc = messages.to_lifecycle(parsed)
    js = lc.job_start.collect()[0]
    assert js["job_group"] is None and js["name"] is None  # "null" sentinels
    assert js["stage_infos"][0]["completion_ms"] is None  # -1 sentinel
    te = lc.task_end.collect()[0]
    assert te["metrics"] is None and te["end_reason"] == "Success"


def test_message_files_round_trip(spark, sf001, scratch):
    lc = from_trace(TestdataTrace(spark, sf001))
    out = os.path.join(scratch, "msgs")
    messages.write_messages(messages.to_messages(lc), out)
    assert glob.glob(os.path.join(out, "app_id=*", "*.txt"))
    recs = messages.read_messages(spark, out)  # app_id comes back from the folder names
    lc2 = messages.to_lifecycle(messages.parse_messages(recs))
    a = entities.pair_jobs(lc).withColumn("app_id", F.col("app_id").cast("string"))
    b = entities.pair_jobs(lc2).withColumn("app_id", F.col("app_id").cast("string"))
    assert _rows(a, JOB_COLS) == _rows(b, JOB_COLS)
    ta = entities.pair_tasks(lc).withColumn("app_id", F.col("app_id").cast("string"))
    tb = entities.pair_tasks(lc2).withColumn("app_id", F.col("app_id").cast("string"))
    cols = ["app_id", "task_id", "status", "launch_ms", "finish_ms"]
    assert _rows(ta, cols) == _rows(tb, cols)
    # the wire carries the getting-result time inside the metrics object only
    cols = ["app_id", "task_id", "getting_result_at"]
    assert _rows(ta.where(F.col("metrics").isNotNull()), cols) == _rows(tb.where(F.col("metrics").isNotNull()), cols)


def test_stream_equals_batch(spark, sf001, scratch):
    lc = from_trace(TestdataTrace(spark, sf001))
    out = os.path.join(scratch, "stream_in")
    # several files per app so that availableNow runs several micro-batches
    msgs = messages.to_messages(lc).withColumn("slice", F.pmod(F.col("t"), F.lit(4)))
    (msgs.repartition("app_id", "slice").select("app_id", "value").write.mode("overwrite")
     .partitionBy("app_id").option("lineSep", messages.EOD).text(out))
    slc = live.live_lifecycle(spark, out, max_files_per_trigger=2)
    jobs = live.live_jobs(slc)
    q = live.start(jobs, "live_jobs_test", mode="complete", trigger={"availableNow": True},
                   checkpoint=os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    got = spark.table("live_jobs_test").withColumn("app_id", F.col("app_id").cast("string"))
    want = entities.pair_jobs(lc).withColumn("app_id", F.col("app_id").cast("string"))
    assert _rows(got, JOB_COLS) == _rows(want, JOB_COLS)


def test_stream_window_deltas_give_active_tasks(spark, sf001, scratch):
    lc = from_trace(TestdataTrace(spark, sf001))
    out = os.path.join(scratch, "stream_tasks")
    messages.write_messages(messages.to_messages(lc), out)
    slc = live.live_lifecycle(spark, out)
    d = live.task_deltas_by_window(slc, "1 day")
    q = live.start(d, "task_windows_test", mode="complete", trigger={"availableNow": True},
                   checkpoint=os.path.join(scratch, "ckpt2"))
    q.awaitTermination(300)
    act = live.active_from_window_deltas(spark.table("task_windows_test"))
    # batch: tasks running at each window end = launched before end minus finished before end
    tasks = entities.pair_tasks(lc).withColumn("app_id", F.col("app_id").cast("string"))
    sample = act.orderBy("app_id", "window_start_ms").limit(20).collect()
    for r in sample:
        e = r["window_end_ms"]
        n = tasks.where((F.col("app_id") == r["app_id"]) & (F.col("launch_ms") < e)
                        & (F.col("finish_ms").isNull() | (F.col("finish_ms") >= e))).count()
        assert n == r["active"]


def test_live_event_log_of_this_session(spark, scratch):
    log_dir = spark.sparkContext.getConf().get("spark.eventLog.dir")
    spark.range(0, 1000, numPartitions=4).selectExpr("sum(id)").collect()

    def boom(it):
        raise RuntimeError("deliberate task failure")

    try:
        spark.sparkContext.parallelize(range(2), 2).mapPartitions(boom).collect()
    except Exception:
        pass
    spark.range(10).count()  # a later job end flushes the log
    lc = eventlog.read_event_log(spark, log_dir)
    jobs = entities.pair_jobs(lc)
    st = {r["status"] for r in jobs.collect()}
    assert "SUCCEEDED" in st and "FAILED" in st
    tasks = entities.pair_tasks(lc)
    reasons = {r["end_reason"] for r in tasks.collect()}
    assert "Success" in reasons and "ExceptionFailure" in reasons
    msg = tasks.where(F.col("end_reason") == "ExceptionFailure").select("error_message").first()[0]
    assert "deliberate task failure" in msg
    assert lc.app_start.count() >= 1


def test_write_and_read_tables(spark, sf001, scratch):
    tr = TestdataTrace(spark, sf001)
    eventlog.write_tables({"jobs": tr.jobs}, scratch)
    back = eventlog.read_tables(spark, scratch, ["jobs"])["jobs"]
    assert back.count() == tr.jobs.count()


def test_notebook_workload_goldens(spark):
    left = workload.from_values(spark, list(range(0, 5)))
    right = workload.from_values(spark, list(range(10, 15)))
    r = workload.sample_workload(left, right).collect()[0]
    assert r["total"] == "1860" and r["n_values"] == "77"
    n = workload.map_filter_count(spark.range(0, 100), "id").collect()[0][0]
    assert n == 50
    assert spark.range(0, 100).count() == 100


def test_side_channel_sum_and_foreach(spark):
    df, obs = workload.observed_sum(workload.from_values(spark, list(range(10))), "value")
    df.collect()
    assert obs.get["sum"] == 45
    workload.for_each(spark.range(3), lambda it: [None for _ in it])


def test_histogram_merge_equals_fill(spark, sf001, scratch):
    li = spark.read.parquet(f"{sf001}/lineitem.parquet")
    a = hist.histogram_fill(li, hist.LINEITEM_HISTS)
    b = hist.process_and_merge(hist.read_partitioned(spark, [f"{sf001}/lineitem.parquet"], 3),
                               hist.numpy_fill(hist.LINEITEM_HISTS))
    assert _rows(a, ["hist", "bin", "count"]) == _rows(b, ["hist", "bin", "count"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby(["hist", "bin"], as_index=False)["count"].sum()

    c = hist.process_and_merge(li, hist.numpy_fill(hist.LINEITEM_HISTS), merge=merge)
    assert _rows(a, ["hist", "bin", "count"]) == _rows(c, ["hist", "bin", "count"])
    hist.write_histograms(a, os.path.join(scratch, "h"))
    assert spark.read.parquet(os.path.join(scratch, "h")).count() == a.count()


def test_rewrite_links_html(spark):
    doc = ('<html><head><link rel="x" href="/proxy/application_12_3/static/s.css">'
           '<script src="/s.js"></script><script>var a="<a href=\'/no\'>";</script></head>'
           '<body><a href="jobs/">j</a><img src="http://h/i.png"><a name="x">n</a></body></html>')
    pages = spark.createDataFrame([(1, doc)], "page_id bigint, html string")
    out = links.rewrite_links(pages, "/root/").collect()[0]["html"]
    assert 'href="/root/static/s.css"' in out
    assert 'src="/root/s.js"' in out
    assert 'href="/root/jobs/"' in out
    assert 'src="/root/http://h/i.png"' in out  # absolute URLs are not exempt
    assert "<a href='/no'>" in out  # script text is not markup
    assert '<a name="x">' in out


def test_stream_dedup_and_late_events(spark, scratch):
    src = os.path.join(scratch, "dups")
    os.makedirs(src)
    rows = [("a", 1, 1000), ("a", 1, 1000), ("a", 2, 2000), ("b", 1, 1500), ("a", 2, 2000)]
    spark.createDataFrame(rows, "app_id string, task_id bigint, t bigint").write.mode("overwrite").parquet(src + "/p")
    stream = spark.readStream.schema("app_id string, task_id bigint, t bigint").parquet(src + "/p")
    d = live.dedup_events(stream, ["app_id", "task_id"], "t", "1 hour")
    q = live.start(d, "dedup_test", mode="append", trigger={"availableNow": True}, checkpoint=os.path.join(scratch, "c3"))
    q.awaitTermination(120)
    got = sorted((r["app_id"], r["task_id"]) for r in spark.table("dedup_test").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]
    late = live.late_events(spark.createDataFrame(rows, "app_id string, task_id bigint, t bigint"), 1600)
    assert late.count() == 3


def test_rolling_event_log_layout(spark, scratch):
    d = os.path.join(scratch, "logs", "eventlog_v2_app-7")
    os.makedirs(d)
    lines = [
        '{"Event":"SparkListenerApplicationStart","App Name":"x","App ID":"app-7","Timestamp":1,"User":"u"}',
        '{"Event":"SparkListenerJobStart","Job ID":0,"Submission Time":5,"Stage Infos":[],"Stage IDs":[],'
        '"Properties":{"spark.jobGroup.id":"g"}}',
    ]
    with open(os.path.join(d, "events_1_app-7"), "w") as f:
        f.write("\n".join(lines[:1]) + "\n")
    with open(os.path.join(d, "events_2_app-7"), "w") as f:
        f.write("\n".join(lines[1:]) + "\n")
    open(os.path.join(d, "appstatus_app-7"), "w").close()
    lc = eventlog.read_event_log(spark, os.path.join(scratch, "logs"))
    assert [r["app_id"] for r in lc.app_start.collect()] == ["app-7"]
    j = lc.job_start.collect()[0]
    assert (j["app_id"], j["job_group"]) == ("app-7", "g")


def test_write_and_open_trace_store(spark, sf001, scratch):
    from tracefold.sources import store

    lc = from_trace(TestdataTrace(spark, sf001))
    path = os.path.join(scratch, "store")
    store.write_trace(lc, path, partition_by_app=True)
    ent = store.open_entities(spark, path)
    assert glob.glob(os.path.join(path, "entities", "jobs", "app_id=*"))
    assert ent.jobs.count() == entities.pair_jobs(lc).count()
    assert store.open_events(spark, path).task_end.count() == lc.task_end.count()
