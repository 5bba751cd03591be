"""Inputs as real logs have them: missing times, the listener's metrics, tasks without jobs, odd markup."""

from pyspark.sql import functions as F

from tracefold.operators import counters, entities, findings, links
from tracefold.operators.sweep import running_sums
from tracefold.sources import messages


def _lifecycle(spark, *records):
    rows = spark.createDataFrame([("app", r) for r in records], "app_id string, value string")
    return messages.to_lifecycle(messages.parse_messages(rows))


def test_events_without_a_time_are_paired(spark):
    lc = _lifecycle(
        spark,
        '{"msgtype":"sparkJobStart","jobId":1,"name":"n","stageIds":[7]}',
        '{"msgtype":"sparkJobEnd","jobId":1,"status":"FAILED"}',
        '{"msgtype":"sparkStageCompleted","stageId":7,"stageAttemptId":0,"status":"FAILED","completionTime":-1,"numTasks":2}',
    )
    job = entities.pair_jobs(lc).first()
    assert (job.has_start, job.name, job.stage_ids, job.status) == (True, "n", [7], "FAILED")
    assert entities.pair_stages(lc).first().status == "FAILED"


def test_known_times_go_before_missing_ones(spark):
    lc = _lifecycle(
        spark,
        '{"msgtype":"sparkJobStart","jobId":1,"name":"late"}',
        '{"msgtype":"sparkJobStart","jobId":1,"name":"first","submissionTime":5}',
        '{"msgtype":"sparkJobEnd","jobId":1,"status":"FAILED"}',
        '{"msgtype":"sparkJobEnd","jobId":1,"status":"SUCCEEDED","completionTime":9}',
    )
    job = entities.pair_jobs(lc).first()
    assert (job.name, job.submission_ms, job.status, job.completion_ms) == ("first", 5, "SUCCEEDED", 9)


def test_metrics_as_the_listener_sends_them(spark):
    from tracefold.operators.phases import task_phases

    lc = _lifecycle(
        spark,
        '{"msgtype":"sparkTaskEnd","taskId":1,"stageId":1,"stageAttemptId":0,"launchTime":1000,"finishTime":2000,"status":"SUCCESS",'
        '"metrics":{"schedulerDelay":530,"executorComputingTime":250,"shuffleReadTime":20,"shuffleWriteTime":30,"deserializationTime":60,'
        '"serializationTime":10,"gettingResultTime":100}}',
    )
    p = task_phases(entities.pair_tasks(lc)).first().phases.asDict()
    assert (p["scheduler_delay_ms"], p["computing_ms"], p["shuffle_read_ms"], p["shuffle_write_ms"], p["getting_result_ms"]) == (530, 250, 20, 30, 100)


def test_rollup_of_paired_tasks(spark):
    tasks = spark.createDataFrame([("a", 1, "SUCCESS"), ("a", 1, "FAILED"), ("a", 9, "RUNNING")], "app_id string, stage_id long, status string")
    jobs = spark.createDataFrame([("a", 4, [1, 2]), ("a", 5, [1])], "app_id string, job_id long, stage_ids array<long>")
    rows = {(r.job_id, r.stage_id, r.level): r.num_tasks for r in counters.rollup_counters(tasks, jobs).collect()}
    assert rows[(4, 1, 0)] == 2 and rows[(None, 9, 0)] == 1 and rows[(None, None, 7)] == 3


def test_stages_with_two_tasks_have_stragglers_too(spark):
    tasks = spark.createDataFrame([("a", 1, 0, 1, 0, 10), ("a", 1, 0, 2, 0, 100)], "app_id string, stage_id long, stage_attempt int, task_id long, launch_ms long, finish_ms long")
    assert [(r.task_id, r.n_finished) for r in findings.stragglers(tasks).collect()] == [(2, 2)]


PAGE = """<!-- <a href="/no"> --><a data-href="/keep" HREF='/x?a=1&amp;b=2'>t</a><A class="q>r" href=/proxy/application_1_2/jobs/>u</A>
<script src="/s.js">var t = '<a href="/no">';</script><style>a { b: url("/no") }</style><img alt="src='/no'" src="i.png"/><b href="/no"></b>"""


def test_links_of_odd_markup(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "no links")], "page_id long, html string")
    got = [(r.tag, r.attribute, r.value) for r in links.extract_links(pages).orderBy("page_id", "pos").collect()]
    assert got == [("a", "href", "/x?a=1&amp;b=2"), ("a", "href", "/proxy/application_1_2/jobs/"), ("script", "src", "/s.js"), ("img", "src", "i.png")]
    out = {r.page_id: r.html for r in links.rewrite_links(pages, "/r/").collect()}
    want = PAGE.replace("HREF='/x?a=1&amp;b=2'", 'HREF="/r/x?a=1&amp;b=2"').replace("href=/proxy/application_1_2/jobs/", 'href="/r/jobs/"')
    assert out[1] == want.replace('src="/s.js"', 'src="/r/s.js"').replace('src="i.png"', 'src="/r/i.png"')
    assert (out[2], out[3], out[4]) == ("", None, "no links")


def test_sweep_moves_its_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    out = running_sums(df, ["k"], "t", ["v"], total_suffix="_all")
    assert out.where("v_all NOT IN (333, 334) OR v_run != t div 3 + 1").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan


def test_sentinels_by_type(spark):
    from tracefold.functions.columns import null_sentinel

    row = spark.createDataFrame([(-1, "-1", "null"), (5, None, "x")], "n long, a string, b string")
    got = row.select(null_sentinel("n"), null_sentinel("a", numeric=False), null_sentinel("b", numeric=False)).collect()
    assert [tuple(r) for r in got] == [(None, "-1", None), (5, None, "x")]
