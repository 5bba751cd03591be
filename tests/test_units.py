"""Unit tests on hand-written inputs: scalar rules, phases, cells, retention, attribution quirks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracefold.functions.columns import format_duration, short_name, to_proportion
from tracefold.operators import attribution, cells, counters, entities, phases, retention, series
from tracefold.operators.links import url_path_join
from tracefold.sources.lifecycle import METRICS_TYPE, STAGE_INFO_TYPE, Lifecycle


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0]["x"]


def test_short_name_escapes_then_cuts(spark):
    assert _one(spark, short_name(F.lit("a<b c"))) == "a&lt;b"
    assert _one(spark, short_name(F.lit("&x>y z"))) == "&amp;x&gt;y"
    assert _one(spark, short_name(F.lit("count at cell:3"))) == "count"


@pytest.mark.parametrize("ms,text", [
    (0, "0m:00s"), (65_000, "1m:05s"), (3_723_000, "1h:02m:03s"), (90_061_000, "1d 1h:01m:01s"),
])
def test_format_duration(spark, ms, text):
    assert _one(spark, format_duration(F.lit(ms))) == text


def test_format_duration_with_millis(spark):
    assert _one(spark, format_duration(F.lit(65_042), with_millis=True)) == "1m:05s:042ms"


def test_zero_length_task_proportion_is_null(spark):
    assert _one(spark, to_proportion(F.lit(0), F.lit(0))) is None
    assert _one(spark, to_proportion(F.lit(25), F.lit(100))) == 25.0


def _task(spark, rows):
    schema = ("app_id string, task_id bigint, stage_id bigint, launch_ms bigint, finish_ms bigint, "
              f"getting_result_at bigint, metrics {METRICS_TYPE.simpleString()}")
    return spark.createDataFrame(rows, schema)


def test_task_phases_definitions(spark):
    m = (600, 50, 20, 100, 50_000_000, 0, 0, 0, 0, 0)  # run, deser, ser, fetch, write ns, ...
    df = _task(spark, [("a", 1, 0, 1000, 2000, 1970, m), ("a", 2, 0, 1000, 2000, 0, None)])
    out = {r["task_id"]: r["phases"] for r in phases.task_phases(df).collect()}
    p = out[1]
    assert out[2] is None  # no metrics: computed, not emitted
    assert p["getting_result_ms"] == 30
    assert p["scheduler_delay_ms"] == 1000 - 600 - 70 - 30
    assert p["computing_ms"] == 600 - 100 - 50
    assert p["shuffle_write_ms"] == 50
    assert p["scheduler_delay_pct"] == pytest.approx(30.0)
    assert p["computing_pct"] == pytest.approx(100 - 30 - 10 - 5 - 2 - 5 - 3)
    # positions: running sums in display order
    assert p["deserialization_pos"] == pytest.approx(30.0)
    assert p["shuffle_read_pos"] == pytest.approx(35.0)
    assert p["computing_pos"] == pytest.approx(45.0)
    assert p["getting_result_pos"] == pytest.approx(97.0)


def _signals(spark, seq):
    rows = [(1, i, i % 12, 1000 * (i + 1), s) for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "kernel_id bigint, seq bigint, cell_id bigint, ts_ms bigint, signal string")


def _simulate_queue(seq):
    queue, runs, cur = [], [], None
    for i, s in enumerate(seq):
        t = 1000 * (i + 1)
        if s == "execute":
            queue.append((i, t))
            if len(queue) == 1:
                runs.append([i, t, None])
        elif queue:
            runs[-1][2] = t
            queue.pop(0)
            if queue:
                runs.append([queue[0][0], t, None])
    return [(r[1], r[2]) for r in runs]


def test_cell_runs_ignore_idle_on_empty_queue(spark):
    seq = ["idle", "execute", "execute", "idle", "idle", "idle", "execute"]
    got = cells.cell_runs(_signals(spark, seq)).orderBy("run_no").collect()
    started = [(r["start_ms"], r["end_ms"]) for r in got if r["start_ms"] is not None]
    assert started == _simulate_queue(seq)
    assert [r["run_no"] for r in got] == [1, 2, 3]


def test_cell_runs_match_sequential_queue(spark):
    rnd = random.Random(7)
    seq = [rnd.choice(["execute", "idle", "idle"]) for _ in range(300)]
    got = cells.cell_runs(_signals(spark, seq)).collect()
    started = sorted((r["start_ms"], r["end_ms"]) for r in got if r["start_ms"] is not None)
    assert started == sorted(_simulate_queue(seq), key=lambda x: (x[0], x[1] is None, x[1]))


def _simulate_retention(n, limit):
    kept = []
    for i in range(1, n + 1):
        kept.append(i)
        if len(kept) > limit:
            k = max(limit // 10, len(kept) - limit)
            kept = kept[k:]
    return kept


@pytest.mark.parametrize("n,limit", [(1001, 1000), (1101, 1000), (57, 5), (400, 37), (10, 10)])
def test_retention_equals_one_by_one_eviction(spark, n, limit):
    items = spark.range(1, n + 1).select(
        F.lit("a").alias("app_id"), F.lit("completedJobs").alias("list"), F.col("id").cast("string").alias("item_key"),
        (F.col("id") * 10).alias("t"), F.lit(7).alias("kind_rank"), F.col("id").alias("tiebreak"))
    got = sorted(r["arrival_no"] for r in retention.retain_recent(items, limit).collect())
    assert got == _simulate_retention(n, limit)


def _lifecycle(spark, job_start, job_end, stage_sub, stage_done, task_start, task_end, execs=(), removed=()):
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    ts = ("app_id string, stage_id bigint, stage_attempt int, task_id bigint, task_index int, attempt bigint, "
          "executor_id string, host string, speculative boolean, t bigint")
    return Lifecycle(
        app_start=df([], "app_id string, t bigint, app_name string, user string, attempt_id string"),
        app_end=df([], "app_id string, t bigint"),
        job_start=df(job_start, "app_id string, job_id bigint, t bigint, job_group string, name string, call_site string, "
                                f"stage_ids array<bigint>, stage_infos array<{STAGE_INFO_TYPE.simpleString()}>"),
        job_end=df(job_end, "app_id string, job_id bigint, t bigint, result string"),
        stage_submitted=df(stage_sub, "app_id string, stage_id bigint, stage_attempt int, t bigint, name string, "
                                      "num_tasks bigint, parent_ids array<bigint>"),
        stage_completed=df(stage_done, "app_id string, stage_id bigint, stage_attempt int, t bigint, submission_ms bigint, "
                                       "num_tasks bigint, failure_reason string"),
        task_start=df(task_start, ts),
        task_end=df(task_end, ts + ", launch_ms bigint, task_type string, end_reason string, error_message string, "
                                   f"getting_result_at bigint, metrics {METRICS_TYPE.simpleString()}"),
        exec_added=df(execs, "app_id string, executor_id string, t bigint, host string, cores bigint"),
        exec_removed=df(removed, "app_id string, executor_id string, t bigint, reason string"),
    )


def _info(stage, n=2):
    return (stage, n, f"stage {stage}", None)


def _shared_stage_lc(spark):
    # jobs 1 and 2 both plan stage 10; job 1 ends at t=50, job 2 at t=100
    js = [("a", 1, 0, None, "one", None, [10], [_info(10)]), ("a", 2, 5, None, "two", None, [10, 11], [_info(10), _info(11)])]
    je = [("a", 1, 50, "JobSucceeded"), ("a", 2, 100, "JobFailed")]
    ss = [("a", 10, 0, 10, "stage 10", 2, [])]
    sd = [("a", 10, 0, 90, 10, 2, None)]
    tstart = [("a", 10, 0, 100 + i, i, 0, "e1", "h", False, 20 + i) for i in range(2)]
    tend = [("a", 10, 0, 100, 0, 0, "e1", "h", False, 40, 20, "ResultTask", "Success", None, 0, None),
            ("a", 10, 0, 101, 1, 0, "e1", "h", False, 60, 21, "ResultTask", "Success", None, 0, None),
            ("a", 10, -1, 102, 1, 1, "e1", "h", True, 70, 22, "ResultTask", "Success", None, 0, None)]
    return _lifecycle(spark, js, je, ss, sd, tstart, tend)


def test_active_vs_planned_attribution(spark):
    lc = _shared_stage_lc(spark)
    jobs = entities.pair_jobs(lc)
    act = {r["job_id"]: r for r in attribution.job_task_counts(lc, jobs, "active").collect()}
    pla = {r["job_id"]: r for r in attribution.job_task_counts(lc, jobs, "planned").collect()}
    # job 1 ends at 50: it sees both starts but only the end at 40
    assert (act[1]["n_started"], act[1]["n_succeeded"]) == (2, 1)
    # job 2 sees everything in (5, 100); the end with stage attempt -1 is not counted
    assert (act[2]["n_started"], act[2]["n_succeeded"]) == (2, 2)
    assert (pla[1]["n_started"], pla[1]["n_succeeded"]) == (2, 2)


def test_skipped_stage_and_counters(spark):
    lc = _shared_stage_lc(spark)
    jobs = entities.pair_jobs(lc)
    sk = [(r["job_id"], r["stage_id"]) for r in attribution.skipped_stages(lc, jobs).collect()]
    assert sk == [(2, 11)]  # planned, never submitted
    c = {r["job_id"]: r for r in counters.job_skip_counters(lc, jobs).collect()}
    assert (c[2]["skipped_stages"], c[2]["skipped_tasks"], c[2]["effective_stages"]) == (1, 2, 1)
    st = {r["job_id"]: r for r in counters.job_stage_counters(lc, jobs).collect()}
    assert st[2]["completed_stages"] == 1 and st[1]["completed_stages"] == 0  # completion at 90 is after job 1 ended


def test_end_without_start_is_kept(spark):
    lc = _lifecycle(spark, [], [("a", 7, 10, "JobSucceeded")], [], [], [], [])
    rows = entities.pair_jobs(lc).collect()
    assert len(rows) == 1 and rows[0]["has_start"] is False and rows[0]["status"] == "SUCCEEDED"
    un = {r["kind"]: r["n_events"] for r in attribution.unattributed(lc, entities.pair_jobs(lc)).collect()}
    assert un == {"job_end": 1}


def test_executor_removed_never_added_counts_zero(spark):
    lc = _lifecycle(spark, [], [], [], [], [], [], execs=[("a", "1", 0, "h", 4)], removed=[("a", "9", 5, "lost")])
    ex = {r["executor_id"]: r for r in entities.pair_executors(lc).collect()}
    assert ex["9"]["cores"] == 0 and ex["9"]["added_ms"] is None


def test_idle_plus_busy_equals_capacity(spark, sf001):
    from tracefold.sources.testdata import TestdataTrace

    tr = TestdataTrace(spark, sf001)
    for r in series.idle_core_time(tr.tasks, tr.executors).collect():
        assert r["idle_core_ms"] + r["busy_core_ms"] == r["capacity_core_ms"] or r["peak_active"] > r["peak_cores"]


def test_active_series_never_negative(spark, sf001):
    from tracefold.sources.testdata import TestdataTrace

    tr = TestdataTrace(spark, sf001)
    s = series.active_tasks_series(tr.tasks, "step")
    assert s.where(F.col("active") < 0).count() == 0


@pytest.mark.parametrize("pieces, joined", [
    (("/root/", "/x/y/"), "/root/x/y/"), (("root", "x"), "root/x"), (("/", "/"), "/"), (("/a//", "", "b"), "/a/b"),
    (("", "/"), "/"), (("/p", "http://h/x"), "/p/http://h/x"),
])
def test_url_path_join(spark, pieces, joined):
    assert _one(spark, url_path_join(*pieces)) == joined


def test_lanes_greedy_and_split_at_idle_gaps(spark):
    from tracefold.operators.timeline import assign_lanes

    rows = [(1, "g", "a", 0, 10), (1, "g", "b", 1, 3), (1, "g", "c", 2, 12), (1, "g", "d", 4, 6),
            (1, "g", "e", 12, 13), (1, "g", "f", 20, 25), (1, "g", "h", 21, None)]
    items = spark.createDataFrame(rows, "app_id bigint, grp string, item_id string, start_ms bigint, end_ms bigint")
    got = {r["item_id"]: (r["lane"], r["busy_period"]) for r in assign_lanes(items).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0, "f": 0, "h": 1}
    # c ends at 12 when e starts: e opens a new busy period
    assert [got[k][1] for k in "abcdefh"] == [1, 1, 1, 1, 2, 3, 3]


def test_skipped_replanned_rule(spark):
    # job 1 plans stage 10, which runs; job 2 re-plans the finished stage later and ends without rerunning it
    js = [("a", 1, 0, None, "one", None, [10], [_info(10)]), ("a", 2, 40, None, "two", None, [10], [_info(10)])]
    je = [("a", 1, 30, "JobSucceeded"), ("a", 2, 50, "JobSucceeded")]
    ss = [("a", 10, 0, 10, "stage 10", 2, [])]
    sd = [("a", 10, 0, 20, 10, 2, None)]
    lc = _lifecycle(spark, js, je, ss, sd, [], [])
    jobs = entities.pair_jobs(lc)
    listener = sorted((r["job_id"], r["stage_id"]) for r in attribution.skipped_stages(lc, jobs, "listener").collect())
    replanned = sorted((r["job_id"], r["stage_id"]) for r in
                       attribution.skipped_stages(lc, jobs, "replanned").collect())
    assert listener == []
    assert replanned == [(2, 10)]


def test_stage_retry_completed_set(spark):
    # job 1 plans stages 10 and 11. Stage 10: attempt 0 fails, attempt 1 succeeds.
    # Stage 11: attempt 0 succeeds, then a resubmit (attempt 1) fails: the resubmit removes it from the set.
    js = [("a", 1, 0, None, "one", None, [10, 11], [_info(10), _info(11)])]
    je = [("a", 1, 1000, "JobFailed")]
    ss = [("a", 10, 0, 10, "s10", 2, []), ("a", 10, 1, 30, "s10", 2, []),
          ("a", 11, 0, 40, "s11", 2, []), ("a", 11, 1, 60, "s11", 2, [])]
    sd = [("a", 10, 0, 20, 10, 2, "fetch failed"), ("a", 10, 1, 35, 30, 2, None),
          ("a", 11, 0, 50, 40, 2, None), ("a", 11, 1, 70, 60, 2, "lost")]
    lc = _lifecycle(spark, js, je, ss, sd, [], [])
    jobs = entities.pair_jobs(lc)
    r = counters.job_stage_counters(lc, jobs).collect()[0]
    assert (r["completed_stages"], r["failed_stages"], r["active_stages"]) == (1, 2, 0)
    naive = counters.job_stage_counters_naive(lc, jobs).collect()[0]
    assert (naive["completed_stages"], naive["failed_stages"]) == (2, 2)


def test_bucket_borders_follow_the_rows(spark):
    """One dense hour in a year, one application with a third of all rows: no bucket is twice the mean."""
    from tracefold.operators.sweep import BUCKET, running_sums, with_bucket

    hour, year = 3_600_000, 31_536_000_000
    i = F.col("id")
    t = F.when(i % 10 < 9, F.lit(year // 2) + F.pmod(F.xxhash64("id"), F.lit(hour))).otherwise(F.pmod(F.xxhash64("id"), F.lit(year)))
    df = spark.range(30_000).select(F.when(i % 3 == 0, 0).otherwise(i % 50).alias("app"), t.alias("t"), F.lit(1).alias("d"), "id")
    sizes = [r["count"] for r in with_bucket(df, ["app"], "t", 64).groupBy(BUCKET).count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 2 * 30_000 / len(sizes)
    got = running_sums(df, ["app"], "t", ["d"], tiebreak=["id"], next_time="nt", total_suffix="_all", buckets=64).toPandas().sort_values(["app", "t", "id"])
    assert (got["d_run"] == got.groupby("app")["d"].cumsum()).all()
    want = got.groupby("app")["t"].shift(-1)
    assert (got["nt"].fillna(-1) == want.fillna(-1)).all()
    assert (got["d_all"] == got.groupby("app")["d"].transform("sum")).all()


def test_merge_tree_takes_few_partials_at_a_time(spark):
    """A user's merge sees at most FAN_IN partials, or one partition's own, of one key."""
    from tracefold.operators import hist

    spec = hist.HistSpec("h", "id", 0, 100, 4)
    most = hist.FAN_IN

    def merge(pdf):
        assert len(pdf) <= most and pdf["bin"].nunique() == 1
        return hist.add_counts(pdf)

    got = hist.process_and_merge(spark.range(0, 100, 1, 40), hist.numpy_fill([spec]), merge=merge)
    assert sorted((r["bin"], r["count"]) for r in got.collect()) == [(1, 25), (2, 25), (3, 25), (4, 25)]


def test_median_by_rank(spark):
    import statistics

    from tracefold.operators.findings import stage_median_duration

    rng = random.Random(4)
    rows = [("a", s, 0, 0, rng.choice([rng.randrange(40), 7])) for s in range(12) for _ in range(rng.randrange(1, 40))]
    tasks = spark.createDataFrame(rows, "app_id string, stage_id long, stage_attempt int, launch_ms long, finish_ms long")
    med = stage_median_duration(tasks)
    assert "percentile(" not in med._jdf.queryExecution().executedPlan().toString()
    want = {s: (statistics.median(d), len(d)) for s in range(12) if (d := [r[4] for r in rows if r[1] == s])}
    assert {r.stage_id: (r.median_ms, r.n_finished) for r in med.collect()} == want
