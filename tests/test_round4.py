"""Round 4: work that is done once, and compiled."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_are_searched_by_compiled_steps(spark):
    from tracefold.operators.sweep import BUCKET, SPLIT, with_bucket

    rng = random.Random(4)
    rows = [(rng.choice("aaaab"), rng.choice([None, *range(100_000, 50_000_000, 100_000)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "app_id string, t long, id long")
    out = with_bucket(df, ["app_id"], "t", buckets=50)
    assert "lambdafunction" not in _plan(out)
    assert _plan(out.where(F.col(BUCKET).isNotNull() & F.col(SPLIT))).count("get(") < 40  # the steps are not copied into filters
    got = out.collect()
    assert len(got) == len(rows) and len({r[BUCKET] for r in got}) > 40
    for app in "ab":
        mine = sorted((r["t"] or 0, r[BUCKET]) for r in got if r["app_id"] == app)
        assert [b for _, b in mine] == sorted(b for _, b in mine)  # never decreasing with time
        assert len({b for t, b in mine if t == 25_000_000}) <= 1
    whole = with_bucket(spark.createDataFrame([("x", None)], "app_id string, t long"), ["app_id"], "t").first()
    assert whole[SPLIT] is False


def test_lanes_move_the_items_once_for_both_counts(spark):
    from tracefold.operators.timeline import assign_lanes, busy_periods

    rng = random.Random(5)
    rows = []
    for i in range(400):
        s = rng.randrange(0, 3000)
        rows.append((rng.choice([1, 2]), rng.choice("gh"), f"i{i}", rng.choice([s, s, s, None]), rng.choice([None if i < 3 else s + 7, s + 5, s + 11])))
    rows += [(1, "g", None, 5, 9), (None, "g", "n1", 5, 9), (1, None, "n2", 5, 9)]
    items = spark.createDataFrame(rows, "app_id bigint, grp string, item_id string, start_ms bigint, end_ms bigint")
    assert _plan(busy_periods(items)).count("percentile_approx(") <= 4  # one sketch, met by rows and totals of both counts
    got = {(r["app_id"], r["grp"], r["item_id"]): r["lane"] for r in assign_lanes(items).collect()}
    known = [r for r in rows if None not in r[:4]]
    assert set(got) == {r[:3] for r in known}
    for key in {r[:2] for r in known}:
        open_until: list = []  # of each lane
        for a, g, i, s, e in sorted((r for r in rows if r[:2] == key and r[3] is not None and r[2] is not None), key=lambda r: (r[3], r[2])):
            lane = next((k for k, x in enumerate(open_until) if x <= s), len(open_until))
            open_until[lane:lane + 1] = [float("inf") if e is None else e]
            assert got[a, g, i] == lane


def _records():
    return [("a", '{"msgtype":"sparkJobStart","jobId":1,"submissionTime":5,"stageIds":[1]}'), ("a", '{"msgtype":"sparkJobEnd","jobId":1,"completionTime":9,"status":"SUCCEEDED"}'),
            ("b", '{"msgtype":"other"}'), ("b", "not json"), ("b", '{"jobId":3}')]


def test_stored_records_are_decoded_once_and_keep_the_quarantine(spark, tmp_path):
    from tracefold.sources import messages

    parsed = messages.parse_messages(spark.createDataFrame(_records(), "app_id string, value string"))
    messages.store_parsed(parsed, f"{tmp_path}/parsed")
    stored = messages.open_parsed(spark, f"{tmp_path}/parsed", messages.by_type(parsed).schema)
    assert {r["raw"] for r in messages.quarantine(stored).collect()} == {"not json", '{"jobId":3}'}
    was, now = messages.to_lifecycle(parsed), messages.to_lifecycle(stored)
    for kind in was.kinds():
        assert sorted(map(str, getattr(now, kind).collect())) == sorted(map(str, getattr(was, kind).collect()))
    assert "from_json" not in _plan(now.job_start) and "msgtype" in now.job_start._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert sorted(map(str, messages.type_counts(stored).collect())) == sorted(map(str, messages.type_counts(parsed).collect()))


def test_routes_do_not_decode_the_records_for_each_route(spark):
    from tracefold.plans.catalog import all_queries

    assert "from_json" not in _plan(all_queries()["S3_routes"].fn(spark, "/root/testdata/sf0.001"))


def test_slices_are_written_once_and_moved_to_the_landing_folder(spark, tmp_path):
    from tracefold.session import land
    from tracefold.sources import messages
    from tracefold.streaming import live

    rows = [(a, i, 1, v, k) for i, (a, v) in enumerate(_records()) for k in (0, 2)]
    messages.write_messages(spark.createDataFrame(rows, "app_id string, t long, kind_rank int, value string, slice int"), f"{tmp_path}/sliced", compression="gzip", by=("slice",))
    seen = []
    for k in range(3):  # nothing was written for slice 1
        land(spark, f"{tmp_path}/sliced/slice={k}", f"{tmp_path}/landing", f"slice={k}")
        live.start(live.stream_records(spark, f"{tmp_path}/landing"), f"moved-{k}", mode="append", trigger={"availableNow": True},
                   sink=lambda df, n: seen.append(sorted((r["app_id"], r["value"]) for r in df.collect())), checkpoint=f"{tmp_path}/checkpoint").awaitTermination()
    assert seen == [sorted(_records())] * 2
    spark.range(3).write.parquet(f"{tmp_path}/plain/slice=0")
    spark.range(4).write.parquet(f"{tmp_path}/plain/slice=1")
    for k in range(2):
        land(spark, f"{tmp_path}/plain/slice={k}", f"{tmp_path}/files")
    assert spark.read.parquet(f"{tmp_path}/files").count() == 7


def test_late_ends_are_told_without_decoding_other_messages(spark):
    from tracefold.plans.q_streams import FIRST_MS, LATE_BY, LATE_EVERY, LATE_REST, sliced_messages
    from tracefold.plans.context import Ctx

    out = sliced_messages(Ctx(spark, "/root/testdata/sf0.001").lc)
    plan = _plan(out)
    assert "$.msgtype" not in plan and plan.count("$.taskId") == 1  # the branches of other types are folded away
    late = out.where(F.get_json_object("value", "$.msgtype") == "sparkTaskEnd").select("t", "slice", F.get_json_object("value", "$.taskId").cast("long").alias("id")).collect()
    own = lambda t: min(max((t - FIRST_MS) // 51926400000, 0), 3)
    assert late and all(r["slice"] == min(3, own(r["t"]) + (LATE_BY if r["id"] % LATE_EVERY == LATE_REST else 0)) for r in late)


def test_waiting_bytes_are_kept_by_the_last_two_batches_alone(spark, tmp_path):
    import os

    from tracefold.streaming.chunks import ChunkedRecords

    text = b"".join(b"record %d;EOD:" % i for i in range(40)) + b"tail"
    chunks = [("a", at, text[at:at + 16]) for at in range(0, len(text), 16)]
    out = ChunkedRecords(spark, str(tmp_path))
    for n, part in enumerate([chunks[5::2], chunks[5::2], chunks[4::2], chunks[2:4], chunks[:3]]):  # behind gaps, and again
        batch = spark.createDataFrame([(a, at, bytearray(b)) for a, at, b in part], "app_id string, offset long, content binary")
        out.on_batch(batch, n)
        if n == 2:
            out.on_batch(batch, n)  # repeated
    assert sorted(r["value"] for r in out.records.all().collect()) == sorted(f"record {i}" for i in range(40))
    assert [bytes(r["content"]) for r in out.unfinished().collect()] == [b"tail"]
    assert sorted(d for d in os.listdir(tmp_path / "tails")) == ["batch=000000003", "batch=000000004"]
    assert not [d for d in os.listdir(tmp_path / "taken") if d.startswith("batch=")]


def test_job_messages_are_made_and_decoded_once(spark):
    from tracefold.plans.catalog import all_queries

    plan = _plan(all_queries()["S3_parse_messages"].fn(spark, "/root/testdata/sf0.001"))
    assert "from_json" not in plan and "to_json" not in plan


def test_planners_of_stages_need_no_texts_of_jobs(spark):
    from types import SimpleNamespace

    from tracefold.operators import entities
    from tracefold.sources.messages import active_planners

    start = "app_id string, job_id long, t long, job_group string, name string, call_site string, stage_ids array<long>, stage_infos array<struct<stage_id:long>>"
    lc = SimpleNamespace(
        job_start=spark.createDataFrame([("a", 1, 5, "g", "n", "c", [1, 2], []), ("a", 1, 5, "g", "m", "c", [3], []), ("a", 2, None, None, None, None, [1], None), ("a", 2, 8, None, None, None, None, None)], start),
        job_end=spark.createDataFrame([("a", 1, 9, "JobSucceeded"), ("a", 1, None, "x"), ("a", 1, 7, "y"), ("a", 4, 9, "z")], "app_id string, job_id long, t long, result string"),
        stage_submitted=spark.createDataFrame([("a", 1, 0, 6), ("a", 3, 0, 9), ("a", 1, 1, 10)], "app_id string, stage_id long, stage_attempt int, t long"))
    cols = ["app_id", "job_id", "submission_ms", "completion_ms", "stage_ids"]
    was = entities.pair_jobs(lc).where("has_start").select(*cols)
    assert sorted(map(str, entities.pair_job_plans(lc).collect())) == sorted(map(str, was.collect()))
    moved = active_planners(lc)._jdf.queryExecution().executedPlan().toString()
    assert not any("call_site" in line for line in moved.splitlines() if "hashpartitioning" in line or "min_by" in line)
