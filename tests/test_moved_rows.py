"""Sweeps and message counts move and decode no more than they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators.sweep import SPLIT, running_sums, with_bucket
from tracefold.sources import messages


def test_only_keys_with_a_border_have_totals(spark):
    """Many small keys and a large one: the small ones lie in one bucket each and need no totals."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 9_999).alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    split = with_bucket(rows, ["k"], "t", 64).where(SPLIT)
    assert split.select("k").distinct().count() <= 100 and split.where("k = -1").count() == 10_000
    got = running_sums(rows, ["k"], "t", {"v": F.col("v"), "odd": (F.col("t") % 2).cast("int")}, next_time="n", total_suffix="_all", buckets=64)
    want = rows.selectExpr("k", "t", "v", "sum(v) OVER (PARTITION BY k ORDER BY t) AS v_run", "sum(t % 2) OVER (PARTITION BY k ORDER BY t) AS odd_run",
                           "count(*) OVER (PARTITION BY k) AS v_all", "sum(t % 2) OVER (PARTITION BY k) AS odd_all", "lead(t) OVER (PARTITION BY k ORDER BY t) AS n")
    got = got.select(want.columns)
    assert got.count() == 20_000 and got.exceptAll(want).count() == 0


def test_counting_types_decodes_one_field(spark):
    records = spark.createDataFrame([('{"msgtype":"sparkJobStart","jobId":1}',), ('{"msgtype":"new"}',), ("{", ), (None,), ('{"msgtype":"sparkJobStart","jobId":"x"}',)], "value string")
    counts = messages.type_counts(messages.parse_messages(records.unionByName(records)))
    assert {(r.kind, r.msgtype, r.n) for r in counts.collect()} == {("known", "sparkJobStart", 4), ("unknown", "new", 2), ("missing", None, 4)}
    assert "jobId" not in counts._jdf.queryExecution().optimizedPlan().toString().split("from_json", 1)[1].split("LogicalRDD")[0].split("Scan")[0]


def test_rows_without_a_time_count_first(spark):
    """They are before all others of their key, whether it has one bucket or several, and are not given back."""
    rows = spark.range(4_000).select(F.when(F.col("id") % 4 > 0, -1).otherwise(F.col("id") % 400).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("t"), F.lit(1).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5, 1), (None, None, 1)], "k long, t long, v int"))
    want = rows.selectExpr("k", "t", "v", "sum(v) OVER (PARTITION BY k ORDER BY t) AS v_run", "count(*) OVER (PARTITION BY k) AS v_all",
                           "lead(t) OVER (PARTITION BY k ORDER BY t) AS n").where("k IS NOT NULL AND t IS NOT NULL")
    for buckets in (4, 64):
        got = running_sums(rows, ["k"], "t", ["v"], next_time="n", total_suffix="_all", buckets=buckets).select(want.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
