import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm.mixing import SCHEDULES, integral, mix, mix_report, mixed_documents, time_of


def plain_targets(sizes):
    """sizes: {source: words}; excess is handed on round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, got = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not full:
            return got | {s: level * weight[s] for s in open_}
        for s in full:
            got[s] = 2 * sizes[s]
            left -= got[s]
        open_ -= full
    return got


def test_against_plain_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    total, taken = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
    want = plain_targets(total)
    rows = mix_report(docs).collect()
    assert len(rows) == len(size)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(rows) == sorted(mix_report(docs.repartition(7)).collect())
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


@pytest.mark.parametrize("schedule", [*SCHEDULES, ((0.0, 0.0), (0.5, 2.0), (0.5001, 0.0), (1.0, 3.0))])
def test_inverse_of_the_integral(spark, schedule):
    shares = np.linspace(0, 1, 41)
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in shares], "x double").select(time_of(F.col("x"), schedule)).collect()]
    t, rate = np.array(schedule).T
    fine = np.linspace(0, 1, 200_001)
    area = np.concatenate([[0], np.cumsum((np.interp(fine[1:], t, rate) + np.interp(fine[:-1], t, rate)) / 2 * np.diff(fine))])
    back = np.interp(got, fine, area) / integral(schedule)[-1]
    assert np.allclose(back, shares, atol=1e-4)


def test_many_buckets_give_the_same_words(spark, monkeypatch):
    from tracefold.llm import mixing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source")))
    one = {r.id: r.taken for r in mix(docs).collect()}
    split = lambda *a, f=mixing.prefix_sums, **k: f(*a, **k, rows_per_bucket=3)
    monkeypatch.setattr(mixing, "prefix_sums", split)
    assert {r.id: r.taken for r in mix(docs).collect()} == one


def test_awkward_rows(awkward, empty):
    rows = mix_report(awkward).collect()
    assert len(rows) == awkward.count()
    assert sum(r.taken for r in rows if r.size == 0) == 0
    out = mixed_documents(awkward)
    assert out.columns == awkward.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in rows)
    assert mix_report(empty).count() == 0 and mixed_documents(empty).count() == 0
