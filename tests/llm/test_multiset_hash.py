import hashlib
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tracefold.llm import multiset_hash as M


def plain_edits(rows):
    """rows: (id, text) -> {id: edited text}"""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        out[i] = t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]
    return out


def test_against_plain_edits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_edits(texts.items())
    rows = M.fingerprint_report(docs).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(by_text.values())) > 0.99 * len(by_text)
    assert statistics.median(r.near_edited for r in rows) > 0.35 > 0.2 > statistics.median(r.near_next for r in rows)


def plain_hash(spark, parts):
    """Sums component by component, with hashes taken one at a time."""
    total = [0] * (2 * M.LONGS)
    for p in parts:
        hs = spark.range(1).select(*[F.xxhash64(F.lit(p), F.lit(s)) for s in range(M.HASHES)]).first()
        for s, h in enumerate(hs):
            for j in range(32):
                for k in range(2):
                    total[(32 * s + j) * 2 + k] += 1 if (h >> (j + 32 * k)) & 1 else -1
    return [x % 2**M.BITS for x in total]


def test_sums_modulo(spark):
    parts = ["one", "two", "two", "drei.", "x" * 500]
    got = spark.range(1).select(M.multiset_hash(F.array(*map(F.lit, parts)))).first()[0]
    assert [(x >> (32 * k)) & 0xFFFFFFFF for x in got for k in range(2)] == plain_hash(spark, parts)


def test_order_insertion_and_deletion(spark):
    df = spark.createDataFrame([(["a", "b", "c", "b"], ["b", "c", "b", "a"], ["a", "b"], ["c", "b"])], "p array<string>, q array<string>, r array<string>, s array<string>")
    h = {c: M.multiset_hash(F.col(c)) for c in "pqrs"}
    row = df.select(h["p"] == h["q"], M.combine(h["r"], h["s"]) == h["p"], M.without(h["p"], h["s"]) == h["r"], M.likeness(h["p"], h["q"]), M.likeness(h["r"], M.zero())).first()
    assert list(row) == [True, True, True, 1.0, 0.0]


def test_likeness_follows_the_overlap(spark):
    base = [f"sentence {k}" for k in range(60)]
    for share in (0, 20, 40, 60):
        other = base[:share] + [f"other {k}" for k in range(60 - share)]
        got = spark.createDataFrame([(base, other)], "a array<string>, b array<string>").select(M.likeness(M.multiset_hash(F.col("a")), M.multiset_hash(F.col("b")))).first()[0]
        assert got == pytest.approx(share / 60, abs=0.25)


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", M.fingerprint_report(docs)._jdf.queryExecution().executedPlan().toString())


def test_many_ranges_close_their_gaps(spark):
    ids = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "idk long, body long")
    got = {r.idk: r.nidk for r in M.followers(ids, rows_per_part=9).collect()}
    assert got == {k: (k - 1) % 101 for k in range(101)}


def test_awkward_rows(awkward, empty, spark):
    rows = M.fingerprint_report(awkward).collect()
    assert len(rows) == awkward.count()
    of = {r.doc_id: r for r in rows}
    assert of[4].n_chars == 0 and of[4].fingerprint == "0" * 16 * M.LONGS and of[4].near_edited == 1.0
    assert of[1].fingerprint == of[2].fingerprint and of[2].near_next == 1.0
    assert M.fingerprint_report(empty).count() == 0
    one = M.fingerprint_report(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_sums_over_rows_are_the_same(spark):
    rows = spark.createDataFrame([(1, [f"p{k % 70}" for k in range(300)]), (2, []), (3, ["one"])], "k long, parts array<string>")
    want = {r.k: r.h for r in rows.select("k", M.multiset_hash(F.col("parts")).alias("h")).collect()}
    assert {r.k: r.fp for r in M.summed_hashes(rows, ["k"], "parts").collect()} == want


def test_many_equal_paragraphs(spark):
    """Sums beyond 2**14: 20,000 equal lines against 10,000, and 16,384 against none."""
    docs = spark.createDataFrame([(3, "same line\n" * 20_000), (2, "same line\n" * 10_000), (1, "same line\n" * 16_384), (0, "")], "doc_id long, text string")
    of = {r.doc_id: r for r in M.fingerprint_report(docs).collect()}
    assert of[3].near_next == pytest.approx(2 * 2 * 1 / (4 + 1))
    assert of[2].near_next == pytest.approx(2 * 10_000 * 16_384 / (10_000**2 + 16_384**2))
    assert of[1].near_next == 0.0 and of[1].fingerprint != of[0].fingerprint
    assert of[1].near_edited == pytest.approx(2 * 16_384 * 8_192 / (16_384**2 + 8_192**2))


def test_likeness_is_that_of_the_fingerprints_and_copies_stay_single(spark):
    """Equal neighbours are alike, whatever their number; copies of both texts give one row a copy."""
    docs = [(7, "a. b. c.")] * 30 + [(6, "a. b. c.")] * 20 + [(5, "x\n" * 16_385), (4, "x"), (3, "x")]
    rows = M.fingerprint_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    of = {r.doc_id: r for r in rows}
    assert of[7].fingerprint == of[6].fingerprint and of[7].near_next == of[4].near_next == 1.0
    assert of[5].fingerprint != of[4].fingerprint and of[5].near_next == pytest.approx(2 * 16_385 / (16_385**2 + 1))
