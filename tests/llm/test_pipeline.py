"""Each stage of the pipeline against a plain version, on the small tables."""

import os
import re
import sys
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from test_mixing import plain_targets
from test_packing import verify
from test_pii import plain_spans
from test_simhash import plain_components, plain_simhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from tracefold.llm.common import written  # noqa: E402

SF = "/root/testdata/sf0.01"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    kept = written(P.drop_toxic(spark, docs, SF), "t1")
    first = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == list(P.COLUMNS) and all(first[i] == before[i] for i in first)
    clean = [i for i in before if toxic.get(i) == 0]
    assert sum(i in first for i in clean) >= 0.97 * len(clean) and len(first) < len(before)

    single = written(P.drop_near_duplicates(spark, kept, SF), "t2")
    second = {r.doc_id: r for r in single.collect()}
    groups = plain_components({i: plain_simhash(r.text) for i, r in first.items()})
    assert set(second) == set(groups.values()) and single.count() == len(second)

    masked = written(P.mask_personal_data(spark, single, SF), "t3")
    third = {r.doc_id: r for r in masked.collect()}
    assert set(third) == set(second)
    for i, r in third.items():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(second[i].text):
            assert r.text == second[i].text or "[TERM]" in r.text or words(r.text) < words(second[i].text)
    assert any("[EMAIL]" in r.text for r in third.values())

    mixed = written(P.mix_sources(spark, masked, SF), "t4")
    rows = mixed.collect()
    size, taken, each = defaultdict(int), defaultdict(int), Counter()
    for r in third.values():
        size[r.source] += words(r.text)
    for r in rows:
        taken[r.source] += words(r.text)
        each[r.doc_id] += words(r.text)
        assert third[r.doc_id].text.startswith(r.text)
    assert all(abs(taken[s] - t) <= 1 for s, t in plain_targets(size).items())
    assert all(n <= 2 * words(third[i].text) for i, n in each.items())

    pieces = P.pack_sequences(spark, mixed, SF).collect()
    room, used = verify(pieces, [(r.doc_id, r.text) for r in rows])
    assert used / room > 0.98
    assert public_tokenizers.path(P.TOKENIZER)


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("false").write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() == 0


def test_awkward_rows(spark, awkward, tmp_path):
    sf = str(tmp_path)
    awkward.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() > 0


def test_few_texts_pass_at_once(spark, tmp_path, monkeypatch):
    rows = spark.range(3 * P.TEXTS_PER_BATCH + 1, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda spark, docs, sf_dir: docs.coalesce(1).mapInPandas(lambda batches: (b.iloc[:1].assign(n=len(b))[["n"]] for b in batches), "n long")
    monkeypatch.setattr(P, "STAGES", [("sizes", sizes)])
    got = [r.n for r in P.run(spark, str(tmp_path)).collect()]
    assert sum(got) == rows.count() and max(got) <= P.TEXTS_PER_BATCH
    assert spark.conf.get(key) == before
