import re

from tracefold.llm.licenses import PHRASES, license_scan


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = license_scan(docs).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_templates_with_changed_words(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    put_in = bsd.replace("source and", "source code and")
    left_out = bsd.replace("with or ", "")
    half = " ".join(bsd.split()[:8])
    far = " ".join(f"{w} filler" if k % 3 == 2 else w for k, w in enumerate(bsd.split()))
    texts = [f"some words {bsd}", put_in, left_out, half, far, "MIT license, mit License; mit\nlicense CC-BY cc by", "cc", "", None]
    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels = {r.doc_id: r.labels for r in rows}
    assert [labels[k] for k in range(5)] == ["bsd", "bsd", "bsd", "", ""]
    of = {r.doc_id: r for r in rows}
    assert of[0].score == 1.0 and 0.7 <= of[2].score < 1
    assert (of[5].n_base, of[5].first_word, of[5].last_word, of[5].labels) == (5, 0, 8, "cc-by,mit")
    assert of[8].n_words == 0 and of[8].score == 0.0


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_awkward_rows(awkward, empty):
    rows = license_scan(awkward).collect()
    assert len(rows) == awkward.count()
    assert license_scan(empty).count() == 0


def test_versions_and_variants_are_told_apart(spark):
    gpl = "This work is licensed under the GNU General Public License"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    want = {
        f"{gpl}, version 2": "gpl,gpl-2.0", f"{gpl}, version 3": "gpl,gpl-3.0", f"{gpl}.": "gpl",
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa", "Licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd", "Licensed under CC BY-ND 4.0": "cc-by,cc-by-nd",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0", "Licensed under the Apache License, Version 1.1": "apache",
        cc.format(""): "cc-by", cc.format("-NonCommercial"): "",
    }
    rows = license_scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert {list(want)[r.doc_id]: r.labels for r in rows} == want
