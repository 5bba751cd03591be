import random

import xxhash
from pyspark.sql import functions as F

from tracefold.llm.components import components
from tracefold.llm.simhash import close_pairs, keep_one, near_duplicates, simhash


def plain_simhash(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {id: fp} -> {id: least id}"""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = {r.doc_id: plain_simhash(r.text) for r in docs.collect()}
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


def test_native_hash_is_the_same(spark):
    text = "Grün und blau"
    assert spark.range(1).select(F.xxhash64(F.lit("grün und blau"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("grün und blau".encode(), 42)
    assert simhash(text) == plain_simhash(text)


def test_hot_keys_are_split_without_loss(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:  # all within a few bits: every key is hot
        prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    want = {(a, b) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    for hot in (2000, 10):
        got = close_pairs(spark.createDataFrame(signed, "fp long"), hot_key=hot).collect()
        assert len(got) == len(set(got)) == len(want) // 2
        assert {(r.u % 2**64, r.v % 2**64) for r in got} <= want


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    names = list(range(400))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(250)] + [(names[260], names[k]) for k in range(261, 400)] + [(1, 1)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    chain, star = set(names[:251]), set(names[260:400])
    assert got == {**{n: min(chain) for n in chain}, **{n: min(star) for n in star}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_awkward_rows(awkward, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    of = {r.doc_id: r for r in rows}
    assert of[2].component_id == 1 and of[4].fingerprint == "0" * 16
    assert of[4].component_id == of[3].component_id == of[5].component_id == 3
    assert near_duplicates(empty).count() == 0


def test_keep_one(awkward, empty):
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    components_ = {r.component_id for r in near_duplicates(awkward).collect() if r.component_id is not None}
    assert {r.doc_id for r in rows if r.doc_id is not None} == components_
    assert sum(r.doc_id == 1 for r in rows) == 1
    assert keep_one(empty).count() == 0
