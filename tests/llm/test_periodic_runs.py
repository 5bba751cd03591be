import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import documents
from tracefold.llm.periodic_runs import collapsed, common, lyndon_groups, periodic_runs, run_table, runs_of


def plain_runs(x, least=24, times=3):
    """All runs by comparing the text with itself at every distance."""
    out, n = {}, len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i:
                size = j + q - i
                if size >= max(least, times * q) and (i, size) not in out:  # a smaller period of the same stretch came first
                    out[i, size] = q
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = digest("".join(f"{s},{m},{q}\n" for s, m, q in runs))
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], listed, digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def got(df):
    return sorted(((r[0], tuple(r)[1:]) for r in df.collect()), key=repr)


@given(st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=300, deadline=None)
def test_lyndon_array(s):
    length, group = lyndon_groups(s)
    for i in range(len(s)):
        end = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))  # the next smaller suffix
        assert length[i] == end - i
        for j in range(i):
            assert (group[i] == group[j]) == (s[i:end] == s[j : j + length[j]])


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)), max_size=8), st.sampled_from([(6, 3), (9, 3), (24, 3), (12, 4)]))
@settings(max_examples=400, deadline=None)
def test_runs(parts, limits):
    x = [c for root, times, more in parts for c in (root * (times + 1))[: len(root) * times + more]]
    want = sorted(plain_runs(x, *limits), key=lambda r: (r[0], r[2]))
    assert runs_of(np.array(x, np.int64), *limits) == want


def test_common_extension():
    x = np.array([1, 2] * 50 + [3])
    assert common(x, 0, 2) == 98 and common(x, 0, 1) == 0 and common(x, 100, 101) == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = got(periodic_runs(docs, loops=True))
    assert rows == sorted(((r.doc_id, plain_row(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert sum(r[1][0] > 0 for r in rows) > 10


def test_long_text_and_texts_out(spark):
    loop = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(loop * 50 + ["end"]), "a"), (2, "go " * 100_000, "a"), (3, "a b " * 12, "a"), (4, None, "a"), (5, "x y z " * 7 + "x", "a")]
    docs = documents(spark, rows)
    assert sorted(tuple(r) for r in run_table(docs).collect()) == [(1, 0, 20_000, 400), (2, 0, 100_000, 1), (3, 0, 24, 2)]
    texts = {r.doc_id: r.text for r in collapsed(docs).collect()}
    assert texts == {1: " ".join([*loop, "end"]), 2: "go", 3: "a b", 4: None, 5: rows[4][1].strip()}


def test_awkward_rows(spark, awkward, empty):
    want = sorted(((r.doc_id, plain_row(r.doc_id, r.text)) for r in awkward.where("doc_id IS NULL OR doc_id != 8").collect()), key=repr)
    rows = got(periodic_runs(awkward, loops=True))
    assert [r for r in rows if r[0] != 8] == want
    assert [r[1][:5] for r in rows if r[0] == 8] == [(1, 0, 60_000, 1, 60_000_000)]
    assert periodic_runs(empty, loops=True).collect() == []
