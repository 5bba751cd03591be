import re
import zlib
from collections import Counter

from tests.llm.conftest import documents
from tracefold.llm.spelling import differ_by_one, frontier, long_pairs, near_words, variant_groups


def plain(rows, ratio=5):
    """Brute force over (doc_id, text): all words against all one-edit strings."""
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [] for w in words}
    letters = sorted({c for w in words for c in w})
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [v for v in edits if v != w and v in words]
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(variant_groups(docs)) == want
    assert any(v[0] for v in want.values()) and any(v[3] > 1 for v in want.values())


def test_chains_edits_and_long_words(spark):
    base = "abcdefghij"
    stretch = "lmnopq" * 30
    counts = {
        base: 700, base[1:]: 130, base[:-1]: 130, "x" + base[1:]: 25, "xy" + base[2:]: 5, base[:4] + "e" + base[4:]: 9, base + "k": 5, "aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200,
        "ééééééß": 6, "éééééé÷": 40, stretch: 60, stretch[:77] + stretch[78:]: 7, stretch[:90] + "z" + stretch[91:]: 11, "b" * 64: 5, "b" * 65: 50, "b" * 66: 300, stretch + "a": 5,
    }
    rows = [(1000 + k, " ".join(w for w, n in counts.items() if n > k), "a") for k in range(700)]
    want = plain([r[:2] for r in rows])
    assert want["xy" + base[2:]][1] == base and want["b" * 64][1] == "b" * 66
    assert got(variant_groups(documents(spark, rows))) == want


def test_both_ways_agree(spark):
    """The long words' way on all words, and the trie with any border, give the same pairs."""
    words = spark.createDataFrame([(w, n) for n, w in enumerate(sorted({a + b + c for a in ("", "a", "ab", "b") for b in ("foobar", "fobar", "baar") for c in ("", "x", "xx", "yx")}))], "word string, n long")
    one = {tuple(r) for r in frontier(words).collect()}
    assert one == {tuple(r) for r in long_pairs(words).collect()} == {tuple(r) for r in near_words(words, 8).collect()}
    every = [r.word for r in words.collect()]
    assert {(a, b) for a in every for b in every if differ_by_one(a, b)} == {r[:2] for r in one}


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(variant_groups(awkward)) == plain(rows)
    assert variant_groups(empty).collect() == []
