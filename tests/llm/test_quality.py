import re
from collections import Counter

import numpy as np
import pytest

from tracefold.llm.quality_rules import Bands, measure, quality_rules, repeated_windows


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = set()
    for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if grams[g] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_against_plain_counts(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dups, repeats = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed)


def test_keeps_good_documents(spark, sf001):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    lost = quality_rules(docs).where("NOT kept AND NOT base_failed").join(good, "doc_id").count()
    assert lost == 0


def test_repetitive_and_incompressible_text_is_rejected():
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    rng = np.random.default_rng(1)
    noise = " ".join("".join(map(chr, rng.integers(33, 127, 12))) for _ in range(800))
    loop = " ".join(rng.permutation(words)[:30].tolist() + [""]) * 3 + " ".join(map(str, range(60)))
    prose = " ".join(rng.choice(words, 1500).tolist())
    assert not measure(noise, Bands(), packer)[-1]
    assert not measure(" ".join(["same line of words here"] * 400), Bands(), packer)[-1]
    assert measure(prose, Bands(), packer)[-1]
    assert measure(loop, Bands(), packer)[4] > 0


@pytest.mark.parametrize("text, n", [("a b c", 0), ("a b c a b c", 6), ("a a a a", 4), ("a b c d a b c", 6), ("", 0)])
def test_repeated_windows(text, n):
    assert repeated_windows(text.encode().split()) == n


def test_awkward_rows(awkward, empty):
    rows = quality_rules(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words == 0)
    assert next(r for r in rows if r.doc_id == 8).n_words == 60_000
    assert quality_rules(empty).count() == 0


def prose(rng, size):
    parts = [a + b for a in ("b", "d", "f", "gr", "kl", "l", "m", "st") for b in ("a", "en", "i", "or", "u", "ing")]
    words = ["".join(rng.choice(parts, n)) for n in rng.integers(1, 4, 3000)]
    odds = np.arange(1, 3001) ** -0.6
    return " ".join(rng.choice(words, size, p=odds / odds.sum()).tolist())[:size]


def coded(rng, size, width=76):
    """base64 in lines or words of ``width``."""
    import base64

    code = base64.b64encode(rng.bytes(size)).decode()[:size]
    return " ".join(code[k:k + width] for k in range(0, size, width))


def test_coded_and_looped_parts_inside_prose():
    import zstandard

    packer, rng = zstandard.ZstdCompressor(level=3), np.random.default_rng(3)
    long_text = prose(rng, 20_000)
    assert measure(long_text, Bands(), packer)[-1]
    with_code = long_text[:9000] + " " + coded(rng, 6_200) + " " + long_text[9000:]
    row = measure(with_code, Bands(), packer)
    assert not row[9] and row[8] >= 2 and not row[-1]
    mostly = prose(rng, 6_000) + " " + coded(rng, 18_000)
    assert not measure(mostly, Bands(), packer)[-1]
    for size in (700, 1000, 1500, 2000):
        assert not measure(coded(rng, size, 10), Bands(), packer)[-1]
    loop = " ".join(f"{a}{b} same old part of the line here again" for a, b in zip("abc" * 50, "xyzuv" * 30, strict=True))
    row = measure(long_text[:9000] + " " + loop + " " + long_text[9000:], Bands(), packer)
    assert not row[9] and row[7] >= 2 and not row[-1]


def test_limits_come_from_the_texts(spark):
    """Texts that stand apart from their own length class go, though any fixed limit lets them through."""
    rng = np.random.default_rng(4)
    rows = [(k, prose(rng, 3000)) for k in range(260)]
    few = sorted(set(prose(rng, 3000).split()))[:180]
    rows += [(1000 + k, " ".join(rng.choice(few, 600).tolist())[:3000]) for k in range(5)]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k].kept for k in range(260))
    odd = [out[k] for k in range(1000, 1005) if not out[k].base_failed]
    assert odd and not any(r.kept for r in odd)
    fixed = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), bands=Bands()).where("doc_id >= 1000 AND NOT base_failed")
    assert fixed.where("kept").count() == len(odd)


def test_beyond_the_base_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    gone = quality_rules(docs).where("NOT kept AND NOT base_failed").join(labels, "doc_id", "left")
    assert gone.where("quality = 1").count() == 0
    assert gone.where("quality = 0").count() > 50


def test_one_ratio_more_or_less_hardly_moves_a_limit():
    from tracefold.llm.quality_rules import Bands, fences, length_class

    last = None
    for n in (0, 1, 50, 199, 200, 201, 5_000, 1_000_000):
        fitted = {length_class(3000): f} if (f := fences([(500, n)] if n else [], Bands())) else {}
        low, high = Bands(fitted=fitted).band(3000)
        assert 0.32 <= low <= 0.4505 and 0.55 <= high <= 0.68
        if n in (200, 201):
            assert abs(low - last[0]) < 0.001 and abs(high - last[1]) < 0.001
        assert last is None or (low >= last[0] and high <= last[1])
        last = low, high
    assert low > 0.45 and high < 0.551
