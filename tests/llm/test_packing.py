import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracefold.llm.packing import WordTokenizer, own_tokenizer, pack, patterns

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers_own(spark):
    full, fast = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["", "It's 'll we'RE don''t", "½ ² 12ⅷ x\x85y\xa0z", "<|endoftext|> a", "ǅ İ ß ʼn", "á e", "漢字 кот", "\x00\x1c tab\tß", "!!'s ''t '", "ÀÖ×ØöÙ÷"]
    for t in texts:
        assert fast.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids, t[:60]


def verify(rows, docs, capacity=4096):
    full = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, t in docs:
        want[i, tuple(full.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for (i, ids), times in want.items():
        cuts = [(a, min(capacity, len(ids) - a)) for a in range(0, len(ids), capacity)]
        for a, n in cuts:
            crc = zlib.crc32(np.asarray(ids[a : a + n], "<u4").tobytes())
            assert sum((r.start, r.length, r.ids_crc32, r.doc_tokens) == (a, n, crc, len(ids)) for r in by_doc[i]) == times
    assert len(rows) == sum(times * -(-len(ids) // capacity) for (_, ids), times in want.items())
    return len(by_sequence) * capacity, sum(r.length for r in rows)


def test_every_id_lies_in_one_piece(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    room, used = verify(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used / room > 0.985


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(0)
    sizes = np.unique(rng.integers(1, 50, 40))
    demand = rng.integers(1, 400, len(sizes))
    plan = patterns(sizes, demand.astype(float), 128)
    assert (sum(c * k for c, k in plan) == demand).all()
    assert all(c @ sizes <= 128 and c.min() >= 0 for c, _ in plan)
    assert sum(k for _, k in plan) <= -(-int(sizes @ demand) // 128) * 1.005 + 3
    assert patterns(np.zeros(0, np.int64), np.zeros(0), 128) == []


def test_awkward_rows(awkward, empty):
    verify(pack(awkward, PATH).collect(), [(r.doc_id, r.text) for r in awkward.collect()])
    assert pack(empty, PATH).count() == 0


def test_every_plain_letter_has_the_tokenizers_ids():
    ours = WordTokenizer(PATH)
    for code in range(1, 0x250):
        c = chr(code)
        for text in (c, f"a{c}b", f"A{c}", f"{c}B 1", f"'{c}'s", f"it{c}'ll", f"!{c}!", f"{c}{c.lower()} {c.upper()}", f"x {c} y", f"9{c}9"):
            assert ours.ids(text).tolist() == ours.full.encode(text, add_special_tokens=False).ids, (hex(code), text)
    for text in ("Ə! Əli", "aƁb", "İstanbul", "Ⱥ Ɐ K ſ"):
        assert ours.ids(text).tolist() == ours.full.encode(text, add_special_tokens=False).ids


def test_random_strings_of_plain_letters():
    ours, rng = WordTokenizer(PATH), np.random.default_rng(5)
    letters = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(161, 0x250))]
    for _ in range(4000):
        text = "".join(rng.choice(letters, int(rng.integers(1, 12))))
        assert ours.ids(text).tolist() == ours.full.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_learnt_once_in_a_process():
    """Tasks of one worker share a tokenizer, and its ids stay the same when it forgets all words in between."""
    ours, full = own_tokenizer(PATH), Tokenizer.from_file(PATH)
    text = "It's 42 words' worth: we'll SAY they've 'dined, 'tis naïve\tÀ1²"
    want = full.encode(text, add_special_tokens=False).ids
    assert ours.ids(text).tolist() == want and ours.ids("plain it's they'll 7x 'm 're!").tolist() == full.encode("plain it's they'll 7x 'm 're!", add_special_tokens=False).ids
    known = len(ours.known)
    assert own_tokenizer(PATH) is ours and ours.ids(text).tolist() == want and len(ours.known) == known
    ours._clear()
    assert ours.ids(text).tolist() == want
