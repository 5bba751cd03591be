"""Spelling variants: neighbours at one edit from a relational trie, walked level by level.

1. ``word_counts``: words and their counts in one pass over whole texts, pre-aggregated in the tasks.
2. Two tries as edge tables, one over the words and one over the reversed words: a row per distinct prefix
   (``node``, letter, ``child``), with a mask of the letters that follow the child and the word that ends there.
   A node is a 64-bit hash chained over the prefix's letters.
3. The frontier holds states (word, position, node, edits). An edit in the right half of a word leaves its left
   half as it is, and an edit in the left half leaves the right half, which is the left half of the reversed word.
   So the states without an edit are a word's own prefixes from its middle on, in either trie. They join the edge
   table once to take an edit: another letter, an inserted letter, or a deleted one. The states with their edit
   join it level by level, one letter of the word at a time, until the word ends at a node where a word ends.
   A state leaves the frontier as soon as the mask lacks the word's next letter.
4. Hits are checked exactly, so equal hashes of different prefixes cost time but no rows.

The own path is never searched for, and a state meets at most one edge per letter of the alphabet, so the work
is words times letters; no two words are ever paired but through a path both have. Words of more than
``DEEP`` letters, which would need as many levels, meet by hashed one-deletion keys instead (``long_pairs``):
exact as well, linear in their letters. The frontier is written to the shared folder after every ``LEVELS`` levels.

Edge cases: a null text has no words; a null id counts as the text '' in the checksum; repeated rows count
once each; texts without words, and an empty table, give an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import written

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
SLIP = 199
DEEP = 64
LEVELS = 4
FLUSH = 200_000

#: Latin-1 bytes: A-Z to lower case, letters as they are, anything else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case, as Latin-1 (a letter is a byte)."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def slipped(doc_id: str, run: bytes, every: int = SLIP) -> bytes:
    """The run, or for one in ``every`` by checksum the run less one letter."""
    h = zlib.crc32(f"{doc_id}:{run.decode('latin-1')}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words with at least ``min_letters`` letters and ``min_count`` occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for rows in batches:
            for doc_id, text in zip(rows["id"], rows["text"], strict=True):
                for run, n in Counter(runs(text)).items():
                    if len(run) >= min_letters:
                        word = slipped(doc_id, run)
                        if len(word) >= min_letters:
                            total[word] += n
                if len(total) >= FLUSH:
                    yield _counted(total)
                    total = Counter()
        if total:
            yield _counted(total)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = rows.mapInPandas(count, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counted(total: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": np.fromiter(total.values(), np.int64, len(total))})


def _bit(letter: Column) -> Column:
    """One of 62 bits for a letter; two letters may share one, which only lets a state live longer."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letter), F.lit(62)).cast("int"))


def _steps(words: DataFrame) -> DataFrame:
    """Each word in both tries: ``d`` (0: as it is, 1: reversed), its letters ``s`` and ``nodes``, its prefixes' hashes.

    ``nodes[i]`` is the node of the first i letters; ``half`` is the length of the prefix that has no edit.
    """
    two = words.select("word", "n", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("word").alias("s")), F.struct(F.lit(1).alias("d"), F.reverse("word").alias("s")))).alias("x"))
    two = two.select("word", "n", "x.d", "x.s", F.length("word").alias("size"))
    letters = F.split("s", "").alias("letters")
    root = F.array(F.xxhash64(F.lit("root"), F.col("d")))
    chain = F.aggregate(F.filter("letters", lambda c: c != ""), root, lambda acc, c: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), c))))
    half = F.when(F.col("d") == 0, F.floor(F.col("size") / 2)).otherwise(F.col("size") - F.floor(F.col("size") / 2)).cast("int")
    return two.select("word", "n", "d", "s", "size", letters).select("word", "n", "s", "size", chain.alias("nodes"), half.alias("half"))


def _letter(at: Column | str) -> Column:
    """The letter of ``s`` at position ``at``, from 0."""
    return F.substring("s", F.col(at) + 1 if isinstance(at, str) else at + 1, F.lit(1))


def trie(steps: DataFrame) -> DataFrame:
    """Edge table: ``node, letter, child``, ``mask`` of the letters after the child, and ``ends(word, n)`` or null."""
    at = F.posexplode(F.slice("nodes", 2, F.lit(1 << 20))).alias("at", "child")
    rows = steps.select("word", "n", "s", "size", "nodes", at)
    rows = rows.select(
        F.element_at("nodes", F.col("at") + 1).alias("node"), _letter("at").alias("letter"), "child",
        F.when(F.col("at") + 1 == F.col("size"), F.struct("word", "n")).alias("ends"),
    )
    edges = rows.groupBy("child").agg(F.first("node").alias("node"), F.first("letter").alias("letter"), F.max("ends").alias("ends"))
    below = edges.groupBy(F.col("node").alias("child")).agg(F.bit_or(_bit(F.col("letter"))).alias("mask"))
    return edges.join(below, "child", "left").select("node", "letter", "child", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), "ends")


def _alive() -> Column:
    """At a node with ``mask`` and ``ends``: the word ends where another one does, or its next letter follows."""
    done = F.col("pos") == F.col("size")
    return (done & F.col("ends").isNotNull()) | (~done & (_bit(_letter("pos")).bitwiseAND(F.col("mask")) != 0))


STATE = ("word", "s", "size", "pos", "node")


def _landed(states: DataFrame) -> DataFrame:
    """States at their node: those that are over carry the word they met."""
    return states.where(_alive()).select(*STATE, F.when(F.col("pos") == F.col("size"), F.col("ends")).alias("met"))


def frontier(words: DataFrame) -> DataFrame:
    """Pairs ``(word, near, n)`` of words at one edit; ``words(word, n)`` has at most ``DEEP`` letters a word."""
    steps = written(_steps(words), "steps")
    edges = written(trie(steps), "trie")
    own = steps.select("word", "s", "size", F.posexplode("nodes").alias("pos", "node"), "half").where("pos >= half").drop("half")
    here = _letter("pos")
    # another letter at a branch: instead of the word's own letter, or before it
    branch = own.join(edges, "node").where((F.col("pos") == F.col("size")) | (here != F.col("letter")))
    moves = F.explode(F.when(F.col("pos") < F.col("size"), F.array(F.col("pos"), F.col("pos") + 1)).otherwise(F.array("pos")))
    taken = branch.select("word", "s", "size", F.col("child").alias("node"), "mask", "ends", moves.alias("pos"))
    # a letter left out: of equal letters in a row the last one; the state goes on from the node before it
    last = (F.col("pos") + 1 == F.col("size")) | (here != _letter(F.col("pos") + 1))
    left = own.where((F.col("pos") < F.col("size")) & last).withColumn("pos", F.col("pos") + 1)
    left = left.join(edges.select(F.col("child").alias("node"), "mask", "ends"), "node")
    now = _landed(taken.select(*STATE, "mask", "ends").unionByName(left.select(*STATE, "mask", "ends")))
    nodes = edges.select(F.col("child").alias("at"), "mask", "ends")
    over, found = F.col("met").isNotNull(), []
    while True:
        now = written(now, "frontier")
        found.append(now.where(over).select("word", "met"))
        now = now.where(~over)
        if now.isEmpty():
            break
        for _ in range(LEVELS):
            # states that are over ask for a node that is none, and stay
            at = F.when(over, F.xxhash64("word", "node", F.lit("over"))).otherwise(F.xxhash64("node", _letter("pos")))
            ahead = now.select("word", "s", "size", F.when(over, F.col("pos")).otherwise(F.col("pos") + 1).alias("pos"), at.alias("at"), "met")
            step = ahead.join(nodes, "at", "left").where(over | (F.col("mask").isNotNull() & _alive()))
            met = F.when(over, F.col("met")).when(F.col("pos") == F.col("size"), F.col("ends"))
            now = step.select("word", "s", "size", "pos", F.col("at").alias("node"), met.alias("met"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.select("word", F.col("met.word").alias("near"), F.col("met.n").alias("n"))
    return hits.where(F.levenshtein("word", "near") == 1).distinct()


def long_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``(word, near, n)`` of long words at one edit: equal after one deletion in either or in one of them."""
    odd = np.uint64(0x9E3779B97F4A7C15)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for word in rows["word"]:
                a = np.frombuffer(word.encode("utf-16-le"), np.uint16).astype(np.uint64) + np.uint64(1)
                power = np.cumprod(np.full(len(a), odd, np.uint64))
                before = np.concatenate([[np.uint64(0)], np.cumsum(a * power)])
                after = np.concatenate([np.cumsum((a[1:] * power[:-1])[::-1])[::-1], [np.uint64(0)]])
                less = before[:-1] + after  # the hash of the word without its i-th letter
                kept = np.flatnonzero(np.append(a[1:] != a[:-1], True))  # of equal letters in a row the last
                every = np.arange(len(a))
                yield pd.DataFrame({
                    "word": word,
                    "at": np.concatenate([[-2], np.full(len(kept), -1), every]),
                    "key": np.concatenate([before[-1:], less[kept], less]).view(np.int64),
                    "left": np.concatenate([[len(a)], np.full(len(kept) + len(a), len(a) - 1)]),
                })

    @F.pandas_udf("boolean")
    def one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([differ_by_one(x, y) for x, y in zip(a, b, strict=True)])

    listed = words.select("word", "n", F.xxhash64("word").alias("id"), F.length("word").alias("size"))
    keyed = words.select("word").mapInPandas(keys, "word string, at long, key long, left long").withColumn("id", F.xxhash64("word")).drop("word")
    keyed = written(keyed, "deletions")
    same = ["at", "key", "left"]
    other = keyed.where("at >= 0")
    swapped = other.select(*same, F.col("id").alias("u")).join(other.select(*same, F.col("id").alias("v")), same).where("u != v").select("u", "v")
    cut = keyed.where("at = -1").select("key", "left", F.col("id").alias("u")).join(keyed.where("at = -2").select("key", "left", F.col("id").alias("v")), ["key", "left"]).select("u", "v")
    pairs = swapped.unionByName(cut).unionByName(cut.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    full = pairs.join(listed.select(F.col("id").alias("u"), "word"), "u").join(listed.select(F.col("id").alias("v"), F.col("word").alias("near"), "n"), "v")
    return full.where(one_edit("word", "near")).select("word", "near", "n")


def differ_by_one(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # length of the common prefix by halves: slices compare fast
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


def near_words(words: DataFrame, deep: int = DEEP) -> DataFrame:
    """Pairs ``(word, near, n)``, both ways, ``n`` of the near word. At ``deep`` letters both ways overlap."""
    size = F.length("word")
    return frontier(words.where(size <= deep)).unionByName(long_pairs(words.where(size >= deep))).distinct()


def variant_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, deep: int = DEEP
) -> DataFrame:
    """One row per word: ``word, form, root`` and ``n, n_near, form_n``.

    The form is the commonest near word, if it is at least ``ratio`` times as common; the root is the end of the
    chain of forms. Counts grow along a chain, so it ends; each round doubles the part that is followed.
    """
    words = written(word_counts(docs, id_col, text_col, min_letters, min_count), "words")
    best = near_words(words, deep).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("best"))
    rows = words.join(best, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select(
        "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    rows = written(rows, "forms")
    return rows.join(_roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(rows: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form."""
    now = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = written(now.join(jump, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now
