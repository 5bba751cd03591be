"""Packing documents into fixed-length sequences as a cutting-stock problem, by column generation.

1. One pass tokenizes every text (ids by a public tokenizer, then the end id) and cuts it: full pieces of
   ``capacity`` ids and one rest. Each piece carries its CRC. A full piece is a sequence of its own.
2. The rests' lengths, rounded up to ``grain``, give a histogram of at most ``capacity / grain`` rows. That
   bounded table is all that reaches the driver.
3. Column generation: a linear program over patterns (how many rests of each length share a sequence). Its
   duals price new patterns by an unbounded knapsack (dynamic programming over the capacity) until the program's
   value is within ``gap`` of a lower bound (Farley's, or the sequences that the lengths fill at best). The patterns' use is rounded down, and what is left
   is packed greedily, largest first.
4. Rests are ranked within their length by bucketed prefix sums (a hot length is spread over buckets). The
   patterns own consecutive ranks, so a rest's sequence and slot follow from its rank by a join with the
   pattern table; offsets are sums within a sequence (at most ``capacity`` rows).

Edge cases: null and empty texts are one end id; very long texts become many full pieces; repeated rows and
repeated ids are documents of their own; null ids keep their rows; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import prefix_sums, written

CAPACITY = 4096
END_ID = 2
GRAIN = 16
SEED = 3

#: Letters and numbers below U+0250 (fixed by Unicode), where the tokenizer's rules need no tables.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
# no two branches but the last two begin alike, so the most frequent one stands first
SPLIT = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^\\s{LETTERS}{NUMBERS}]+")
SPLIT_ASCII = re.compile("[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\\sa-z0-9]+")  # of a small-letter text
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


class WordTokenizer:
    """Ids equal to the tokenizer's own, with each distinct word encoded once.

    Its rules (lower case, split into words, byte pairs within a word) never look beyond a word, so a text of
    plain characters is split here and its words are looked up. Other texts, and those with the strings of
    special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str, words: int = 500_000):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.words = words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)  # a word that is looked up gets the next number
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _learn(self, done: int) -> None:
        fresh = [*islice(reversed(self.known), len(self.known) - done)][::-1]  # the words added last
        coded = self.full.encode(" ".join(fresh), add_special_tokens=False)  # a blank parts words and has no id
        sizes, ids = np.bincount(np.asarray(coded.word_ids, np.int64), minlength=len(fresh)), coded.ids
        if len(sizes) != len(fresh):  # the tokenizer saw other words than we did: each is encoded alone
            alone = self.full.encode_batch(fresh, add_special_tokens=False)
            sizes, ids = np.array([len(c.ids) for c in alone], np.int64), [i for c in alone for i in c.ids]
        n = len(self.known)
        if n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(n, np.int64)])
            self.size = np.concatenate([self.size, np.zeros(n, np.int64)])
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + total, np.uint32)])
        self.size[done:n] = sizes
        self.start[done:n] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.flat[self.used : self.used + total] = ids
        self.used += total

    def ids(self, text: str) -> np.ndarray:
        low = text.lower()  # some capital letters have their small one far away: Ə, Ɓ, Ⱥ
        ascii_only = text.isascii()
        if not (PLAIN.fullmatch(text) and (ascii_only or PLAIN.fullmatch(low))) or any(s in text for s in self.special):
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.known) > self.words:
            self._clear()
        known, done = self.known, len(self.known)
        words = (SPLIT_ASCII if ascii_only else SPLIT).findall(low)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > done:
            self._learn(done)
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[codes] - (ends - sizes), sizes)
        return self.flat[at]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def own_tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer: tasks that a Python worker runs one after the other share the words it knows."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "doc_tokens long, pieces array<struct<start:long,length:long,crc:long>>"


def cut(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """Struct ``PIECES`` of a text column."""

    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = own_tokenizer(path)
        for texts in batches:
            rows = []
            for t in texts:
                ids = np.append(tokenizer.ids(t) if t else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                cuts = range(0, len(ids), capacity)
                rows.append((len(ids), [{"start": a, "length": min(capacity, len(ids) - a), "crc": zlib.crc32(ids[a : a + capacity].tobytes())} for a in cuts]))
            yield pd.DataFrame(rows, columns=["doc_tokens", "pieces"])

    return pieces(text)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern that fits, by dynamic programming over the capacity."""
    useful = np.flatnonzero(values > 1e-12)
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    s, v = sizes[useful], values[useful]
    order = np.argsort(s, kind="stable")
    s, v, useful = s[order], v[order], useful[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = fits[c]
        if n:
            total = v[:n] + best[c - s[:n]]
            k = int(np.argmax(total))
            if total[k] > best[c] + 1e-12:
                best[c], took[c] = total[k], k
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[useful[took[c]]] += 1
            c -= s[took[c]]
    return float(best[capacity]), pattern


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.001, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Cutting stock: ``[(items of each size, times used)]`` that cover the demand exactly.

    Revised simplex on min sum(x), A x >= demand, from the patterns of one size each. ``rounds`` only ends the
    search for better patterns; any basis on the way is a full plan.
    """
    m = len(sizes)
    if not m:
        return []
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    cost, volume = np.ones(m), float(sizes @ demand) / capacity
    inverse = np.diag(1.0 / np.array([c.max() for c in columns]))
    x = inverse @ demand
    for turn in range(rounds):
        y = cost @ inverse
        worst = int(np.argmin(y))
        if y[worst] < -1e-9:  # a surplus column: more than the demand may be covered
            column, price = -np.eye(m, dtype=np.int64)[worst], 0.0
        else:
            value, column = best_pattern(y, sizes, capacity)
            price = 1.0
            bound = max(volume, float(y @ demand) / max(value, 1.0))
            if value <= 1 + 1e-9 or bound >= float(cost @ x) * (1 - gap):
                break
        d = inverse @ column
        up = d > 1e-10
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1.0), np.inf)
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        columns[r], cost[r] = column, price
        if turn % 200 == 199:  # keeps rounding errors small
            inverse = np.linalg.inv(np.array(columns, float).T)
            x = np.maximum(inverse @ demand, 0)
    left = demand.astype(np.int64).copy()
    plan = []
    for column, k in sorted(zip(columns, np.floor(x + 1e-9).astype(np.int64), strict=True), key=lambda p: -p[1]):
        if column.min() < 0 or not k:
            continue
        has = column > 0
        k = min(int(k), int((left[has] // column[has]).min()))
        if k > 0:
            plan.append((column, k))
            left -= column * k
    return plan + _greedy(sizes, left, capacity)


def _greedy(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The rest, largest first; equal sequences are taken together."""
    left, out = left.copy(), []
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in order:
            n = min(int(left[i]), room // int(sizes[i]))
            pattern[i], room = n, room - n * int(sizes[i])
            if not room:
                break
        has = pattern > 0
        k = int((left[has] // pattern[has]).min())
        out.append((pattern, k))
        left -= pattern * k
    return out


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    grain: int = GRAIN,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    row = F.xxhash64(F.lit(SEED), F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    coded = docs.select(F.col(id_col).alias("id"), row.alias("row"), cut(F.col(text_col), path, capacity, end_id).alias("c"))
    pieces = coded.select("id", "row", "c.doc_tokens", F.explode("c.pieces").alias("p")).select("id", "row", "doc_tokens", "p.start", "p.length", "p.crc")
    # lengths in grains, a full piece is a sequence of its own
    pieces = written(pieces.withColumn("bin", F.ceil(F.col("length") / F.lit(grain)).cast("int")), "pieces")
    room = capacity // grain
    counts = {r["bin"]: r["n"] for r in pieces.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # capacity / grain rows at most
    plan, first = [], counts.get(room, 0)
    if first:
        plan.append((room, 0, first, 1, 0))
    sizes = np.array(sorted(b for b in counts if b < room), np.int64)
    used = dict.fromkeys(sizes.tolist(), 0)
    for column, k in patterns(sizes, np.array([counts[b] for b in sizes.tolist()], float), room):
        for i in np.flatnonzero(column):
            b, each = int(sizes[i]), int(column[i])
            plan.append((b, used[b], used[b] + each * k, each, first))
            used[b] += each * k
        first += k
    slots = spark.createDataFrame(plan, "bin int, low long, high long, each long, first long") if plan else spark.createDataFrame([], "bin int, low long, high long, each long, first long")
    ranked = prefix_sums(pieces, ["bin"], [F.col("row"), F.col("id"), F.col("start")], F.xxhash64("row", "start"), F.lit(1).cast("long"), "rank")
    # the plan's size is bounded by the histogram's, whatever the number of documents
    placed = ranked.join(F.broadcast(slots), "bin").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("each")).cast("long"))
    return placed.select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", _offset().alias("offset")
    )


def _offset() -> Column:


    inside = Window.partitionBy("sequence_id").orderBy(F.col("bin").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")
