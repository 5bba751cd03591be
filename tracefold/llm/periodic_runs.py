"""Periodic runs of words: Lyndon roots from suffix grouping under both orders, extended to runs.

1. The words of a text become numbers. A run of ``least`` words or three periods repeats each of its stretches
   of a third of ``least`` words at the distance of its period, so only parts of a text where every such stretch occurs twice,
   near enough for three periods, can hold one (``suspects``); hashes that collide only make the parts larger.
2. In each part, phase one of the suffix sorter by Baier groups the suffixes by their longest Lyndon prefix,
   from the highest group down (``lyndon_groups``): all members of a group hand their context to the next smaller
   suffix on their left. A group's context length is the Lyndon array, and two suffixes of one group start with
   the same Lyndon word.
3. Every run has, under the order of the words or under its reverse, a Lyndon root that is the longest Lyndon
   word at each of its places. So places i and i + length in one group start a chain of equal roots; longest common
   extensions to both sides of the chain give the run (``runs_of``).

One pass over the documents in tasks, no shuffle. A text is held by one task, as rows are.

Edge cases: a null or empty text has no words, no runs, and the hashes of the empty string; a null id has no
decimal form, so ``looped`` leaves its words alone; repeated rows get equal rows; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

LEAST = 24
TIMES = 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def looped(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """One text in ten, by the checksum of its id, with a loop from some word on; the others as they are."""
    n = len(words)
    h = zlib.crc32((doc_id or "").encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def suspects(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Parts ``[a, b)`` outside of which no run of ``least`` words and ``times`` >= 3 periods has a word."""
    gram = max(1, least // 3)
    n = len(codes) - gram + 1
    if len(codes) < least:
        return []
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    sums, width = mixed, 1
    total, done = np.zeros(n, np.uint64), 0
    while done < gram:  # stretches of powers of two make up the gram
        if gram & width:
            total = total * np.uint64(0x100000001B3) + sums[done : done + n]
            done += width
        sums, width = sums[:-width] * (MIX ^ np.uint64(width)) + (sums[width:] ^ (sums[width:] >> np.uint64(31))), width * 2
    ordered = np.sort(total)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(total, kind="stable")
    gap = np.where(total[order[1:]] == total[order[:-1]], np.diff(order), len(codes))
    near = np.full(n, len(codes))  # distance to the nearest equal stretch
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    held = near < len(codes)
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        room = np.repeat(ends - starts + gram - 1, ends - starts)
        at = np.flatnonzero(held)
        fits = (room >= least) & (near[at] * times <= room)
        if fits.all():
            return [(int(a), int(b) + gram - 1) for a, b in zip(starts, ends, strict=True)]
        held[at[~fits]] = False


def lyndon_groups(s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lyndon array of ``s`` (numbers from 0, the end of the string is smallest) and the group of each suffix."""
    n = len(s)
    kinds = max(s, default=-1) + 1
    group = list(s)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(s):
        members[c].append(i)
    length = [1] * kinds
    above, below = [*range(1, kinds), -1], [*range(-1, kinds - 1)]
    smaller, done = [-1] * n, [False] * n
    g = kinds - 1
    while g >= 0:
        told: dict[int, int] = {}
        for i in sorted(j for j in members[g] if group[j] == g):
            j = i - 1
            while j >= 0 and done[j]:
                k = smaller[j]
                if k >= 0 and done[k]:
                    smaller[j] = k = smaller[k]
                j = k
            smaller[i] = j
            done[i] = True
            if j >= 0:
                told[j] = told.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in told.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for times, old in sorted(moves):  # more contexts first: each new group stands right above its old one
            new = len(length)
            length.append(length[old] - times * length[g])
            members.append(moves[times, old])
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in moves[times, old]:
                group[j] = new
        g = below[g]
    group = np.array(group, np.int64)
    return np.array(length, np.int64)[group] if n else group, group


def common(x: np.ndarray, i: int, j: int) -> int:
    """Longest common extension to the right of two places of ``x``."""
    most, got, step = len(x) - max(i, j), 0, 16
    while got < most:
        size = min(step, most - got)
        differ = x[i + got : i + got + size] != x[j + got : j + got + size]
        if differ.any():
            return got + int(differ.argmax())
        got, step = got + size, step * 2
    return got


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs, by start, then period."""
    out = set()
    for a, b in suspects(codes, least, times):
        kinds, x = np.unique(codes[a:b], return_inverse=True)
        back, n = x[::-1], b - a
        for ranks in (x, len(kinds) - 1 - x):
            length, group = lyndon_groups(ranks.tolist())
            at = np.arange(n)
            again = at + length
            same = again < n
            same[same] = group[again[same]] == group[same]
            before = at - length
            first = same & ~((before >= 0) & (group[before] == group))
            for i in np.flatnonzero(first).tolist():
                p = int(length[i])
                last = i
                while same[last]:
                    last += p
                if (last - i) // p + 3 < least / p:
                    continue
                end = last + p + common(x, last, last + p)
                start = i - common(back, n - i, n - i - p)
                if end - start >= max(least, times * p):
                    out.add((a + start, end - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def described(doc_id: str | None, text: str | None, loops: bool, least: int, times: int) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if loops:
        words = looped(words, doc_id)
    runs = runs_of(numbered(words), least, times) if len(words) >= least else []
    kept = words
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        kept = [words[i] for i in np.flatnonzero(stays).tolist()]
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    return len(runs), *top, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), runs, kept


def _per_document(docs: DataFrame, id_col: str, text_col: str, fields: list[StructField], row) -> DataFrame:
    """``row(decimal id, text)`` of every document after its id."""
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *fields])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [row(i if isinstance(i, str) else None, t if isinstance(t, str) else None) for i, t in zip(rows["_i"], rows["_t"], strict=True)]
            cells = {f.name: pd.Series([o[k] for o in out], dtype="Int64" if isinstance(f.dataType, LongType) else object) for k, f in enumerate(fields)}
            yield pd.DataFrame({id_col: rows["_id"]} | cells)

    given = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_i"), F.col(text_col).alias("_t"))
    return given.mapInPandas(scan, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, loops: bool = False) -> DataFrame:
    """One row per document: id, ``n_runs``, the run of greatest exponent, and checksums of runs and of kept words.

    ``loops`` first puts loops into one text in ten (``looped``).
    """
    longs = [StructField(c, LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    fields = [*longs, StructField("runs_sha256", StringType()), StructField("collapsed_sha256", StringType())]
    return _per_document(docs, id_col, text_col, fields, lambda i, t: described(i, t, loops, least, times))


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: id and its text with every run cut to its first period, words joined by blanks."""

    def row(doc_id: str | None, text: str | None) -> tuple:
        return (None if text is None else b" ".join(described(doc_id, text, False, least, times)[-1]).decode("utf-8", "surrogatepass"),)

    return _per_document(docs, id_col, text_col, [StructField(text_col, StringType())], row)


def run_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per run: id, ``start, length, period``."""

    def row(doc_id: str | None, text: str | None) -> tuple:
        return (" ".join(f"{s},{n},{p}" for s, n, p in described(doc_id, text, False, least, times)[-2]),)

    listed = _per_document(docs, id_col, text_col, [StructField("_runs", StringType())], row).where("_runs != ''")
    parts = F.split("_run", ",")
    rows = listed.select(id_col, F.explode(F.split("_runs", " ")).alias("_run"))
    return rows.select(id_col, *[parts[k].cast("long").alias(c) for k, c in enumerate(("start", "length", "period"))])
