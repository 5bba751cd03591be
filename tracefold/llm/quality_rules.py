"""Quality rules: compression bands beside word and line counts.

Repetitive text compresses far better than prose, and random or encoded text hardly at all. Both are
found from the zstandard ratio (compressed / raw bytes) of the whole document and of its fixed-size
chunks. A ratio also depends on the length (short texts compress worse), so the limits are given per
length class, for texts and for chunks: the outer fences (quartiles -/+ 3 interquartile ranges) of the ratios
of all texts that pass the base rules, within the fixed limits of ``Bands``. One pass reads the text; its ratios
are written, counted per class and thousandth (a few thousand numbers, whatever the table) and then judged.

Edge cases: a null text counts as a text without words (all counts 0, ``base_failed`` true, ``kept``
false); an empty text has ratio 0 and no chunks; a very long text is read whole; repeated rows and
repeated ids give one row each; an empty table gives an empty result; extra columns are left alone
(only the columns named by the caller are read).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "whole_ratio double, n_chunks long, n_chunks_low long, n_chunks_high long, base_failed boolean, kept boolean"
)
FACTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "_size long, whole_ratio double, _sizes array<long>, _ratios array<double>, _class int, _classes array<int>"
)


Limits = tuple[tuple[float, float, float], ...]


@dataclass(frozen=True)
class Bands:
    """``limits``, ``chunk_limits``: (fewer bytes than this, least ratio, largest ratio), the last for all longer ones.

    They hold for any corpus; ``fitted`` and ``chunk_fitted`` have narrower ones per half octave of the length.
    ``chunk_bytes``-sized chunks (a shorter rest joins the last one) are held against the limits of chunks, a
    text of one chunk against those of texts; a text whose share of chunks outside exceeds ``max_bad_chunks`` is
    rejected. Fences are never closer to a class's median than ``margin``, and n ratios move the limits of their class
    n / (n + ``settling``) of the way from the fixed ones to the fences, so no number of neighbours switches a rule.
    """

    limits: Limits = (
        (256, 0.42, 1.00),
        (512, 0.40, 0.80),
        (1024, 0.36, 0.74),
        (2048, 0.33, 0.70),
        (4096, 0.32, 0.68),
        (16384, 0.31, 0.66),
        (float("inf"), 0.28, 0.64),
    )
    chunk_limits: Limits = ((2048, 0.30, 0.72), (3072, 0.30, 0.70), (float("inf"), 0.29, 0.68))
    chunk_bytes: int = 2048
    max_bad_chunks: float = 0.1
    level: int = 3
    fence: float = 3.0
    margin: float = 0.05
    settling: int = 30
    fitted: Mapping[int, tuple[float, float, int]] = field(default_factory=dict)
    chunk_fitted: Mapping[int, tuple[float, float, int]] = field(default_factory=dict)

    def band(self, size: int, chunk: bool = False) -> tuple[float, float]:
        _, least, most = next(x for x in (self.chunk_limits if chunk else self.limits) if size < x[0])
        low, high, n = (self.chunk_fitted if chunk else self.fitted).get(length_class(size), (least, most, 0))
        weight = n / (n + self.settling)
        return least + weight * max(0.0, low - least), most - weight * max(0.0, most - high)


def length_class(size: int) -> int:
    """Half octaves of the length."""
    return int(2 * math.log2(size)) if size else -1


def fences(counts: Iterable[tuple[int, int]], bands: Bands) -> tuple[float, float, int] | None:
    """Outer fences of ratios given as (thousandth, how many), and their number; none for none."""
    rows = sorted(counts)
    upto = np.cumsum([n for _, n in rows])
    if not rows:
        return None
    q1, q2, q3 = ((rows[bisect_right(upto, q * (upto[-1] - 1))][0] + 0.5) / 1000 for q in (0.25, 0.5, 0.75))
    return min(q1 - bands.fence * (q3 - q1), q2 - bands.margin), max(q3 + bands.fence * (q3 - q1), q2 + bands.margin), int(upto[-1])


def repeated_windows(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found at least twice, the first occurrence included."""
    n = len(words)
    if n < width + 1:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    key, size = codes[: n - width + 1], len(known)
    for k in range(1, width):
        if size * len(known) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key = key * len(known) + codes[k : n - width + 1 + k]
        size *= len(known)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= again
    return int(covered.sum())


def facts(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """The columns of ``FACTS``: counts, ``base_failed``, the text's length and ratio, its chunks' lengths and ratios."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at exactly the blanks \x20 \x09-\x0D
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    n = len(words)
    repeats = repeated_windows(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    size = len(raw)
    ratio = len(packer.compress(raw)) / size if size else 0.0
    cuts = list(range(0, max(1, size - size % bands.chunk_bytes), bands.chunk_bytes)) if size else []
    view = memoryview(raw)
    chunks = [view[a : (cuts[i + 1] if i + 1 < len(cuts) else size)] for i, a in enumerate(cuts)]
    ratios = [len(packer.compress(c)) / len(c) for c in chunks] if len(chunks) > 1 else [ratio] * len(chunks)
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        failed,
        size,
        ratio,
        [len(c) for c in chunks],
        ratios,
    )


def verdict(failed: bool, size: int, ratio: float, sizes: Iterable[int], ratios: Iterable[float], bands: Bands) -> tuple[int, int, int, bool]:
    """(chunks, those below and those above their band, kept)."""
    sizes, ratios = list(sizes), list(ratios)
    limits = [bands.band(k, len(sizes) > 1) for k in sizes]
    low = sum(r < a for r, (a, _) in zip(ratios, limits, strict=True))
    high = sum(r > b for r, (_, b) in zip(ratios, limits, strict=True))
    least, most = bands.band(size)
    in_band = size > 0 and least <= ratio <= most and low + high <= bands.max_bad_chunks * len(ratios)
    return len(ratios), low, high, bool(not failed and in_band)


def measure(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """The columns of ``SCHEMA`` for one text."""
    *counts, failed, size, ratio, sizes, ratios = facts(text, bands, packer)
    *chunks, kept = verdict(failed, size, ratio, sizes, ratios, bands)
    return (*counts, ratio, *chunks, failed, kept)


def quality(text: Column | str, bands: Bands | None = None) -> Column:
    """Struct of the measures and the verdict for one text column (see ``SCHEMA``)."""
    bands = bands or Bands()

    @F.pandas_udf(SCHEMA)
    def rules(texts: pd.Series) -> pd.DataFrame:
        packer = zstandard.ZstdCompressor(level=bands.level)
        return pd.DataFrame([measure(t, bands, packer) for t in texts], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return rules(text)


def _facts(text: Column, bands: Bands) -> Column:
    @F.pandas_udf(FACTS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for t in texts:
            row = facts(t, bands, packer)
            rows.append((*row, length_class(row[6]), [length_class(k) for k in row[8]]))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])

    return scan(text)


def fit(measured: DataFrame, bands: Bands) -> Bands:
    """``bands`` with the fences of the ratios of all texts that pass the base rules."""
    good = measured.where("NOT base_failed")
    whole = good.select(F.lit(False).alias("chunk"), F.col("_class").alias("k"), F.col("whole_ratio").alias("r"))
    parts = good.where(F.size("_sizes") > 1).select(F.explode(F.arrays_zip("_classes", "_ratios")).alias("c"))
    parts = parts.select(F.lit(True).alias("chunk"), F.col("c._classes").alias("k"), F.col("c._ratios").alias("r"))
    counts: dict[tuple[bool, int], list[tuple[int, int]]] = {}
    for row in whole.unionAll(parts).groupBy("chunk", "k", F.floor(F.col("r") * 1000).alias("at")).agg(F.count("*").alias("n")).collect():
        counts.setdefault((row.chunk, row.k), []).append((row["at"], row.n))
    found = {key: f for key, rows in counts.items() if (f := fences(rows, bands))}
    return replace(bands, fitted={k: f for (c, k), f in found.items() if not c}, chunk_fitted={k: f for (c, k), f in found.items() if c})


def _verdict(bands: Bands) -> Column:
    @F.pandas_udf("n_chunks long, n_chunks_low long, n_chunks_high long, kept boolean")
    def judge(failed: pd.Series, size: pd.Series, ratio: pd.Series, sizes: pd.Series, ratios: pd.Series) -> pd.DataFrame:
        rows = [verdict(*x, bands) for x in zip(failed, size, ratio, sizes, ratios, strict=True)]
        return pd.DataFrame(rows, columns=["n_chunks", "n_chunks_low", "n_chunks_high", "kept"])

    return judge("base_failed", "_size", "whole_ratio", "_sizes", "_ratios")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """One row per document: its id, the counts, the ratios, ``base_failed`` and ``kept``.

    Given ``bands`` hold as they are; without any they are fitted to the table.
    """
    if bands:
        return docs.select(F.col(id_col), quality(F.col(text_col), bands).alias("_q")).select(id_col, "_q.*")
    bands = Bands()
    measured = written(docs.select(F.col(id_col).alias("_id"), _facts(F.col(text_col), bands).alias("_q")).select("_id", "_q.*"), "quality")
    judged = measured.withColumn("_v", _verdict(fit(measured, bands))).select("*", "_v.*")
    return judged.select(F.col("_id").alias(id_col), *(x.split()[0] for x in SCHEMA.split(", ")))
