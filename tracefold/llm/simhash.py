"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

1. ``fingerprint``: 64-bit SimHash of a text's word shingles (XXH64, seed 42, repeats included), one pass,
   no shuffle.
2. Equal fingerprints are one vertex, so groups of exact copies shrink to one row before anything is joined.
3. The 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints that differ in at most d bits agree in at
   least BLOCKS - d blocks, so they share one of the keys made of BLOCKS - d blocks (10 keys of about 38
   bits for d = 2). Rows join on the key, and the pair stays if its distance is at most d. Pairs whose
   key holds too many rows are first split again by the same rule on the bits outside of the key.
4. Components of the verified pairs; a component's id is the smallest document id in it.

Nothing is capped: a hot key is split again, never cut, and pairs exist only between different fingerprints.

Edge cases: null and empty texts have fingerprint zero and link like any other; a text of fewer words than
a shingle is one shingle; repeated rows get one row each and the same component; a null id keeps its row,
and counts for the component id only if no other document of the component has an id; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import spare, written
from tracefold.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BITS = 64
BLOCKS = 5
HOT_KEY = 2_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + k]), SEED) for i in range(n)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, 65_536):
        part = hashes[a : a + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column | str, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    return of(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _mask(bits) -> int:
    """Bits as a signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def block_masks(bits: list[int], blocks: int, max_bits: int) -> list[int]:
    """Masks of every choice of ``blocks - max_bits`` of the blocks that ``bits`` are cut into."""
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_mask(b for p in chosen for b in p) for chosen in combinations(parts, blocks - max_bits)]


def close_pairs(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot_key: int = HOT_KEY) -> DataFrame:
    """``prints(fp)`` of distinct fingerprints -> distinct pairs ``(u, v)``, u < v, at most ``max_bits`` apart."""
    blocks = max(blocks, max_bits + 1)
    masks = block_masks(list(range(BITS)), blocks, max_bits)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("which", "block"))
    sizes = keyed.groupBy("which", "block").agg(F.count("*").alias("n")).where("n > 1")
    keyed = written(keyed.join(sizes, ["which", "block"]), "blocks")  # rows alone in their block have no partner
    far = F.expr("bit_count(a.fp ^ b.fp)")
    plain = keyed.where(F.col("n") <= hot_key).withColumn("sub", F.lit(0).cast("long"))
    # the free bits of each key, cut again by the same rule
    again = [block_masks([b for b in range(BITS) if not (m >> b) & 1], blocks, max_bits) for m in masks]
    finer = F.element_at(F.array(*[F.array(*[F.lit(x) for x in a]) for a in again]), F.col("which") + 1)
    hot = keyed.where(F.col("n") > hot_key).select("fp", "which", "block", "n", F.posexplode(finer).alias("choice", "mask"))
    hot = hot.withColumn("sub", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask")))).drop("choice", "mask")
    rows = plain.unionByName(hot)
    pairs = rows.alias("a").join(
        rows.alias("b"),
        (F.col("a.which") == F.col("b.which")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.sub") == F.col("b.sub"))
        & (F.col("a.fp") < F.col("b.fp")) & (far <= max_bits),
    )
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    hot_key: int = HOT_KEY,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    marked = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle_words).alias("fp")), "fingerprints")
    return _labelled(marked, max_bits, blocks, hot_key).select(
        F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def _labelled(marked: DataFrame, max_bits: int, blocks: int, hot_key: int) -> DataFrame:
    """``marked(fp, id, ...)`` with ``root``, the component, and ``least``, its smallest id."""
    prints = written(marked.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    roots = components(close_pairs(prints.select("fp"), max_bits, blocks, hot_key)).withColumnsRenamed({"vertex": "fp"})
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    labels = written(rooted.join(least, "root").select("fp", "root", "least"), "labels")
    return marked.join(labels, "fp")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    hot_key: int = HOT_KEY,
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each near-duplicate group, one row per group.

    Of several rows with that id, the one with the least text hash stays; a group whose rows all lack an
    id keeps one of them. The columns are those of ``docs``. The text moves once, for the last join.
    """
    key = F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)
    marked = written(docs.select(F.col(id_col).alias("id"), key.alias("key"), fingerprint(F.col(text_col), shingle_words).alias("fp")), "fingerprints")
    order = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("first")
    chosen = _labelled(marked, max_bits, blocks, hot_key).groupBy("root").agg(order).select(F.col("first.key").alias(mine := spare(docs, "_key")))
    return docs.withColumn(mine, key).join(chosen, mine, "left_semi").dropDuplicates([mine]).select(*docs.columns)
