"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: how its rate changes over training time 0..1 (piecewise linear,
integral scaled to 1, so the weight stays its mean rate). The steps:

1. Source sizes, and targets by weight. A target stops at ``max_passes`` times its source's size; the excess
   is shared by weight among the others (the level is found from the sources sorted by size over weight).
2. Documents of a source stand in hash order; a bucketed prefix sum gives the words demanded before each.
   A source with a third of all rows is spread over many buckets.
3. A pass over the source takes a document's words until the target is reached, so the last one may be cut.
   The position of a document is the time at which its source's cumulative demand (the integral of the
   schedule) reaches the words before it: the integral is inverted in closed form.
4. Documents are range-sorted by position.

Only (id, source, size, hash) rows move. Reruns agree: hash order does not depend on partitioning.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, the
last in order; repeated rows are documents of their own; null ids keep their rows; a source without words has
target 0; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import prefix_sums, spare, written

Schedule = Sequence[tuple[float, float]]

#: By the order of the sources, repeating: weights, and schedules as (time, rate) knots.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.6, 0.8), (1.0, 2.0)),
    ((0.0, 1.6), (0.4, 1.0), (1.0, 0.4)),
)
SEED = 7
BLANKS = "\\x20\\x09-\\x0D"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> list[float]:
    """Areas under the schedule up to each knot."""
    out = [0.0]
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (r0 + r1) / 2)
    return out


def time_of(share: Column, schedule: Schedule) -> Column:
    """Time at which a schedule has brought ``share`` (0..1) of its integral; a quadratic per segment."""
    areas = integral(schedule)
    if not areas[-1] > 0 or any(r < 0 for _, r in schedule):
        raise ValueError("a schedule needs rates of 0 or more and a positive integral")
    x = share * F.lit(areas[-1])
    out = F.lit(schedule[-1][0])
    for (t0, r0), (t1, r1), area, end in reversed(list(zip(schedule, schedule[1:], areas, areas[1:], strict=False))):
        rest = x - F.lit(area)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + F.lit(2 * (r1 - r0) / (t1 - t0)) * rest))
        inside = F.lit(t0) + F.when(rest <= 0, 0.0).otherwise(2 * rest / (F.lit(r0) + root))
        out = F.when(x < end, F.least(inside, F.lit(t1))).otherwise(out)
    return out


def _cycled(index: Column, values: Sequence[Column]) -> Column:
    out = values[-1]
    for k in range(len(values) - 1):
        out = F.when(index % len(values) == k, values[k]).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_passes: float) -> DataFrame:
    """``sizes(source, source_size)``, one row per source -> with ``index`` and ``target``.

    The sources are a small table (one row each), so they are ranked in one window. The level up to which
    weights are served is the largest of (words left) / (weights left) over the sources sorted by cap over
    weight: it rises while sources are capped and falls after.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("index", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", _cycled(F.col("index"), [F.lit(float(w)) for w in weights]))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_passes)))
    rising = every.orderBy(F.col("cap") / F.col("weight"), "index")
    served = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    waiting = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ((F.sum("source_size").over(every) * F.lit(float(share))) - served) / waiting
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return ranked.select("source", "source_size", "index", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    share: float = 1.5,
    max_passes: int = 2,
) -> DataFrame:
    """One row per document: ``id, row, size, source, source_size, target, taken, passes``.

    ``row`` is a hash of the row; ``passes`` is an array of (pass, words, position) with words > 0.
    """
    light = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(id_col, text_col).alias("row"))
    light = written(light, "sizes")
    goals = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_passes)
    placed = prefix_sums(light, ["source"], [F.col("row"), F.col("id"), F.col("size")], F.col("row"), F.col("size"), "before")
    joined = placed.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).drop(F.col("g.source"))
    whole = F.round("target").cast("long")
    passes = []
    for k in range(max_passes):
        first = F.col("before") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - first))
        done = first / F.greatest(F.col("target"), F.lit(1e-9))
        at = _cycled(F.col("index"), [time_of(done, s) for s in schedules])
        passes.append(F.struct(F.lit(k).alias("pass"), words.alias("words"), at.alias("position")))
    joined = joined.withColumn("passes", F.filter(F.array(*passes), lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    return joined.select("id", "row", "size", "source", "source_size", "target", taken.alias("taken"), "passes")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """The mix per document, range-sorted by the position of the first pass; documents not taken come last."""
    mixed = mix(docs, **options)
    first = F.when(F.size("passes") > 0, F.col("passes")[0]["position"])
    return mixed.select(
        F.col("id").alias(options.get("id_col", "doc_id")), "size", "source_size", "target", "taken", F.size("passes").alias("n_passes"), first.alias("position")
    ).orderBy(F.col("position").asc_nulls_last(), F.col(options.get("id_col", "doc_id")))


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """The training order as rows of ``docs``: each pass of a document is a row, range-sorted by position.

    A source's last document is cut after the words that its target leaves (and ``length_col``, if it is
    there, follows). The columns are those of ``docs``.
    """
    id_col = options.get("id_col", "doc_id")
    names = ("_row", "_size", "_words", "_position")
    row, size, words, position = (spare(docs, n) for n in names)
    order = mix(docs, text_col=text_col, **options).select("row", "size", F.explode("passes").alias("p"))
    order = order.select(F.col("row").alias(row), F.col("size").alias(size), F.col("p.words").alias(words), F.col("p.position").alias(position))
    one = docs.withColumn(row, row_hash(id_col, text_col)).dropDuplicates([row])  # repeated rows come back by their passes

    @F.pandas_udf("string")
    def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([_first_words(t, int(n)) for t, n in zip(texts, counts, strict=True)], dtype=object)

    out = one.join(order, row)
    cut = F.col(words) < F.col(size)
    rest = out.where(cut).withColumn(text_col, first_words(F.col(text_col), F.col(words)))
    if length_col in docs.columns:
        rest = rest.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.where(~cut).unionByName(rest).orderBy(position, row).select(*docs.columns)


def _first_words(text: str | None, n: int) -> str | None:
    """The text up to the end of its ``n``-th word."""


    if text is None:
        return None
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text), 1):
        if k == n:
            return text[: m.end()]
    return text
