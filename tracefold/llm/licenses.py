"""License scan by diagonal voting, in DataFrame operations only.

1. Every document position gives its word k-grams (k = 2 for phrases, ``GRAM`` for templates); their hashes
   are joined with the k-grams of the templates. The templates are a parameter (some hundred rows), so that
   side is broadcast. The words are compared in the join too: a hit is a hit, not a hash collision.
2. A hit at document position p and template position t votes for the diagonal p - t. Votes are counted per
   row, template and diagonal.
3. A phrase stands wherever one diagonal has all of its votes. For templates, diagonals at most ``slack``
   apart are merged (a word put in or left out moves the rest by one), and the merged span is verified: at
   least ``cover`` of the template's k-grams, in a span at most ``stretch`` times as long as the template, and
   each of the template's marks (its version, the license's own words) inside of a k-gram that is hit.

Only hits move (a shuffle by row); the text is read twice and never moves.

Edge cases: a null text is an empty text (no words, no labels, score 0); very long texts are scanned whole;
repeated rows get equal results; null ids keep their rows; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3

#: Phrase, label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening words of well-known license notices, label, and marks (up to three words) that must stand.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0", ("apache license", "version 2 0")),
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2.0", ("gnu general public", "version 2")),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0", ("gnu general public", "version 3")),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", ("gnu general public",)),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl", ("lesser general public",)),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl", ("mozilla public license",)),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by", ("attribution 4 0",)),
    ("Licensed under CC BY 4.0", "cc-by", ("by 4 0",)),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc", ("by nc 4", "4 0")),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa", ("by sa 4", "4 0")),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd", ("by nd 4", "4 0")),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa", ("nc sa 4", "4 0")),
    ("Licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd", ("nc nd 4", "4 0")),
)


def words_of(text: str) -> list[str]:
    """The words of a template, cut like those of a document."""
    return re.findall(WORDS, text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple]) -> DataFrame:
    """``(t, k, at, w0, w1, w2, n_grams, n_words, label, phrase, own, n_own)``: every k-gram of every template.

    ``own`` are the marks that lie inside of the k-gram, by their number, and ``n_own`` is how many there are.
    """
    rows = []
    for t, (phrase, text, label, *marks) in enumerate([(True, *p) for p in phrases] + [(False, *x) for x in templates]):
        words = words_of(text)
        k = min(2 if phrase else GRAM, len(words))
        if k < 2:
            raise ValueError(f"a template needs two words at least: {text!r}")
        marks = [words_of(m) for m in (marks[0] if marks else ())]
        if any(all(words[i : i + len(m)] != m for i in range(len(words))) or not 0 < len(m) <= k for m in marks):
            raise ValueError(f"marks are one to {k} words of the template: {text!r}")
        for at in range(len(words) - k + 1):
            own = [n for n, m in enumerate(marks) if any(words[i : i + len(m)] == m for i in range(at, at + k - len(m) + 1))]
            gram = words[at : at + k] + [""] * (GRAM - k)
            cells = {"t": t, "k": k, "at": at, "w0": gram[0], "w1": gram[1], "w2": gram[2], "n_grams": len(words) - k + 1, "n_words": len(words), "label": label, "phrase": phrase}
            more = (F.array(*map(F.lit, own)).cast("array<int>").alias("own"), F.lit(len(marks)).alias("n_own"))
            rows.append(F.struct(*[F.lit(v).alias(n) for n, v in cells.items()], *more))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def _hash(k: Column, *words: Column) -> Column:
    return F.xxhash64(k, *words)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_words(text: Column) -> Column:
    """The words of a document; cutting between words is faster than collecting matches."""
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def hits(docs: DataFrame, text_col: str, row: Column, grams: DataFrame) -> DataFrame:
    """Distinct ``(row, t, diagonal, at)`` of the document k-grams that are template k-grams."""
    words = docs.select(row.alias("row"), text_words(F.col(text_col)).alias("w"))
    n = F.size("w")
    near = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c"))
    places = words.where(n > 1).select("row", F.posexplode(near).alias("pos", "g"))
    places = places.select("row", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.coalesce(F.col("g.c"), F.lit("")).alias("c")).where("b IS NOT NULL")
    two = F.struct(F.lit(2).alias("k"), _hash(F.lit(2), F.col("a"), F.col("b"), F.lit("")).alias("h"), F.lit("").alias("c"))
    three = F.struct(F.lit(3).alias("k"), _hash(F.lit(3), F.col("a"), F.col("b"), F.col("c")).alias("h"), F.col("c").alias("c"))
    places = places.select("row", "pos", "a", "b", F.explode(F.array(two, three)).alias("x")).select("row", "pos", "a", "b", "x.*")
    keyed = grams.withColumn("h", _hash(F.col("k"), F.col("w0"), F.col("w1"), F.col("w2"))).withColumnRenamed("k", "kt")
    same = (F.col("h") == F.col("ht")) & (F.col("k") == F.col("kt")) & (F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1")) & (F.col("c") == F.col("w2"))
    found = places.join(F.broadcast(keyed.withColumnRenamed("h", "ht")), same)  # the templates are a parameter
    facts = ("n_grams", "n_words", "label", "phrase", "own", "n_own")
    return found.select("row", "t", (F.col("pos") - F.col("at")).alias("diagonal"), "at", *facts).dropDuplicates(["row", "t", "diagonal", "at"])


def spans(found: DataFrame, slack: int, cover: float, stretch: float) -> DataFrame:
    """``(row, label, phrase, start, coverage)`` of the phrases and of the verified template spans."""
    votes = found.groupBy("row", "t", "diagonal", "n_grams", "n_words", "label", "phrase", "n_own").agg(
        F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.collect_list("at").alias("ats"),
        F.array_distinct(F.flatten(F.collect_list("own"))).alias("owns"),
    )
    exact = votes.where("phrase AND votes = n_grams").select("row", "label", "phrase", F.col("diagonal").alias("start"), F.lit(1.0).alias("coverage"))
    line = Window.partitionBy("row", "t").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > slack).cast("int"), F.lit(1))
    merged = votes.where("NOT phrase").withColumn("group", F.sum(fresh).over(line))
    merged = merged.groupBy("row", "t", "group", "n_grams", "n_words", "label", "phrase", "n_own").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("seen"),  # positions of one template, a few dozen at most
        F.size(F.array_distinct(F.flatten(F.collect_list("owns")))).alias("owned"),
        F.min(F.col("diagonal") + F.col("low")).alias("start"),
        F.max(F.col("diagonal") + F.col("high")).alias("end"),
    )
    coverage = F.col("seen") / F.col("n_grams")
    good = (coverage >= cover) & (F.col("owned") == F.col("n_own")) & (F.col("end") - F.col("start") + GRAM <= F.col("n_words") * stretch)
    return exact.unionByName(merged.where(good).select("row", "label", "phrase", "start", coverage.alias("coverage")))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple] = TEMPLATES,
    slack: int = 2,
    cover: float = 0.7,
    stretch: float = 1.5,
) -> DataFrame:
    """One row per document: id, ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the best coverage among the labels found (1 for a phrase), 0 without any.
    """
    row = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    found = spans(hits(docs, text_col, row, template_grams(docs.sparkSession, phrases, templates)), slack, cover, stretch)
    base = F.when(F.col("phrase"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  labels are few
    told = found.groupBy("row").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select(F.col(id_col), row.alias("_row"), F.size(text_words(F.col(text_col))).cast("long").alias("n_words"))
    told = told.withColumnRenamed("row", "_row")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    columns = [F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    return rows.join(told, "_row", "left").select(id_col, "n_words", *columns)
