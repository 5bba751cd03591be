"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

A text is the multiset of its paragraphs (lines, and the sentences of a line). Each paragraph hashes to a wide
vector of +1 and -1; the fingerprint is the sum of the vectors, each component modulo 2**30. So

* the order of the paragraphs does not matter, and equal multisets have equal fingerprints;
* paragraphs can be put in or taken out later by adding or subtracting their vectors (``combine``, ``without``);
* the scalar product of two fingerprints estimates how many paragraphs they share, which gives a likeness from
  0 to 1, 2 <a, b> / (<a, a> + <b, b>), that is exactly 1 for equal fingerprints.

In a fingerprint, two components lie in one long, 32 bits apart; the two bits above each component take the carry, so that
nothing runs over (Spark's arithmetic is checked). A text has fewer paragraphs than 2**30, so no component wraps, and the
likenesses are those of the fingerprints.

``fingerprint_report`` also compares each document with the next one in descending order of ids. Ids are
range-partitioned (never one global window); the first rows of the partitions, one per partition, close the
gaps. Of the next document only the needed first half moves, keyed by the document that needs it.

Edge cases: a null text is an empty text (an empty sum; two empty texts are alike, 1); very long texts are
summed whole; rows with equal id and text are one document for the order, and each gets its row; rows with the
same id and different texts follow each other by text hash; null ids come last in the order; a single document
is its own next one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import written

HASHES = 2
LONGS = 32 * HASHES  # of two components each
BITS = 30  # a text of 2 GB has fewer paragraphs than 2**30
ONES = 0x0000_0001_0000_0001
MASK = 0x3FFF_FFFF_3FFF_FFFF
HALF = 1 << (BITS - 1)
BORDER = r"\n+|(?<=[.!?]) +"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BORDER), lambda p: F.length(p) > 0)


def _add(a: Column, b: Column) -> Column:
    """Sum of two components each, modulo 2**30."""
    return (a + b).bitwiseAND(F.lit(MASK))


def _negative(a: Column) -> Column:
    return (F.lit(MASK + ONES) - a).bitwiseAND(F.lit(MASK))


def _signs(h: Column, j: int) -> Column:
    """Two bits of a hash as components 1 (set) and -1."""
    bits = F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ONES))
    clear = bits.bitwiseXOR(F.lit(ONES))
    return bits + (F.shiftleft(clear, BITS) - clear)


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), LONGS)


def multiset_hash(parts: Column) -> Column:
    """Fingerprint (array of longs) of an array of paragraphs."""
    hashed = F.transform(parts, lambda p: F.struct(*[F.xxhash64(p, F.lit(s)).alias(f"h{s}") for s in range(HASHES)]))
    step = lambda acc, x: F.array(*[_add(acc[32 * s + j], _signs(x[f"h{s}"], j)) for s in range(HASHES) for j in range(32)])
    return F.aggregate(hashed, zero(), step)


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets."""
    return F.zip_with(a, b, _add)


def without(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` after the paragraphs of ``b`` are taken out."""
    return F.zip_with(a, b, lambda x, y: _add(x, _negative(y)))


def bit_sums(rows: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """``keys``, ``n`` and ``bits`` of the paragraph arrays in ``parts``, as ordinary sums.

    ``n`` is the number of paragraphs; ``bits`` the sums of the hashes' set bits, two to a long 32 bits apart.
    """
    each = rows.select(*keys, F.explode_outer(parts).alias("_p"))
    hashed = each.select(*keys, F.col("_p").isNotNull().cast("long").alias("_n"), *[F.when(F.col("_p").isNull(), 0).otherwise(F.xxhash64("_p", F.lit(s))).alias(f"_h{s}") for s in range(HASHES)])
    bit = lambda s, j: F.shiftrightunsigned(f"_h{s}", j).bitwiseAND(F.lit(1 | 1 << 32))
    sums = hashed.groupBy(*keys).agg(F.sum("_n").alias("n"), *[F.sum(bit(s, j)).alias(f"_s{s}_{j}") for s in range(HASHES) for j in range(32)])
    return sums.select(*keys, "n", F.array(*[F.col(f"_s{s}_{j}") for s in range(HASHES) for j in range(32)]).alias("bits"))


def packed_sums(n: Column, bits: Column) -> Column:
    """The fingerprint of bit sums: a component is twice its sum less the number of paragraphs."""

    def packed(s: int, j: int) -> Column:
        """Components j and j + 32 of hash s in one long."""
        total = [F.shiftrightunsigned(bits[32 * s + j], k).bitwiseAND(F.lit((1 << 32) - 1)) for k in (0, 32)]
        low, high = [(2 * t - n).bitwiseAND(F.lit((1 << BITS) - 1)) for t in total]
        return low.bitwiseOR(F.shiftleft(high, 32))

    return F.array(*[packed(s, j) for s in range(HASHES) for j in range(32)])


def summed_hashes(rows: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """``keys`` and ``fp``: the vectors that ``multiset_hash`` gives, with the paragraphs as rows."""
    return bit_sums(rows, keys, parts).select(*keys, packed_sums(F.col("n"), F.col("bits")).alias("fp"))


def as_text(v: Column) -> Column:
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _components(v: Column) -> Column:
    """The components as signed numbers."""
    two = lambda x: F.array(*[((F.shiftright(x, k) + HALF).bitwiseAND(F.lit(2 * HALF - 1)) - HALF).cast("double") for k in (0, 32)])
    return F.flatten(F.transform(v, two))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints."""
    x, y = _components(a), _components(b)
    both = _product(x, x) + _product(y, y)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * _product(x, y) / both))
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(share)


def followers(ids: DataFrame, rows_per_part: int = 100_000) -> DataFrame:
    """``ids(idk, body, ...)`` with ``nidk, nbody``, the next row in descending order; the last row's is the first."""
    parts = ids.count() // rows_per_part + 1
    order = [F.col("idk").desc(), F.col("body").asc()]
    ranged = written(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    line = Window.partitionBy("part").orderBy(*order)
    own = F.struct("idk", "body")
    rows = ranged.withColumns({"following": F.lead(own).over(line), "first": F.row_number().over(line) == 1})
    heads = rows.where("first").select("part", own.alias("head"))  # one row per partition
    around = Window.partitionBy(F.lit(0)).orderBy("part")
    opened = F.coalesce(F.lead("head").over(around), F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("part", opened.alias("opened"))
    rows = rows.join(heads, "part").withColumn("following", F.coalesce("following", "opened"))
    return rows.drop("first", "opened", "part").withColumns({"nidk": F.col("following.idk"), "nbody": F.col("following.body")}).drop("following")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    idk = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    body = F.xxhash64(F.col(id_col).isNull(), F.col(text_col).isNull(), text)
    light = docs.select(idk.alias("idk"), body.alias("body"), F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_chars"))
    light = light.groupBy("idk", "body").agg(F.count("*").alias("times"), F.max("n_chars").alias("n_chars"), F.max("id").alias("id"))
    rows = docs.select(idk.alias("idk"), body.alias("body"), text.alias("text"))  # the same for both joins: moved once
    links = written(followers(light), "links")
    needs = links.select(F.col("idk").alias("to_idk"), F.col("body").alias("to_body"), "id", "n_chars", "times", F.col("nidk").alias("idk"), F.col("nbody").alias("body"))
    given = needs.join(rows, ["idk", "body"]).select(
        F.col("to_idk").alias("idk"), F.col("to_body").alias("body"), "id", "n_chars", "times", F.expr("left(text, int(n_chars div 2))").alias("tail")
    )
    # copies of the next text met here: one of each goes on
    met = rows.join(given.dropDuplicates(["idk", "body"]), ["idk", "body"])
    met = met.withColumn("edited", F.concat(F.expr("left(text, int(n_chars - n_chars div 2))"), F.col("tail")))
    met = met.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(*[F.struct(F.lit(k).alias("kind"), paragraphs(F.col(c)).alias("parts")) for k, c in enumerate(("text", "edited"))])
    keys = ["idk", "body", "id", "n_chars", "times", "sha"]
    # and one of each copy of the own text is kept before anything is summed
    met = met.dropDuplicates(["idk", "body"]).select(*keys, F.explode(both).alias("v")).select(*keys, "v.kind", "v.parts")
    prints = written(summed_hashes(met, [*keys, "kind"], "parts"), "prints")
    own = prints.where("kind = 0").drop("kind")
    edited = prints.where("kind = 1").select("idk", "body", F.col("fp").alias("efp"))
    following = links.select("idk", "body", "nidk", "nbody").join(own.select(F.col("idk").alias("nidk"), F.col("body").alias("nbody"), F.col("fp").alias("nfp")), ["nidk", "nbody"])
    met = own.join(edited, ["idk", "body"]).join(following.select("idk", "body", "nfp"), ["idk", "body"])
    out = met.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_time"),  # equal rows come back
    )
    return out.drop("_time")
