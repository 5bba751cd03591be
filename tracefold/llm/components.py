"""Connected components of an edge table by alternating large and small stars.

Each round replaces the edges by at most as many: every vertex tells its larger neighbours (large star)
and then its smaller ones (small star) the least vertex it knows. Both are one aggregation and one
equi-join, so no neighbour list is ever collected. The rounds end when the edges no longer change;
their number grows with the logarithm of the vertices. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of one comparable type -> ``(vertex, root)`` for every vertex on an edge, its own root included.

    ``root`` is the least vertex of the component. Loops and repeated edges do no harm; an empty table
    gives an empty result; rows with a null end are ignored.
    """
    ends = edges.where("u != v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    now, seen = written(ends, "edges"), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            break
        now, seen = written(_small_star(_large_star(now)), "edges"), sign
    return now.select(F.col("hi").alias("vertex"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("vertex"), F.col("lo").alias("root")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    told = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return told.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
