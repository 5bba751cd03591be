"""Distributed histograms: A18 (fill + merge), D1 (user fill/merge), S6 (partitioned read), S8 (write).

Bins follow the usual fixed-width convention: bin 0 is the underflow,
``n + 1`` the overflow, bin i covers ``[lo + (i-1) w, lo + i w)``.
Merging by addition is Spark's partial + final aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string


FAN_IN = 16  # partials that one merge step takes


@dataclass(frozen=True)
class HistSpec:
    name: str
    column: str
    lo: float
    hi: float
    bins: int

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.bins


def bin_index(x: Column, spec: HistSpec) -> Column:
    inner = F.floor((x.cast("double") - F.lit(float(spec.lo))) / F.lit(spec.width)).cast("long") + 1
    return (
        F.when(x < F.lit(spec.lo), F.lit(0).cast("long"))
        .when(x >= F.lit(spec.hi), F.lit(spec.bins + 1).cast("long"))
        .otherwise(F.least(inner, F.lit(spec.bins).cast("long")))
    )


def histogram_fill(df: DataFrame, specs: list[HistSpec]) -> DataFrame:
    """(hist, bin, count) for every spec in one pass (stack), merged by groupBy (partial+final)."""
    cols = [F.struct(F.lit(s.name).alias("hist"), bin_index(F.col(s.column), s).alias("bin")) for s in specs]
    e = df.select(F.explode(F.array(*cols)).alias("h")).where(F.col("h.bin").isNotNull())
    return e.groupBy("h.hist", "h.bin").agg(F.count(F.lit(1)).alias("count"))


def numpy_fill(specs: list[HistSpec]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A per-partition fill function for ``process_and_merge``: numpy binning, one partial row per non-empty bin."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {s.name: np.zeros(s.bins + 2, dtype=np.int64) for s in specs}
        for pdf in batches:
            for s in specs:
                x = pdf[s.column].to_numpy(dtype=float, na_value=np.nan)
                x = x[~np.isnan(x)]
                b = np.floor((x - float(s.lo)) / s.width).astype(np.int64) + 1
                b = np.minimum(b, s.bins)
                b[x < s.lo] = 0
                b[x >= s.hi] = s.bins + 1
                acc[s.name] += np.bincount(b, minlength=s.bins + 2)
        rows = [(n, i, int(c)) for n, a in acc.items() for i, c in enumerate(a) if c]
        yield pd.DataFrame(rows, columns=["hist", "bin", "count"])

    return fill


def add_counts(partials: pd.DataFrame) -> pd.DataFrame:
    """A merge function for ``process_and_merge``: partials of one key added up."""
    return partials.groupby(["hist", "bin"], as_index=False)["count"].sum()


def process_and_merge(df: DataFrame, fill, merge: str = "sum",
                      schema: str = "hist string, bin bigint, count bigint") -> DataFrame:
    """User ``fill`` per partition (mapInPandas) then an associative merge by key.

    ``merge="sum"`` adds counts with a built-in aggregate (partial + final);
    a callable merges partial frames of one key in pandas. Each partition first merges its own partials, then they
    are merged in levels, at most ``FAN_IN`` at a time, so no group grows with the number of partitions. The callable
    gets and returns frames of ``schema`` with one key each, and must be associative.
    """
    if merge == "sum":
        partial = df.mapInPandas(fill, schema)
        return partial.groupBy("hist", "bin").agg(F.sum("count").cast("long").alias("count"))

    columns = [f.name for f in _parse_datatype_string(schema).fields]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        given = [p for p in fill(batches) if len(p)]
        if given:
            merged = [merge(g[columns]) for _, g in pd.concat(given).groupby(["hist", "bin"], sort=False)]
            yield pd.concat(merged).assign(_part=TaskContext.get().partitionId())

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf["_part"].iloc[0] // FAN_IN
        return (merge(pdf[columns]) if len(pdf) > 1 else pdf[columns]).assign(_part=part)

    left, parts = df.rdd.getNumPartitions(), df.mapInPandas(own, f"{schema}, _part bigint")
    while True:
        parts = parts.groupBy("hist", "bin", F.floor(F.col("_part") / FAN_IN)).applyInPandas(together, f"{schema}, _part bigint")
        left = -(-left // FAN_IN)
        if left <= 1:
            return parts.select(*columns)


def read_partitioned(spark: SparkSession, paths: list[str], n: int | None = None) -> DataFrame:
    """Many files as one dataset, in the input's own splits or in (at most / about) n partitions."""
    df = spark.read.parquet(*paths)
    if n is None:
        return df
    have = df.rdd.getNumPartitions()
    return df.coalesce(n) if have > n else df.repartition(n)


def write_histograms(df: DataFrame, path: str) -> None:
    """Store every result histogram (overwrite)."""
    df.write.mode("overwrite").partitionBy("hist").parquet(path)


# Fixed histogram set of the bundled queries (lineitem columns).
LINEITEM_HISTS = [
    HistSpec("price", "l_extendedprice", 0.0, 110000.0, 110),
    HistSpec("quantity", "l_quantity", 0.0, 51.0, 51),
    HistSpec("discount", "l_discount", 0.0, 0.11, 11),
]
