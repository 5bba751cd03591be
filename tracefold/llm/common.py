"""Small helpers shared by the operators of this folder.

Tables that are read more than once are written as Parquet below the shared folder named in
``spark.checkpoint.dir`` and read back. That cuts the lineage, survives lost executors, and keeps
columns prunable. Only a local session that names no folder gets one of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.plans.registry import Query

#: Query name -> (function, DuckDB text or None); filled by the q_* modules of this folder.
LLM_QUERIES: dict[str, Query] = {}


def llm_query(name: str, sql: str | None = None) -> Callable:
    def deco(fn):
        LLM_QUERIES[name] = Query(name, fn, sql)
        return fn

    return deco


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a folder for its lifetime."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracefold-llm-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with the schema it had."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sums(
    df: DataFrame,
    keys: Iterable[str],
    order: Iterable[Column],
    spread: Column,
    value: Column,
    out: str,
    rows_per_bucket: int = 200_000,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``keys``, in the order (spread, *order).

    ``spread`` is a 64-bit hash of the row. Its top bits give the bucket, so a key that holds a third of
    all rows is spread over as many tasks as it has buckets; the bucket count follows the row count, and the
    order inside a key is the hash order whatever the partitioning or the buckets. Bucket totals are a small table of
    ``keys`` times buckets.
    """
    from pyspark.sql import Window

    keys = list(keys)
    bits = max(0, (df.count() // rows_per_bucket).bit_length())
    cols = df.columns
    ordered = spread.bitwiseXOR(F.lit(-(1 << 63)))  # signed order as unsigned order
    bucket = F.shiftrightunsigned(ordered, 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    rows = df.withColumns({"_spread": spread, "_bucket": bucket, "_value": value})
    same = [F.col(f"_t.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*keys, "_bucket"]]
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    joined = rows.alias("_r").join(sums.alias("_t"), _all(same)).select("_r.*", "_t._base")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_spread", *order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*cols, (F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).alias(out))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
