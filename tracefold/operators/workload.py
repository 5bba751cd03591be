"""The sample workload of the testing notebook, re-expressed on DataFrames.

Fixed values of the workload: broadcast list [3, 5] (only its first element
is used), pair sums kept when even, ``3*z - 3`` kept when odd, every pair of
the two filtered sets flattened and unioned with the right input, summed.

Cartesian products are never materialised: every quantity the workload
derives from a product of two inputs (counts and sums of pair values, of
flattened pairs) is an exact function of per-side counts and sums grouped by
parity, computed in one aggregate over the union of both inputs. That keeps
the work linear in the inputs; sums are DECIMAL(38,0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

B = [3, 5]
DEC = T.DecimalType(38, 0)


def from_values(spark: SparkSession, values: list[int], name: str = "value") -> DataFrame:
    """An in-memory collection as a dataset."""
    return spark.createDataFrame([(int(v),) for v in values], f"{name} bigint")


def _d(c: Column) -> Column:
    return c.cast(DEC)


def side_marginals(left: DataFrame, right: DataFrame, col: str = "value") -> DataFrame:
    """Counts and sums per parity of both inputs in one pass (union + one global aggregate)."""
    u = left.select(F.lit(0).alias("side"), F.col(col).cast("long").alias("v")).unionByName(
        right.select(F.lit(1).alias("side"), F.col(col).cast("long").alias("v")))
    aggs = []
    for side, nm in [(0, "x"), (1, "z")]:
        for par in (0, 1):
            cond = (F.col("side") == side) & (F.pmod(F.col("v"), F.lit(2)) == par)
            aggs += [F.count_if(cond).cast(DEC).alias(f"n{nm}{par}"),
                     F.coalesce(F.sum(F.when(cond, _d(F.col("v")))), F.lit(0).cast(DEC)).alias(f"s{nm}{par}")]
    # the odd-filtered map 3*z - b0 of the right input, by parity of its result
    b0 = B[0]
    m = 3 * F.col("v") - b0
    odd_m = (F.col("side") == 1) & (F.pmod(m, F.lit(2)) == 1)
    aggs += [F.count_if(odd_m).cast(DEC).alias("n6"),
             F.coalesce(F.sum(F.when(odd_m, _d(m))), F.lit(0).cast(DEC)).alias("s6"),
             F.count_if(F.col("side") == 1).cast(DEC).alias("nz"),
             F.coalesce(F.sum(F.when(F.col("side") == 1, _d(F.col("v")))), F.lit(0).cast(DEC)).alias("sz")]
    return u.agg(*aggs)


def cross_pair_stats(left: DataFrame, right: DataFrame, col: str = "value") -> DataFrame:
    """J14 (re-aimed): count and sum of ``x + z + b0`` over the Cartesian product, split by the
    parity of that value, without emitting pairs."""
    m = side_marginals(left, right, col)
    b0 = B[0]
    rows = []
    for px in (0, 1):
        for pz in (0, 1):
            par = (px + pz + b0) % 2
            nx, sx, nz, sz = F.col(f"nx{px}"), F.col(f"sx{px}"), F.col(f"nz{pz}"), F.col(f"sz{pz}")
            rows.append(F.struct(F.lit(par).alias("parity"), (nx * nz).alias("n"),
                                 (sx * nz + sz * nx + F.lit(b0).cast(DEC) * nx * nz).alias("s")))
    e = m.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.parity").agg(
        F.sum("r.n").alias("n_pairs"), F.sum("r.s").alias("sum_values"))
    return e.select(F.col("parity").cast("long").alias("parity"),
                    F.col("n_pairs").cast("string").alias("n_pairs"), F.col("sum_values").cast("string").alias("sum_values"))


def sample_workload(left: DataFrame, right: DataFrame, col: str = "value") -> DataFrame:
    """The notebook's reduce(sum) and count of RDD9, exact, one row.

    RDD5 = even x+z+b0 over pairs; RDD6 = odd 3z-b0; RDD8 = RDD5 x RDD6 flattened;
    RDD9 = RDD8 union right. sum(RDD8) = |RDD6| sum(RDD5) + |RDD5| sum(RDD6).
    """
    m = side_marginals(left, right, col)
    b0 = B[0]
    n5 = None
    s5 = None
    for px in (0, 1):
        for pz in (0, 1):
            if (px + pz + b0) % 2 != 0:
                continue
            nx, sx, nz, sz = F.col(f"nx{px}"), F.col(f"sx{px}"), F.col(f"nz{pz}"), F.col(f"sz{pz}")
            n = nx * nz
            s = sx * nz + sz * nx + F.lit(b0).cast(DEC) * nx * nz
            n5 = n if n5 is None else n5 + n
            s5 = s if s5 is None else s5 + s
    n6, s6 = F.col("n6"), F.col("s6")
    total = n6 * s5 + n5 * s6 + F.col("sz")
    count = F.lit(2).cast(DEC) * n5 * n6 + F.col("nz")
    return m.select(
        n5.cast("string").alias("n_even_pairs"), s5.cast("string").alias("sum_even_pairs"),
        n6.cast("string").alias("n_odd_mapped"), s6.cast("string").alias("sum_odd_mapped"),
        count.cast("string").alias("n_values"), total.cast("string").alias("total"),
    )


def observed_sum(df: DataFrame, col: str, name: str = "acc"):
    """An accumulator-like sum beside an action's own result, exact once per action (``observe``)."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.sum(col).alias("sum"), F.count(F.lit(1)).alias("count")), obs


def side_channel_sum(df: DataFrame, col: str) -> DataFrame:
    """The sum that the accumulator ends with, and how many rows added to it."""
    return df.agg(F.sum(col).alias("acc_sum"), F.count(col).alias("n_added"))


def pairs_to_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Flatten each pair into two rows."""
    return df.select(F.explode(F.array(F.col(a), F.col(b))).alias("value"))


def map_filter_count(df: DataFrame, col: str) -> DataFrame:
    """X -> x*x, keep even, count (Column expressions, no Python lambdas)."""
    sq = F.col(col).cast("long") * F.col(col).cast("long")
    return df.select(sq.alias("sq")).where(F.pmod(F.col("sq"), F.lit(2)) == 0).agg(F.count(F.lit(1)).alias("n_even_squares"))


def for_each(df: DataFrame, fn) -> None:
    """D3: side effects per partition (foreachPartition)."""
    df.foreachPartition(fn)


def broadcast_lookup(fact: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Look a small dimension up. The planner broadcasts it by its measured size, or shuffles both sides."""
    return fact.join(dim, on)
