"""Prefix sums over buckets of equal depth: the one building block of every series operator.

A running sum ordered by time over a whole application would put the whole
application in one task (and ``Window.orderBy`` without ``partitionBy`` would
put the whole cluster history in one task). Instead:

1. a quantile sketch of all rows, in the order (hash of the key, time), gives the
   borders of buckets of about equal depth, whatever the times look like and
   whichever key holds most rows. The borders are one broadcast row of a fixed number
   of longs (``spark.sql.shuffle.partitions`` times ``PER_PARTITION``);
2. a row's bucket is its place among the borders (a search by halves);
3. totals per ``(key, bucket)`` of the keys with a border inside — a map-side-combined
   aggregate. A key without one lies in one bucket and needs none, so there are
   about as many totals as borders, however many keys there are;
4. a window over those totals per key gives each bucket its ``base`` (sum of
   all earlier buckets) and the first time of the next non-empty bucket;
5. the rows move once, to ``(key, bucket)``, where they meet the few totals in a hash
   join and the running sum inside the bucket is a window on that partitioning.

A hot application, or one dense hour of it, is spread over as many groups as it
has borders; small keys stay whole.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
SPLIT = "_split"
PER_PARTITION = 4
TIME_BITS = 42  # epoch milliseconds up to the year 2109; later times share the last place


def with_bucket(df: DataFrame, keys: Sequence[str], time_col: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``BUCKET``: of equal depth over all rows, never decreasing with time inside a key; and with ``SPLIT``: whether
    a key may have rows in several.

    A row without a time is in its key's first bucket.
    """
    wanted = buckets or PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(2, math.isqrt(max(1, wanted - 1)) + 1)
    t = F.least(F.greatest(F.col(time_col).cast("long"), F.lit(0)), F.lit((1 << TIME_BITS) - 1))
    lowest = F.pmod(F.xxhash64(*keys), F.lit(1 << (63 - TIME_BITS))) * F.lit(1 << TIME_BITS)  # of the key
    place = lowest + t
    fractions = [i / (side * side) for i in range(1, side * side)]
    placed = df.withColumn("_place", place)
    timed = F.when(F.col(time_col).isNotNull(), F.col("_place"))
    # one row, met by a key that is zero for every row
    borders = placed.agg(F.percentile_approx(timed, fractions, max(10_000, 20 * side * side)).alias("_borders"))
    borders = borders.select("_borders", (F.size("_borders") * 0).cast("long").alias("_key"))
    rows = placed.withColumn("_key", F.pmod(F.col("_place"), F.lit(1))).join(F.broadcast(borders), "_key", "left")
    # how many borders lie before the row: halving steps, each a column of its own, so that they are compiled and none is worked
    # out twice (a lambda over the borders would be interpreted for every row)
    rows = rows.withColumn(BUCKET, F.lit(0))
    step = 1 << (len(fractions).bit_length() - 1)
    while step:
        passed = F.get("_borders", F.col(BUCKET) + (step - 1)) < F.col("_place")  # NULL behind the last one
        rows = rows.withColumn(BUCKET, F.col(BUCKET) + F.when(passed, step).otherwise(0))
        step //= 2
    # the borders on both sides of a row: one of them is the key's own if it has any
    lowest = F.shiftleft(F.shiftright("_place", TIME_BITS), TIME_BITS)
    inside = (F.get("_borders", F.col(BUCKET) - 1) >= lowest) | (F.get("_borders", F.col(BUCKET)) < lowest + F.lit(1 << TIME_BITS))
    # a partition's number is no constant for the planner, so it does not put the steps, doubled at each, into filters on the bucket
    bucket = F.col(BUCKET) + F.when(F.spark_partition_id() < 0, 1).otherwise(0)
    rows = rows.select(*df.columns, F.when(F.col("_borders").isNotNull(), bucket).cast("long").alias(BUCKET), inside.alias(SPLIT))
    return rows.withColumn(SPLIT, F.coalesce(SPLIT, F.lit(False)))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    values: Sequence[str] | Mapping[str, Column],
    tiebreak: Sequence[str | Column] = (),
    next_time: str | None = None,
    suffix: str = "_run",
    total_suffix: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<v><suffix>`` = running sum of ``v`` over ``(time_col, *tiebreak)`` per ``keys``.

    Rows with equal order keys get distinct running values in the order of
    ``tiebreak``; callers that need one value per time pre-aggregate by time
    first. If ``next_time`` is given, adds the next row's time within the key
    (crossing bucket borders), NULL for the last row. If ``total_suffix`` is
    given, adds each value's total over the key (from the bucket totals).
    ``values`` may be names with expressions over ``df``; these are worked out where the rows arrive, so that only what
    they are made of moves. ``buckets`` is the number of buckets of all keys together. A frame that has its ``BUCKET``
    already (by the same keys and time) keeps it, so that sweeps over sweeps sketch their rows once.
    Rows without a time count before all others of their key, but are left out of the result, as are those with a null key.
    """
    keys = list(keys)
    exprs = dict(values) if isinstance(values, Mapping) else {v: F.col(v) for v in values}
    b = df if BUCKET in df.columns else with_bucket(df, keys, time_col, buckets)
    if SPLIT not in b.columns:
        b = b.withColumn(SPLIT, F.lit(True))
    for c in (*keys, BUCKET):
        b = b.where(F.col(c).isNotNull())
    aggs = [F.sum(e).alias(f"_tot_{v}") for v, e in exprs.items()] + [F.min(time_col).alias("_first_t")]
    totals = b.where(SPLIT).groupBy(*keys, BUCKET).agg(*aggs)
    whole = Window.partitionBy(*keys)
    wb = whole.orderBy(BUCKET)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        BUCKET,
        *[F.sum(f"_tot_{v}").over(before).alias(f"_base_{v}") for v in exprs],
        *[F.sum(f"_tot_{v}").over(whole).alias(f"_all_{v}") for v in (exprs if total_suffix else ())],
        F.lead("_first_t").over(wb).alias("_next_bucket_t"),
        F.count(F.lit(1)).over(whole).alias("_n_buckets"),
    ).where(F.col("_n_buckets") > 1)
    # a key in several buckets has a border for each but one of them, so these are few
    j = b.join(totals.hint("shuffle_hash"), [*keys, BUCKET], "left")
    group = Window.partitionBy(*keys, BUCKET)
    w = group.orderBy(time_col, *tiebreak)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0)
    cols = [(F.coalesce(F.col(f"_base_{v}"), zero) + F.sum(e).over(upto)).alias(f"{v}{suffix}") for v, e in exprs.items()]
    if total_suffix:
        cols += [F.coalesce(F.col(f"_all_{v}"), F.sum(e).over(group)).alias(f"{v}{total_suffix}") for v, e in exprs.items()]
    if next_time:
        cols.append(F.coalesce(F.lead(time_col).over(w), F.col("_next_bucket_t")).alias(next_time))
    return j.select(*df.columns, *cols).where(F.col(time_col).isNotNull())
