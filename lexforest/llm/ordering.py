"""Ranks and running totals in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

#: monotonically_increasing_id keeps the partition above and the row below this bit.
ROW_BITS = 33


def globally_sorted(scratch: Scratch, df: DataFrame, keys: list) -> DataFrame:
    """df dealt out by ranges of keys, sorted, and written with __part and __row (its place there).

    The last keys must tell rows apart, so that no range grows with a frequent value.
    """
    n = shuffle_partitions(df.sparkSession)
    at = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", at)
    out = out.select("*", F.shiftright("__at", ROW_BITS).alias("__part"), F.col("__at").bitwiseAND((1 << ROW_BITS) - 1).alias("__row")).drop("__at")
    return scratch.save(out)


def part_offsets(df: DataFrame, value, kind: str = "long") -> DataFrame:
    """__part, __before (sum of value over the ranges before it) and __total; a row a range."""
    per = df.groupBy("__part").agg(F.sum(value).cast(kind).alias("__own"))
    # as many rows as shuffle partitions, whatever the input
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.select("__part", F.coalesce(F.sum("__own").over(w), F.lit(0).cast(kind)).alias("__before"), F.sum("__own").over(everything).alias("__total"))


def ranked(df: DataFrame) -> DataFrame:
    """Adds __rank (from 0 in the global order) and __total rows to what globally_sorted wrote."""
    return df.join(F.broadcast(part_offsets(df, F.lit(1))), "__part").withColumn("__rank", F.col("__before") + F.col("__row"))


def running(df: DataFrame, value: str, kind: str = "long") -> DataFrame:
    """Adds __upto, the sum of value up to and with the row in the global order, and __total, that of all rows."""
    w = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("__own_upto", F.sum(value).over(w))
    return own.join(F.broadcast(part_offsets(df, F.col(value), kind)), "__part").withColumn("__upto", F.col("__before") + F.col("__own_upto"))
