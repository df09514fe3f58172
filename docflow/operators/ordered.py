"""Order-dependent helpers that stay distributed when one key holds a large share of all rows.

A plain window sorts every row of a key in one task. Here each key is cut into order buckets first;
a window runs inside the buckets, and only one summary row per bucket is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(
    df: DataFrame, keys: list[str], order: str, values: list[str], bucket: Column, into: str = "prev"
) -> DataFrame:
    """Add ``into struct<values>``: the row before in ``order`` within ``keys``, null for the first."""
    row = F.struct(order, *[v for v in values if v != order])
    inner = Window.partitionBy(*keys, "_b").orderBy(order)
    cut = df.withColumn("_b", bucket).withColumn("_near", F.lag(row).over(inner))
    last = cut.groupBy(*keys, "_b").agg(F.max_by(row, F.col(order)).alias("_tail"))
    carry = last.select(
        *keys, "_b", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_b")).alias("_far")
    )
    joined = cut.join(carry, [*keys, "_b"], "left")
    return joined.withColumn(into, F.coalesce("_near", "_far")).drop("_b", "_near", "_far")


def with_row_index(df: DataFrame, keys: list[str], order: str, bucket: Column, into: str = "idx") -> DataFrame:
    """Add a zero-based running index per ``keys`` in ``order``."""
    inner = Window.partitionBy(*keys, "_b").orderBy(order)
    cut = df.withColumn("_b", bucket).withColumn("_near", F.row_number().over(inner) - 1)
    sizes = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = cut.join(starts, [*keys, "_b"])
    return joined.withColumn(into, F.col("_start") + F.col("_near")).drop("_b", "_near", "_start")


def turn_bucket(order: str, width: int = 1024) -> Column:
    return F.floor(F.col(order) / width)


def with_last_before(
    df: DataFrame, keys: list[str], order: str, value: Column, bucket: Column, into: str = "last"
) -> DataFrame:
    """Add the last non-null ``value`` among earlier rows of ``keys``, null when there is none."""
    earlier = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("_b", bucket).withColumn("_v", value)
    near = cut.withColumn("_near", F.last("_v", ignorenulls=True).over(earlier))
    tails = cut.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_tail"))
    buckets = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_b", F.last("_tail", ignorenulls=True).over(buckets).alias("_far"))
    joined = near.join(carry, [*keys, "_b"], "left")
    return joined.withColumn(into, F.coalesce("_near", "_far")).drop("_b", "_v", "_near", "_far")
