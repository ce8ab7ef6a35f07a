"""Distributed positions in a total order.

A window without partition keys sorts everything in one task. Here rows are range
partitioned instead: each range is numbered on its own and shifted by the size of
the ranges before it. The only table that grows with nothing but the number of
ranges is the table of range totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from entitynet.session import cut


def ordered_prefix(
    df: DataFrame,
    order: list[Column],
    weight: Column | None = None,
    by: list[str] | None = None,
    name: str = "prefix",
) -> DataFrame:
    """Add ``name`` = total weight of the rows strictly before this one, per ``by``.

    ``order`` must be a total order within ``by``; without ``weight`` the result is
    a zero-based row number. The range number is written out before it is used, so
    a retried task cannot see other ranges than the first attempt did.
    """
    by = by or []
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weight = F.lit(1).cast("bigint") if weight is None else weight
    ranged = cut(
        df.withColumn("_w", weight)
        .repartitionByRange(ranges, *[F.col(c) for c in by], *order)
        .withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        *by, "_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = F.coalesce(F.sum("_w").over(inside), F.lit(0))
    keys = [*by, "_range"]
    return (
        ranged.withColumn("_local", local)
        .join(shift, keys)
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .drop("_w", "_range", "_local", "_shift")
    )
