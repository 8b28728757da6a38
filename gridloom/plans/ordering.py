"""Gapless numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import cut


def dense_order(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``: the number of each row from 0 in the order given.

    Rows are sorted by ranges, each range is numbered where it lies, and only
    the sizes of the ranges meet.
    """
    part, at = f"{name}__part", f"{name}__at"
    ranged = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at))
    )
    sizes = ranged.groupBy(part).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(part, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(F.broadcast(shifts), part).select(*df.columns, (F.col(at) + F.col("shift")).alias(name))  # a row for each partition
