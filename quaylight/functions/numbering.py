"""Consecutive numbers in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with the rows' numbers from 1, as long ``name``. Rows are sorted by ranges; a number is the place in the
    range after the sizes of the ranges before. The windows see a row for each range."""
    place = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranges = place.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return place.withColumn("_part", F.shiftright("_at", 33)).join(shifts, "_part").withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
