"""The last value that is not null: as an aggregate, as a running fill, and as one over ranges of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import written


def last_non_null(value: Column, order: Column) -> Column:
    """Aggregate: the value with the highest order among those that are not null."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def fill_forward(value: Column, window: WindowSpec) -> Column:
    """Window: each row's value, or the last one before it that is not null."""
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def filled_forward(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: each row's value or, within its key and over all of the order, the last one before it that is
    not null. A prefix scan: rows are sorted by ranges of key and order, each range is filled by itself, and what it leaves
    is carried into the next ranges of its key. So a busy key is as many tasks' work as it has ranges; the window over what is
    carried has a row for each range and key. Null keys are one key; rows that are equal in key and order come in any order
    of their own.
    """
    place = df.withColumn("_value", value).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    laid = written(place.withColumn("_at", F.monotonically_increasing_id()), "filled").withColumn("_part", F.shiftright("_at", 33))
    within = laid.withColumn("_here", fill_forward(F.col("_value"), Window.partitionBy(key, "_part").orderBy("_at")))
    left = laid.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_range")).agg(last_non_null(F.col("_value"), F.col("_at")).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("_key", "_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    met = within.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range")), "left")
    return met.select(*df.columns, F.coalesce("_here", "_carried").alias(name))
