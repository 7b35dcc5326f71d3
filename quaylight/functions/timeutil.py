"""Nanosecond arithmetic in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY


def _div(c: Column | str, n: int) -> Column:
    return F.call_function("div", F.col(c) if isinstance(c, str) else c, F.lit(n).cast("bigint"))


def bucket_start(t: Column | str, interval: int) -> Column:
    """Start of the bucket [k I, (k + 1) I) that holds t."""
    return _div(t, interval) * interval


def bucket_end(t: Column | str, interval: int) -> Column:
    """End of the right-closed bucket (k I, (k + 1) I] that holds t; exact at and just after a boundary."""
    t = F.col(t) if isinstance(t, str) else t
    return (_div(t - 1, interval) + 1) * interval


def day_of(t: Column | str) -> Column:
    return _div(t, DAY)


def floor_day(t: int) -> int:
    return t - t % DAY


def end_of_day(t: int) -> int:
    return floor_day(t) + DAY


def time_range(events: DataFrame, start: int, end: int) -> DataFrame:
    """Events with start <= ts_recv <= end. The predicate on ``day`` lets Spark skip whole partitions."""
    return events.where(F.col("day").between(start // DAY, end // DAY) & F.col("ts_recv").between(start, end))


def display_time(t: Column | str) -> Column:
    """A timestamp for reading, cut to microseconds."""
    return F.timestamp_micros(_div(t, 1000))
