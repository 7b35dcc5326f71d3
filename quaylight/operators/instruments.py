"""The instrument dimension, maintained by sets of changes: each function takes tables and returns tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbering import numbered


class Conflict(ValueError):
    """A change that would break the dimension's rules."""


def create_instruments(dim: DataFrame, new: DataFrame, namesakes: bool = False) -> DataFrame:
    """Add instruments (columns as in the dimension, without ids) under the next free ids, in order of data set and
    ticker. Ids are unique over all data sets, tickers within one; a ticker that exists or comes twice is a Conflict.
    With ``namesakes``, for sources whose names are no key, one that comes twice (or is null) is an
    instrument for each of its rows; nulls are numbered last."""
    key = ["dataset", "ticker"]
    bad = new.join(dim, key, "left_semi").select(*key)
    if not namesakes:
        bad = bad.unionByName(new.groupBy(*key).count().where("count > 1").select(*key))
    taken = bad.limit(5).collect()
    if taken:
        raise Conflict(f"tickers exist already or come twice: {[tuple(r) for r in taken]}")
    top = dim.agg(F.coalesce(F.max("instrument_id"), F.lit(0)).alias("top"))
    added = numbered(new, ["dataset", F.asc_nulls_last("ticker")], "n").crossJoin(F.broadcast(top)).withColumn("instrument_id", F.col("top") + F.col("n"))  # one row
    return dim.unionByName(added.select(*dim.columns))


def find_instruments(dim: DataFrame, dataset: str | None = None, **filters) -> DataFrame:
    """By any columns: ticker, instrument_id, vendor, active and so on; a list means any of its values."""
    found = dim if dataset is None else dim.where(F.col("dataset") == dataset)
    for name, value in filters.items():
        test: Column = F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set, range)) else F.col(name).eqNullSafe(F.lit(value))
        found = found.where(test)
    return found


def update_instruments(dim: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace rows by id with all attributes of ``changes``; an id that does not exist is a Conflict."""
    missing = changes.join(dim, "instrument_id", "left_anti").select("instrument_id").limit(5).collect()
    if missing:
        raise Conflict(f"no such instruments: {[r[0] for r in missing]}")
    return dim.join(changes, "instrument_id", "left_anti").unionByName(changes.select(*dim.columns))


def delete_instruments(dim: DataFrame, mbp: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the instruments in ``ids`` (instrument_id), and without their events and levels."""
    return dim.join(ids, "instrument_id", "left_anti"), mbp.join(ids, "instrument_id", "left_anti")


def affected_days(mbp: DataFrame, ids: DataFrame) -> DataFrame:
    """The partitions that a deletion has to rewrite."""
    return mbp.join(ids, "instrument_id", "left_semi").select("dataset", "day").distinct()


def dataset_code(dataset: Column) -> Column:
    """The number of a data set's name."""
    return F.create_map(*(F.lit(x) for pair in S.DATASET_CODES.items() for x in pair))[dataset]
