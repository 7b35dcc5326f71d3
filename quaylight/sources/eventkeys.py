"""The keys of a store's events, as digests in a table that is bucketed by them.

A load meets all that a store has of its days, and of that only keys: 128 bits each, with the event's rec_id. The table is
partitioned by data set and period (32 days, so that small loads add few files) and bucketed by the digest, so its side of
the join is read where it lies; only the load's keys are shuffled. A digest that is met is no proof: the event that it names is looked up and the whole key compared, so
neither chance nor keys of loads that failed or of deleted events can take a record for a duplicate.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..scratch import exists, written

#: Buckets of a period, given when the table is made: as many tasks read a period, so some million keys each serve.
BUCKETS = 16
#: So many hits are looked up before all are.
_FEW = 1000
_COLUMNS = "high bigint, low bigint, rec_id bigint, day bigint, dataset string, period bigint"


def period_of(day: Column) -> Column:
    return F.shiftright(day, 5)


def digested(events: DataFrame) -> DataFrame:
    """high, low (the digest of an event's key), rec_id, day, dataset, period."""
    return events.select(F.xxhash64("dataset", *S.EVENT_KEY).alias("high"), F.xxhash64(F.lit(1), "dataset", *S.EVENT_KEY).alias("low"), "rec_id", "day", "dataset", period_of(F.col("day")).alias("period"))


def table(spark: SparkSession, store: str) -> str:
    """The name of the store's key table in the session's catalog, which knows it by the folder ``keys``."""
    name = "keys_" + hashlib.sha256(store.rstrip("/").encode()).hexdigest()[:24]
    if not spark.catalog.tableExists(name):
        made = exists(spark, f"{store}/keys")
        spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet PARTITIONED BY (dataset, period) CLUSTERED BY (high, low) SORTED BY (high, low) INTO {BUCKETS} BUCKETS LOCATION '{store}/keys'")
        if made:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return name


def add(events: DataFrame, store: str) -> None:
    """Append the keys of events. A task writes whole buckets, so a load adds one file for each bucket and period at most."""
    spark = events.sparkSession
    name = table(spark, store)
    laid = digested(events).repartition(BUCKETS, "high", "low").sortWithinPartitions("dataset", "period", "high", "low")
    laid.write.insertInto(name)
    spark.catalog.refreshTable(name)


def met(events: DataFrame, store: str, days: list[int] | None) -> DataFrame:
    """(rec_id, old_id, dataset, day) where an event's digest is in the store; days (those of the events) bound what is read.
    The join is by the digest alone, as the buckets are; it covers data set and day."""
    spark = events.sparkSession
    stored = spark.table(table(spark, store))
    if days is not None:
        stored = stored.where(F.col("period").isin(sorted({d >> 5 for d in days})) & F.col("day").isin(days))
    old = stored.select("high", "low", F.col("rec_id").alias("old_id"), "dataset", "day").hint("merge")
    return digested(events).select("high", "low", "rec_id").join(old, ["high", "low"]).select("rec_id", "old_id", "dataset", "day")


def _held(events: DataFrame, store: str, days: list[int] | None) -> DataFrame | None:
    """(old_id, dataset, day) of the keys that the events' digests meet, once each; None if there is none."""
    if not exists(events.sparkSession, f"{store}/keys"):
        return None
    hits = written(met(events, store, days).select("old_id", "dataset", "day").distinct(), "key-hits")
    return None if hits.isEmpty() else hits  # none as for most loads; then no event of the store is read


def _of(stored: DataFrame, hits: DataFrame, days: list[int] | None) -> DataFrame:
    """rec_id, dataset, day and key of the ``stored`` events that were met; a key whose event is gone, or was never published, gives none."""
    if days is not None:
        stored = stored.where(F.col("day").isin(days))
    named = hits.withColumnRenamed("old_id", "rec_id")
    return stored.select("rec_id", "dataset", "day", *S.EVENT_KEY).join(named, ["rec_id", "dataset", "day"], "left_semi")


def known(events: DataFrame, store: str, stored: DataFrame, days: list[int] | None) -> DataFrame | None:
    """rec_id, dataset, day and key of the ``stored`` events of the store whose digests the events meet; None if there is none."""
    hits = _held(events, store, days)
    return None if hits is None else _of(stored, hits, days)


def any_known(events: DataFrame, store: str, stored: DataFrame, days: list[int] | None) -> bool:
    """Whether the whole key of an event is among the ``stored`` ones. One such event decides, so a few hits are looked up
    first, for which neither side is shuffled, and all of them only if none of these is the same event."""
    hits = _held(events, store, days)
    if hits is None:
        return False
    few, many = F.broadcast(hits.limit(_FEW)), hits.count() > _FEW
    if _same(events, F.broadcast(_of(stored, few, days))):
        return True
    return many and _same(events, _of(stored, hits, days))


def _same(events: DataFrame, old: DataFrame) -> bool:
    key = ["dataset", *S.EVENT_KEY]
    old = old.select(*(F.col(c).alias(f"_{c}") for c in key))
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return not events.select(*key).join(old, whole, "left_semi").isEmpty()


def any_equal(events: DataFrame) -> bool:
    """Whether two events have the same digest; if none have, no key comes twice."""
    return not digested(events).groupBy("high", "low").count().where("count > 1").isEmpty()


def any_new(events: DataFrame, store: str) -> bool:
    """Whether a digest of the events is not in the store, so that the store does not have the event itself."""
    spark = events.sparkSession
    if not exists(spark, f"{store}/keys"):
        return not events.isEmpty()
    stored = spark.table(table(spark, store)).select("high", "low").hint("merge")
    return not digested(events).select("high", "low").join(stored, ["high", "low"], "left_anti").isEmpty()
