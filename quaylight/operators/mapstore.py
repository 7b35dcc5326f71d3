"""The stored continuous map, kept up with an event store by recomputing only from the first day that changed.

A map store is a folder. ``map`` holds map rows and ``volumes`` the daily volumes that the ranks go by, both in parts, each
written once and never changed. A version (one small row, published at once by ``folders.publish``) says of which parts the map
is made and for which days each counts, so a refresh adds parts for the changed days and leaves all older files alone.
What a day needs of the days before it is little, and stored: the last contract of each continuous symbol, for rollovers,
and the last two volumes of each contract, for the ranks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..scratch import exists
from ..sources.folders import Lock, names, only_writer, publish, published, remove, withdraw
from . import continuous, ingest

#: Beyond this number of parts a refresh writes all of the map as one part (it is a few rows a day and symbol).
MOST_PARTS = 64
#: ``first_rec`` is the least rec_id among the events of the row.
VOLUMES = S.columns("instrument_id bigint, ts_event bigint, daily_volume bigint, first_rec bigint")
_PARTS = T.ArrayType(S.columns("part string, from_day bigint, to_day bigint"))
#: ``seen``: the store's highest rec_id that is in the map. ``dimension``: a digest of the instruments it was made with.
_VERSION = S.columns("parts parts, seen bigint, dimension string, root_len int", parts=_PARTS)
_EVER = (-(1 << 62), 1 << 62)


@dataclass(frozen=True)
class Version:
    """``parts``: (part, from_day, to_day); a part counts for ts_day from from_day up to, and without, to_day."""

    parts: tuple[tuple[str, int, int], ...]
    seen: int
    dimension: str
    root_len: int
    number: int = 0


@dataclass(frozen=True)
class Refreshed:
    """``from_day``: the first day that was computed anew (None if nothing had changed); ``number`` of the version."""

    number: int
    from_day: int | None


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest version, if there is one."""
    versions = published(spark, path)
    if not versions:
        return None
    r = spark.read.schema(_VERSION).parquet(f"{path}/versions/{versions[-1][1]}").first()
    return Version(tuple((p.part, p.from_day, p.to_day) for p in r.parts), r.seen, r.dimension, r.root_len, versions[-1][0])


def _read(spark: SparkSession, path: str, table: str, day: str, kind: T.StructType, version: Version) -> DataFrame:
    """The version's rows of a table; folders of its parts only, and of each only its days."""
    folders = [p for part, _, _ in version.parts if exists(spark, p := f"{path}/{table}/part={part}")]
    if not folders:
        return spark.createDataFrame([], kind)
    counts = F.lit(False)
    for part, lo, hi in version.parts:
        counts = counts | ((F.col("part") == part) & (F.col(day) >= lo) & (F.col(day) < hi))
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField("part", T.StringType())])).option("basePath", f"{path}/{table}").parquet(*folders)
    return rows.where(counts).select(*kind.names)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The map of the newest version; readers of an older one go on reading that."""
    version = current(spark, path)
    return spark.createDataFrame([], S.CONTINUOUS_MAP) if version is None else _read(spark, path, "map", "ts_day", S.CONTINUOUS_MAP, version)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    version = current(spark, path)
    return spark.createDataFrame([], VOLUMES) if version is None else _read(spark, path, "volumes", "ts_event", VOLUMES, version)


def dimension_digest(instruments: DataFrame) -> str:
    """Changes with any futures instrument; the order of rows is of no matter."""
    rows = instruments.where("dataset = 'futures'").select("instrument_id", "ticker", "expiration_date", "is_continuous")
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def _changed_from(spark: SparkSession, store: str, version: Version, volumes: DataFrame) -> int | None:
    """The first day (as ts_day) whose events are not those that the version has seen; None if there is none. Of loads
    since then partition values are read, and of deletions the stored volumes that they were in."""
    new = ingest.loads(spark, store).where(F.col("top") > version.seen).select("load_id").distinct()
    stored = ingest.read_store(spark, store).where("dataset = 'futures'")
    loaded = stored.join(new, "load_id", "left_semi").agg(F.min("day")).first()[0]
    gone = ingest.tombstones(spark, store, erased=True).where("dataset = 'futures'").select("instrument_id", "upto")
    erased = volumes.join(gone, "instrument_id").where("first_rec <= upto").agg(F.min("ts_event")).first()[0]
    days = [d for d in (None if loaded is None else loaded * S.DAY, erased) if d is not None]
    return min(days) if days else None


def refresh_map(spark: SparkSession, store: str, instruments: DataFrame, path: str, root_len: int = 2) -> Refreshed:
    """Bring the map at ``path`` up to the event store and publish it as a new version.

    Only days from the first changed one on are computed (loads may come for days long past, and deletions count); of the store
    only these days are read. A change of the instruments may move any day's ranks, so it makes all days anew, as does another
    ``root_len``. Nothing new gives no new version. The result is that of a full build, whatever the steps. An empty store gives an
    empty map. One refresh at a time; if one dies, readers keep the version before.
    """
    with only_writer(spark, path, f"refresh {uuid.uuid4().hex}") as lock:
        version, dimension, seen = current(spark, path), dimension_digest(instruments), ingest.store_mark(spark, store)
        since, old = _EVER[0], Version((), 0, dimension, root_len)
        if version is not None and (version.dimension, version.root_len) == (dimension, root_len):
            old = version
            day = _changed_from(spark, store, version, _read(spark, path, "volumes", "ts_event", VOLUMES, version))
            if day is None:
                if version.seen != seen:  # loads without futures
                    return Refreshed(_publish(lock, path, replace(version, seen=seen)), None)
                return Refreshed(version.number, None)
            if len(version.parts) < MOST_PARTS:
                since = day
            else:
                old = Version((), 0, dimension, root_len)
        kept = tuple((p, lo, min(hi, since)) for p, lo, hi in old.parts if lo < since)
        before = replace(old, parts=kept)
        part = uuid.uuid4().hex
        _build(spark, ingest.read_store(spark, store), instruments, path, part, before, since, root_len)
        number = _publish(lock, path, Version((*kept, (part, since, _EVER[1])), seen, dimension, root_len))
        return Refreshed(number, since if kept else _first(spark, path))


def _first(spark: SparkSession, path: str) -> int | None:
    return read_map(spark, path).agg(F.min("ts_day")).first()[0]


def _publish(lock: Lock, path: str, version: Version) -> int:
    name = uuid.uuid4().hex
    row = [([tuple(p) for p in version.parts], version.seen, version.dimension, version.root_len)]
    lock.spark.createDataFrame(row, _VERSION).coalesce(1).write.parquet(f"{path}/versions/{name}")
    return publish(lock, name)


def _build(spark: SparkSession, mbp: DataFrame, instruments: DataFrame, path: str, part: str, before: Version, since: int, root_len: int) -> None:
    """Write the part with the volumes and map rows of all days from ``since`` on."""
    later = mbp.where((F.col("dataset") == "futures") & (F.col("day") >= since // S.DAY))
    volume = F.sum(F.when(F.col("action") == S.TRADE, F.col("size"))).alias("daily_volume")
    fresh = later.groupBy("instrument_id", (F.col("day") * S.DAY).alias("ts_event")).agg(volume, F.min("rec_id").alias("first_rec"))
    fresh.select(*VOLUMES.names).write.parquet(f"{path}/volumes/part={part}")
    fresh = spark.read.schema(VOLUMES).parquet(f"{path}/volumes/part={part}")
    old = _read(spark, path, "volumes", "ts_event", VOLUMES, before)

    # A contract's last two volumes before; a symbol's last contract before.
    lately = F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("ts_event")))
    carried = old.withColumn("lately", lately).where("lately <= 2").drop("lately")
    last = _read(spark, path, "map", "ts_day", S.CONTINUOUS_MAP, before).groupBy("continuous_ticker").agg(F.max_by("instrument_id", "ts_day").alias("instrument_id"), F.max("ts_day").alias("ts_day"))

    known = instruments.where("dataset = 'futures'")
    # Every day with events has volumes, if only of nothing.
    days = fresh.select(F.col("ts_event").alias("ts_day")).distinct()
    first = old.select("ts_event").unionByName(fresh.select("ts_event")).agg(F.min("ts_event")).scalar()
    wanted = (F.col("ts_event") >= since) & (F.col("ts_event") > first)
    by_date = continuous.calendar_symbols(continuous.calendar_ranks_of(days, known, root_len), known)
    by_volume = continuous.volume_symbols(continuous.volume_ranks_of(carried.unionByName(fresh), known, wanted, root_len), known)
    rows = continuous.with_rollover(by_date.unionByName(by_volume.select(*by_date.columns)), last)
    rows.sortWithinPartitions("ts_day", "continuous_ticker").write.parquet(f"{path}/map/part={part}")


def clear_map(spark: SparkSession, path: str, versions: int = 1) -> int:
    """Delete the parts that none of the last ``versions`` is made of; how many there were."""
    with only_writer(spark, path, f"clearing {uuid.uuid4().hex}"):
        every = published(spark, path)
        used: set[str] = set()
        for _, name in every[-versions:]:
            used |= {p.part for p in spark.read.schema(_VERSION).parquet(f"{path}/versions/{name}").first().parts}
        for number, name in every[:-versions]:
            withdraw(spark, path, number, name)
            remove(spark, f"{path}/versions/{name}")
        unused = {n.removeprefix("part=") for t in ("map", "volumes") for n in names(spark, f"{path}/{t}") if n.startswith("part=")} - used
        for part in unused:
            for table in ("map", "volumes"):
                remove(spark, f"{path}/{table}/part={part}")
        return len(unused)
