"""Loading event records: checks, fingerprints, and all-or-nothing publication.

A store is a folder with ``events`` (Parquet by load_id, attempt, dataset and day), ``loads`` (one row for each load that
succeeded) and ``deleted`` (instruments whose events up to a rec_id are gone). A load writes a partition of its own
first and its row in ``loads`` last; readers take only attempts that have a row. Nothing that fails or is retried can
show, or take away another load's rows. A store has one writer at a time, held to by the file ``writer``: a second load is
told that the store is busy before it reads or writes anything, so ids and duplicate checks never meet half a load. A
load that was taken over in the meantime fails before it publishes.

``compact`` rewrites days that have many files or deleted events into ``compacted``. Which days are read from there, and
up to which rec_id, stands in one small table a version, which readers see all at once (``folders.publish``).

``keys`` has a 128-bit digest of each event's key, bucketed by it, so that a load is compared with a store that does not
move; see ``eventkeys``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.book import book_hash
from ..functions.timeutil import day_of
from ..scratch import exists, written
from ..sources import eventkeys
from ..sources.folders import Busy, Lock, names, only_writer, publish, published, remove, withdraw

__all__ = ["Busy", "only_writer"]
RECORD_TYPE = "mbp-1"
#: ``top`` is the highest rec_id of the load (its mark, if it has no rows).
_LOADS = "load_id string, attempt string, mark bigint, top bigint, n_rows bigint, loaded_at timestamp"
_DELETED = "dataset string, instrument_id bigint, upto bigint"
#: Days that are read from a compacted part: their events up to ``upto`` are there, all later ones in ``events``.
_MANIFEST = "dataset string, day bigint, part string, upto bigint"
_EVENTS = T.StructType([*S.MBP.fields, T.StructField("attempt", T.StringType())])
_COMPACTED = T.StructType([*S.MBP.fields, T.StructField("part", T.StringType())])
#: A load of more days than this is compared with all of the store.
MOST_DAYS = 20_000


class Rejected(ValueError):
    """A load that breaks a rule; nothing of it is published."""


@dataclass(frozen=True)
class LoadSummary:
    load_id: str
    mark: int  #: the highest rec_id before the load
    n_rows: int
    n_dropped: int
    status: str
    n_rejected: int = 0  #: lines that were no records (of a CSV load)


def csv_schema(depth: int) -> T.StructType:
    """A line of CSV: the columns of a raw record, its levels as columns bid_px_00, ask_px_00, ... of ``depth`` levels."""
    flat = [f for f in S.RAW.fields if f.name != "levels"]
    sides = [T.StructField(f"{c}_{d:02d}", T.LongType()) for d in range(depth) for c in S.BOOK]
    return T.StructType([*flat, *sides, T.StructField("_line", T.StringType())])


def read_csv(spark: SparkSession, path: str, depth: int = 1, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of CSV files. Fields that do not parse, and lines with too few or too many, make a line
    rejected, as does a missing instrument_id, ts_recv, price, size or action; no good line is lost with it. Levels of which no
    field is given are absent. Lines are parsed once."""
    kind = csv_schema(depth)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "header": str(header), "enforceSchema": "true"}
    parsed = written(spark.read.schema(kind).options(**options).csv(path), "csv")
    whole = F.col("_line").isNull()
    for c in ("instrument_id", "ts_recv", "price", "size", "action"):
        whole = whole & F.col(c).isNotNull()
    level = [F.struct(F.lit(d).alias("depth"), *(F.col(f"{c}_{d:02d}").alias(c) for c in S.LEVEL.names[1:])) for d in range(depth)]
    given = F.filter(F.array(*level), lambda v: F.coalesce(*(v[c] for c in S.BOOK)).isNotNull()).cast(S.LEVELS)
    records = parsed.where(whole).select(*(f.name for f in S.RAW.fields if f.name != "levels"), given.alias("levels"))
    return records, parsed.where(~whole).drop("_line")


def load_csv(spark: SparkSession, path: str, store: str, instruments: DataFrame, load_id: str, duplicates: str = "error", depth: int = 1, most_rejected: int | None = None) -> LoadSummary:
    """``bulk_load`` of CSV files. The summary counts rejected lines; more than ``most_rejected`` reject the load."""
    records, rejected = read_csv(spark, path, depth)
    n = rejected.count()
    if most_rejected is not None and n > most_rejected:
        raise Rejected(f"{n} lines are no records")
    return replace(bulk_load(records, store, instruments, load_id, duplicates), n_rejected=n)


def read_records(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Arriving records as a DataFrame of the raw schema (Parquet or JSON lines)."""
    return spark.read.format(file_format).schema(S.RAW).load(path)


def wrong_types(raw: DataFrame) -> DataFrame:
    return raw.where(~F.col("rtype").eqNullSafe(RECORD_TYPE))


def prepare(raw: DataFrame, load_id: str, mark: int, arrival: Column | None = None) -> DataFrame:
    """Raw records → events: ids above the mark in order of arrival, the book's fingerprint, the day. Records arrive as they are
    read, unless ``arrival`` numbers them from 0."""
    return (
        raw.withColumn("rec_id", (F.monotonically_increasing_id() if arrival is None else arrival) + mark + 1)
        .withColumn("order_book_hash", book_hash(F.coalesce("levels", F.array().cast(S.LEVELS))))
        .withColumn("day", day_of("ts_recv"))
        .withColumn("load_id", F.lit(load_id))
        .select(*S.MBP.names)
    )


def duplicate_keys(events: DataFrame) -> DataFrame:
    """Event keys that come more than once, and how often."""
    return events.groupBy("dataset", *S.EVENT_KEY).agg(F.count("*").alias("n")).where("n > 1")


def _any_twice(events: DataFrame) -> bool:
    """Whether there are ``duplicate_keys``; whole keys are compared only if digests are equal."""
    return eventkeys.any_equal(events) and not duplicate_keys(events).isEmpty()


def days_of(events: DataFrame) -> list[int] | None:
    """The days of a load: a calendar's worth at most; None if there are too many to name."""
    days = [r.day for r in events.select("day").distinct().limit(MOST_DAYS + 1).collect()]
    return days if len(days) <= MOST_DAYS else None


def against_store(events: DataFrame, store: DataFrame, how: str = "left_semi", days: list[int] | None = None) -> DataFrame:
    """Events that the store holds already (left_semi), or that it does not (left_anti). With ``days``, those of the
    events, only these partitions of the store are read."""
    if days is not None:
        store = store.where(F.col("day").isin(days))
    return events.join(store.select("dataset", "day", *S.EVENT_KEY), ["dataset", "day", *S.EVENT_KEY], how)


def orphans(events: DataFrame, instruments: DataFrame) -> DataFrame:
    """Events of instruments that their data set does not know."""
    return events.join(instruments.select("dataset", "instrument_id"), ["dataset", "instrument_id"], "left_anti")


def drop_duplicates(events: DataFrame, dealt: bool = False) -> DataFrame:
    """The first arrival of each event key: events meet by their keys in one exchange, and of each key the row with the least id
    stays. With ``dealt``, equal events lie in one partition already (by any columns of the key), and none is moved.

    Events are read once and written nowhere but in the exchange. Ids that hang on how they were read are those of that reading,
    so a result that is needed twice is to be written.

    The fingerprint is half of an event: it is kept as bytes, or as it is where it isn't lower-case hex, and the exchange goes
    by the rest of the key. Equal rest is nearly always an equal event; of others the whole key still tells."""
    small = _packed(events)
    rest = ["sequence", *(c for c in ("dataset", *S.EVENT_KEY) if c not in ("sequence", "order_book_hash"))]
    arrival = Window.partitionBy(*rest, "order_book_hash", "_bytes").orderBy("rec_id")
    first = (small if dealt else small.repartition(*rest)).withColumn("_at", F.row_number().over(arrival)).where("_at = 1")
    return _unpacked(first).select(*events.columns)


def _packed(events: DataFrame) -> DataFrame:
    """The fingerprint as ``_bytes`` where it is lower-case hex; else it stays as it is."""
    hexed = F.coalesce(F.col("order_book_hash").rlike(r"\A[0-9a-f]*\z") & (F.length("order_book_hash") % 2 == 0), F.lit(False))
    return events.withColumn("_bytes", F.when(hexed, F.unhex("order_book_hash"))).withColumn("order_book_hash", F.when(~hexed, F.col("order_book_hash")))


def _unpacked(events: DataFrame) -> DataFrame:
    return events.withColumn("order_book_hash", F.coalesce("order_book_hash", F.lower(F.hex("_bytes")))).drop("_bytes")


#: How a load's events lie: by ranges of day, instrument and time, so that a busy day is several tasks' work and files skip well.
_PLACE = ["dataset", "day", "instrument_id", "ts_recv"]


def _laid(packed: DataFrame) -> DataFrame:
    return _unpacked(packed.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE))


def _laid_firsts(packed: DataFrame, held: DataFrame | None) -> DataFrame:
    """``_laid``, with the first arrival of each event key only, and none whose key is among the ``held`` ones of the store.

    Equal events have one place, so the ranges that the events are laid out by bring them together, too, and the store's
    keys, whose ids are lower, come along: all rows move once, and the order of the window begins as that of the files."""
    rows = packed.withColumn("_held", F.lit(False))
    if held is not None:
        rows = rows.unionByName(_packed(held).withColumn("_held", F.lit(True)), allowMissingColumns=True)
    arrival = Window.partitionBy(*_PLACE, *(c for c in S.EVENT_KEY if c not in _PLACE), "_bytes").orderBy("rec_id")
    first = rows.repartitionByRange(*_PLACE).withColumn("_at", F.row_number().over(arrival)).where("_at = 1 AND NOT _held")
    return _unpacked(first.drop("_at", "_held")).sortWithinPartitions(*_PLACE)


def high_water_mark(store: DataFrame, dataset: str | None = None) -> DataFrame:
    """The highest rec_id, 0 in an empty store."""
    rows = store if dataset is None else store.where(F.col("dataset") == dataset)
    return rows.agg(F.coalesce(F.max("rec_id"), F.lit(0)).alias("mark"))


def loads(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/loads"
    return spark.read.schema(_LOADS).parquet(path) if exists(spark, path) else spark.createDataFrame([], _LOADS)


def store_mark(spark: SparkSession, store: str) -> int:
    """The highest rec_id of the store, from the rows of its loads; no event is read."""
    return loads(spark, store).agg(F.coalesce(F.max("top"), F.lit(0))).first()[0]


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """The compacted days that readers take now."""
    versions = published(spark, store)
    return spark.read.schema(_MANIFEST).parquet(f"{store}/manifests/{versions[-1][1]}") if versions else spark.createDataFrame([], _MANIFEST)


def tombstones(spark: SparkSession, store: str, erased: bool = False) -> DataFrame:
    """Deleted instruments and up to which rec_id; with ``erased`` also those whose events are no longer in any file."""
    paths = [p for p in (f"{store}/deleted", *([f"{store}/erased"] if erased else [])) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], _DELETED)
    return spark.read.schema(_DELETED).parquet(*paths).groupBy("dataset", "instrument_id").agg(F.max("upto").alias("upto"))


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """Events of the loads that succeeded, deleted ones too."""
    path = f"{store}/events"
    if not exists(spark, path):
        return spark.createDataFrame([], S.MBP)
    done = loads(spark, store).select("load_id", "attempt").distinct()
    found = spark.read.schema(_EVENTS).parquet(path).join(done, ["load_id", "attempt"], "left_semi")
    if not published(spark, store):
        return found.select(*S.MBP.names)
    days = manifest(spark, store)
    later = found.join(days.select("dataset", "day", F.col("upto").alias("_upto")), ["dataset", "day"], "left").where("_upto IS NULL OR rec_id > _upto")
    merged = f"{store}/compacted"
    if not exists(spark, merged):
        return later.select(*S.MBP.names)
    kept = spark.read.schema(_COMPACTED).parquet(merged).join(days, ["part", "dataset", "day"], "left_semi")
    return later.select(*S.MBP.names).unionByName(kept.select(*S.MBP.names))


def _gone(events: DataFrame, spark: SparkSession, store: str, how: str) -> DataFrame:
    """Events that are deleted (left_semi) or not (left_anti)."""
    gone = tombstones(spark, store).withColumnsRenamed({"dataset": "d", "instrument_id": "i"})
    return events.join(gone, (F.col("dataset") == F.col("d")) & (F.col("instrument_id") == F.col("i")) & (F.col("rec_id") <= F.col("upto")), how)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Events of the loads that succeeded, without those of deleted instruments."""
    found = _stored(spark, store)
    return _gone(found, spark, store, "left_anti").select(*S.MBP.names) if exists(spark, f"{store}/deleted") else found


def delete_events(spark: SparkSession, store: str, ids: DataFrame) -> None:
    """Delete all events that the store has now of the instruments in ``ids`` (dataset, instrument_id). One small table is
    appended, no event is rewritten until ``compact``; the same instrument may be loaded again later."""
    with only_writer(spark, store, f"deletion {uuid.uuid4().hex}"):
        ids.select("dataset", "instrument_id").distinct().withColumn("upto", F.lit(store_mark(spark, store)).cast("long")).write.mode("append").parquet(f"{store}/deleted")


@dataclass(frozen=True)
class Compaction:
    """``days``: (dataset, day) partitions that were rewritten; files of all of the store before and after."""

    days: int
    files_before: int
    files_after: int
    n_rows: int
    n_erased: int


def _files(spark: SparkSession, store: str) -> Counter:
    """Files of each (dataset, day), by their names."""
    found = [f for p in ("events", "compacted") if exists(spark, f"{store}/{p}") for f in spark.read.schema(S.MBP).parquet(f"{store}/{p}").inputFiles()]
    return Counter((m[1], int(m[2])) for f in found if (m := re.search(r"/dataset=([^/]+)/day=(-?\d+)/", f)))


def _folders(spark: SparkSession, store: str) -> list[str]:
    """Folders that hold events by dataset and day: of attempts of loads, and of compacted parts."""
    loads_ = [f"{store}/events/{load}/{a}" for load in names(spark, f"{store}/events") if "=" in load for a in names(spark, f"{store}/events/{load}") if "=" in a]
    return loads_ + [f"{store}/compacted/{p}" for p in names(spark, f"{store}/compacted") if "=" in p]


def compact(spark: SparkSession, store: str, max_files: int = 8, records_per_file: int = 5_000_000) -> Compaction:
    """Take deleted events out of the files for good, and merge the files of each day that has more than ``max_files``.

    Only partitions (dataset, day) with deleted events or many files are read and rewritten, sorted by instrument and time
    as a load's are. They become visible all at once; then the files that they replace and the deletions, which have
    nothing left to delete, are taken away (deletions are kept in ``erased`` for those that follow the store). If it dies,
    readers see the store as before or as after, and the next run clears what is left. Readers that have planned a query
    before and run it afterwards may find their files gone. Days by day and file names pass the driver; no event does.
    """
    with only_writer(spark, store, f"compaction {uuid.uuid4().hex}") as lock:
        done = _compact(lock, store, max_files, records_per_file)
        _clear(lock, store)
        return done


def _compact(lock: Lock, store: str, max_files: int, records_per_file: int) -> Compaction:
    spark, files = lock.spark, _files(lock.spark, store)
    gone = _gone(_stored(spark, store).select("dataset", "day", "instrument_id", "rec_id"), spark, store, "left_semi")
    hit = {(r.dataset, r.day): r.n for r in gone.groupBy("dataset", "day").agg(F.count("*").alias("n")).collect()} if exists(spark, f"{store}/deleted") else {}
    chosen = sorted({k for k, n in files.items() if n > max_files} | set(hit))
    total = sum(files.values())
    if not chosen:
        return Compaction(0, total, total, 0, 0)
    part, mark = uuid.uuid4().hex, store_mark(spark, store)
    days = spark.createDataFrame(chosen, "dataset string, day long")
    events = read_store(spark, store).where(F.col("day").isin(sorted({d for _, d in chosen}))).join(days, ["dataset", "day"], "left_semi")
    place = ["dataset", "day", "instrument_id", "ts_recv"]
    path = f"{store}/compacted/part={part}"
    laid = events.repartitionByRange(*place).sortWithinPartitions(*place)
    laid.write.partitionBy("dataset", "day").option("maxRecordsPerFile", records_per_file).parquet(path)
    new = days.select("dataset", "day", F.lit(part).alias("part"), F.lit(mark).cast("long").alias("upto"))
    manifest(spark, store).join(days, ["dataset", "day"], "left_anti").unionByName(new).coalesce(1).write.parquet(f"{store}/manifests/{part}")
    publish(lock, part)
    kept = spark.read.schema(S.MBP).parquet(path)
    after = total - sum(files[k] for k in chosen) + len(kept.inputFiles())
    return Compaction(len(chosen), total, after, kept.count(), sum(hit.values()))


def _clear(lock: Lock, store: str) -> None:
    """Take away what no reader of the newest version needs; deletions once every day that they meet is rewritten."""
    spark, versions = lock.spark, published(lock.spark, store)
    if not versions:
        return
    current = manifest(spark, store).collect()
    for folder in _folders(spark, store):
        part = re.search(r"/compacted/part=([^/]+)$", folder)
        for r in current:
            if part is None or part[1] != r.part:
                remove(spark, f"{folder}/dataset={r.dataset}/day={r.day}")
        if part and part[1] not in {r.part for r in current}:
            remove(spark, folder)
    for number, name in versions[:-1]:
        withdraw(spark, store, number, name)
        remove(spark, f"{store}/manifests/{name}")
    if exists(spark, f"{store}/deleted") and _gone(_stored(spark, store), spark, store, "left_semi").isEmpty():
        tombstones(spark, store).coalesce(1).write.mode("append").parquet(f"{store}/erased")
        remove(spark, f"{store}/deleted")


def roll_back(spark: SparkSession, store: str, load_id: str, attempt: str | None = None) -> None:
    """Take away what a load wrote, or one attempt at it; other loads' files are not touched."""
    remove(spark, f"{store}/events/load_id={load_id}" + (f"/attempt={attempt}" if attempt else ""))


def bulk_load(raw: DataFrame, store: str, instruments: DataFrame, load_id: str, duplicates: str = "error", records_per_file: int = 5_000_000) -> LoadSummary:
    """Check, write and publish one load.

    Records of another type, of unknown instruments, or (``duplicates="error"``) that come twice or are in the
    store already reject the whole load; with ``duplicates="drop"`` the first arrival stays. A load_id that was
    published before is done already, so repeating a load changes nothing. While another load writes, this one is Busy.

    Of the store only ``loads`` and the keys of the load's own days are read, and events only where keys meet.
    """
    if duplicates not in ("error", "drop"):
        raise ValueError("duplicates is error or drop")
    spark = raw.sparkSession
    with only_writer(spark, store, load_id) as lock:
        return _load(lock, raw, store, instruments, load_id, duplicates, records_per_file)


def _load(lock: Lock, raw: DataFrame, store: str, instruments: DataFrame, load_id: str, duplicates: str, records_per_file: int) -> LoadSummary:
    spark, attempt = raw.sparkSession, lock.token
    done = loads(spark, store).where(F.col("load_id") == load_id).first()
    if done:
        return LoadSummary(load_id, done.mark, done.n_rows, 0, "done before")
    mark, stored = store_mark(spark, store), read_store(spark, store)
    if not wrong_types(raw).isEmpty():
        raise Rejected(f"only records of type {RECORD_TYPE} are accepted")
    part = f"{store}/events/load_id={load_id}/attempt={attempt}"
    events = prepare(raw, load_id, mark).drop("load_id")
    # An event of an unknown instrument rejects the load, unless it is dropped because the store has it; few are asked
    # for that, and before anything is written.
    unknown = not orphans(raw.select("dataset", "instrument_id").distinct(), instruments).isEmpty()
    if unknown and (duplicates == "error" or eventkeys.any_new(orphans(events, instruments), store)):
        raise Rejected("events of unknown instruments")
    if duplicates == "drop":
        arrived = written(_packed(events), "arrived", "zstd")
        whole = _unpacked(arrived)
        laid = _laid_firsts(arrived, eventkeys.known(whole, store, stored, days_of(arrived)))
    else:
        laid = _laid(_packed(events))
    laid.write.mode("overwrite").partitionBy("dataset", "day").option("maxRecordsPerFile", records_per_file).parquet(part)
    # The checks read what was written: ids and fingerprints are made once, and a rejected load takes its files along.
    mine = spark.read.schema(S.MBP).option("basePath", f"{store}/events").parquet(part)
    try:
        if unknown and not orphans(mine, instruments).isEmpty():
            raise Rejected("events of unknown instruments")
        if duplicates == "error" and (_any_twice(mine) or eventkeys.any_known(mine, store, stored, days_of(mine))):
            raise Rejected("events that exist already or come twice")
        n, top = mine.agg(F.count("*"), F.coalesce(F.max("rec_id"), F.lit(mark))).first()
    except Rejected:
        roll_back(spark, store, load_id, attempt)
        raise
    n_arrived = arrived.count() if duplicates == "drop" else n
    # First the keys, so that no published event lacks its own; keys without an event do no harm.
    eventkeys.add(mine, store)
    row = spark.createDataFrame([(load_id, attempt, mark, top, n)], "load_id string, attempt string, mark bigint, top bigint, n_rows bigint").withColumn("loaded_at", F.current_timestamp())
    lock.check()
    row.coalesce(1).write.mode("append").parquet(f"{store}/loads")
    for other in names(spark, f"{store}/events/load_id={load_id}"):
        if other.startswith("attempt=") and other != f"attempt={attempt}":
            roll_back(spark, store, load_id, other.removeprefix("attempt="))
    return LoadSummary(load_id, mark, n, n_arrived - n, "success")
