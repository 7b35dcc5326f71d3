"""Stores that are compacted, keys that are met where they lie, and writers that are taken over."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.operators import ingest
from quaylight.sources import eventkeys, folders
from quaylight.streaming.ingest_stream import record_stream, start_ingest

from . import fixtures as X


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame(X.FUTURES, S.INSTRUMENTS)


@pytest.fixture()
def store(tmp_path):
    return str(tmp_path / "store")


def records(spark, rows):
    return spark.createDataFrame(rows, S.RAW).coalesce(1)


def raw(i, day, n=0):
    return X.raw("futures", i, X.D1 + day * S.DAY + n, 1, 1)


def event_files(store):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for part in ("events", "compacted") for d, _, fs in os.walk(f"{store}/{part}") for f in fs if f.endswith(".parquet")}


def held(spark, store):
    return sorted((r.instrument_id, r.ts_recv - X.D1, r.load_id) for r in ingest.read_store(spark, store).collect())


def gone(spark, *ids):
    return spark.createDataFrame([("futures", i) for i in ids], "dataset string, instrument_id long")


def test_deleted_events_leave_the_files(spark, dim, store):
    ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 0), raw(2, 1), raw(2, 2), raw(3, 3)]), store, dim, "a")
    ingest.bulk_load(records(spark, [raw(1, 0, 5), raw(2, 4)]), store, dim, "b")
    ingest.delete_events(spark, store, gone(spark, 1))
    before, want = event_files(store), held(spark, store)
    done = ingest.compact(spark, store)
    assert (done.days, done.n_erased, done.n_rows) == (1, 2, 1)
    after = event_files(store)
    assert held(spark, store) == want
    # Other days' files are the same; no file has the events any more; nothing is left to delete.
    assert {f: t for f, t in before.items() if f"/day={X.D1 // S.DAY}/" not in f} == {f: t for f, t in after.items() if "compacted" not in f}
    assert all(spark.read.parquet(f).where("instrument_id = 1").isEmpty() for f in after)
    assert not os.path.exists(f"{store}/deleted") and [tuple(r)[:2] for r in ingest.tombstones(spark, store, erased=True).collect()] == [("futures", 1)]
    assert ingest.compact(spark, store).days == 0
    # They may come again, and are found then.
    assert ingest.bulk_load(records(spark, [raw(1, 0)]), store, dim, "c").n_rows == 1
    with pytest.raises(ingest.Rejected):
        ingest.bulk_load(records(spark, [raw(1, 0)]), store, dim, "d")
    assert held(spark, store) == sorted([*want, (1, 0, "c")])


def test_a_day_of_nothing_but_deleted_events(spark, dim, store):
    ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 1)]), store, dim, "a")
    ingest.delete_events(spark, store, gone(spark, 1))
    ingest.compact(spark, store)
    assert held(spark, store) == [(2, S.DAY, "a")] and ingest.compact(spark, store).days == 0
    ingest.delete_events(spark, store, gone(spark, 2))
    ingest.compact(spark, store)
    assert held(spark, store) == [] and not event_files(store)


def test_small_files_of_a_stream_are_merged(spark, dim, store, tmp_path):
    source = str(tmp_path / "in")
    for k in range(5):
        records(spark, [raw(1, 0, k), raw(2, 1, k)]).write.mode("append").parquet(source)
    start_ingest(record_stream(spark, source, files_per_batch=1), store, dim, str(tmp_path / "c")).awaitTermination()
    want = held(spark, store)
    assert len(event_files(store)) == 10 == len(want)
    done = ingest.compact(spark, store, max_files=4)
    assert (done.days, done.files_before, done.n_rows) == (2, 10, 10) and done.files_after == len(event_files(store)) <= 4
    assert held(spark, store) == want
    # More of a day that was compacted, and compacted once more.
    ingest.bulk_load(records(spark, [raw(1, 0, 77)]), store, dim, "late")
    want = sorted([*want, (1, 77, "late")])
    assert held(spark, store) == want
    ingest.compact(spark, store, max_files=1)
    assert held(spark, store) == want and len(folders.published(spark, store)) == 1
    for again in (raw(1, 0, 3), raw(1, 0, 77)):
        with pytest.raises(ingest.Rejected):
            ingest.bulk_load(records(spark, [again]), store, dim, "x")


@pytest.mark.parametrize("dies", ["publish", "_clear"])
def test_a_compaction_that_dies(spark, dim, store, monkeypatch, dies):
    ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 0), raw(3, 1)]), store, dim, "a")
    ingest.bulk_load(records(spark, [raw(2, 0, 1)]), store, dim, "b")
    ingest.delete_events(spark, store, gone(spark, 1))
    want = held(spark, store)

    def die(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, dies, die)
        with pytest.raises(RuntimeError, match="lost"):
            ingest.compact(spark, store, max_files=1)
    assert held(spark, store) == want
    ingest.bulk_load(records(spark, [raw(2, 0, 2)]), store, dim, "c")
    want = sorted([*want, (2, 2, "c")])
    assert held(spark, store) == want
    ingest.compact(spark, store, max_files=1)
    assert held(spark, store) == want and not os.path.exists(f"{store}/deleted")
    assert sum(spark.read.parquet(f).count() for f in event_files(store)) == len(want)


def test_keys_are_met_where_they_lie(spark, dim, store):
    ingest.bulk_load(records(spark, [raw(1, d, n) for d in range(3) for n in range(5)]), store, dim, "a")
    new = ingest.prepare(records(spark, [raw(1, 1, 2), raw(1, 1, 9)]), "b", 100)
    met = eventkeys.met(new, store, [X.D1 // S.DAY + 1])
    text = met._jdf.queryExecution().executedPlan().toString()
    side = text[text.index("BucketedScan: true") if "BucketedScan: true" in text else text.index("Bucketed: true") :]
    join = next(line for line in text.splitlines() if "SortMergeJoin" in line)
    assert "SortMergeJoin" in join and text.count("Exchange hashpartitioning(high") == 1 and "period" in side
    keys = text.index("keys_")
    above = text[:keys].splitlines()
    assert not any("Exchange" in line for line in above[-6:])
    assert [(r.rec_id > 100, r.old_id <= 15) for r in met.collect()] == [(True, True)]


def test_equal_digests_are_no_proof(spark, dim, store, monkeypatch):
    plain = eventkeys.digested
    monkeypatch.setattr(eventkeys, "digested", lambda e: plain(e).withColumn("high", F.lit(1).cast("long")).withColumn("low", F.lit(2).cast("long")))
    ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 0)]), store, dim, "a")
    done = ingest.bulk_load(records(spark, [raw(1, 0), raw(1, 0, 1), raw(2, 1)]), store, dim, "b", "drop")
    assert (done.n_rows, done.n_dropped) == (2, 1)


def test_keys_of_failed_loads_do_no_harm(spark, dim, store, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(folders.Lock, "check", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 0)]), store, dim, "a")
    assert held(spark, store) == [] and ingest.bulk_load(records(spark, [raw(2, 0), raw(1, 0)]), store, dim, "a").n_rows == 2
    assert len(event_files(store)) == 1  # what the first attempt left is gone


def test_one_load_id_twice_at_a_time(spark, dim, store):
    """The second run takes the load over; the first finds out before it publishes, and leaves the second's lock and files."""
    first = folders.only_writer(spark, store, "a")
    lock = first.__enter__()
    second = folders.only_writer(spark, store, "a")
    held_now = second.__enter__()
    held_now.check()
    with pytest.raises(folders.Busy):
        lock.check()
    first.__exit__(None, None, None)
    held_now.check()
    with pytest.raises(folders.Busy):
        ingest.bulk_load(records(spark, [raw(1, 0)]), store, dim, "b")
    second.__exit__(None, None, None)
    assert ingest.bulk_load(records(spark, [raw(1, 0)]), store, dim, "b").status == "success"


def test_two_threads_load_the_same(spark, dim, store):
    said = []

    def run():
        try:
            said.append(ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 1)]), store, dim, "a").status)
        except Exception as e:  # taken over, at whatever step
            said.append(type(e).__name__)

    threads = [threading.Thread(target=run) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    if "success" not in said:
        folders.break_lock(spark, store)
        said.append(ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 1)]), store, dim, "a").status)
    assert said.count("success") == 1
    assert held(spark, store) == [(1, 0, "a"), (2, S.DAY, "a")] and ingest.loads(spark, store).count() == 1


def test_a_lock_that_was_left_can_be_broken(spark, dim, store):
    left = folders.only_writer(spark, store, "dead")
    lock = left.__enter__()
    with pytest.raises(folders.Busy, match="dead"):
        ingest.delete_events(spark, store, gone(spark, 1))
    assert folders.break_lock(spark, store) == "dead" and folders.break_lock(spark, store) is None
    ingest.bulk_load(records(spark, [raw(1, 0)]), store, dim, "b")
    with pytest.raises(folders.Busy):
        folders.publish(lock, "x")
    left.__exit__(None, None, None)
