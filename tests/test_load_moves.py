"""A load moves its rows once: they are laid out, held against each other and against the store in one exchange."""

import os

import pytest

from quaylight import schema as S
from quaylight.operators import ingest

from . import fixtures as X
from .test_compaction import held, raw, records
from .test_first_arrivals import _event


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame(X.FUTURES, S.INSTRUMENTS)


def test_first_arrivals_and_what_the_store_holds_in_one_exchange(spark):
    hashes = ["ab12", "AB12", "ab1", "", None, "ab13"]
    rows = [_event(10 + i, h) for i, h in enumerate(hashes * 2)] + [_event(30, "ab12", None), _event(31, "ab12", None)]
    old = spark.createDataFrame([_event(1, "ab12"), _event(2, None), _event(3, "cd")], S.MBP).select("rec_id", "dataset", "day", *S.EVENT_KEY)
    laid = ingest._laid_firsts(ingest._packed(spark.createDataFrame(rows, S.MBP)), old)
    assert sorted((r.rec_id, r.order_book_hash) for r in laid.collect()) == [(11, "AB12"), (12, "ab1"), (13, ""), (15, "ab13"), (30, "ab12")]
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") and "Join" not in plan


def test_a_dropping_load_joins_no_whole_rows(spark, dim, tmp_path, monkeypatch):
    """Laying out is one plan without a join even where the store holds some of the events."""
    store, plans = str(tmp_path / "store"), []
    ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 0)]), store, dim, "a")
    plain = ingest._laid_firsts
    monkeypatch.setattr(ingest, "_laid_firsts", lambda packed, held: plans.append(held) or plain(packed, held))
    done = ingest.bulk_load(records(spark, [raw(1, 0), raw(1, 0, 1), raw(1, 0, 1), raw(2, 1)]), store, dim, "b", "drop")
    assert (done.n_rows, done.n_dropped) == (2, 2) and [p.count() for p in plans] == [1]
    assert held(spark, store) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, S.DAY, "b")]


def test_unknown_instruments_reject_before_anything_is_written(spark, dim, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    ingest.bulk_load(records(spark, [raw(1, 0)]), store, dim, "a")
    few = dim.where("instrument_id <> 1")
    with monkeypatch.context() as m:
        m.setattr(ingest, "written", None)
        m.setattr(ingest, "roll_back", None)
        for how in ("drop", "error"):
            with pytest.raises(ingest.Rejected, match="unknown"):
                ingest.bulk_load(records(spark, [raw(1, 0), raw(1, 0, 1), raw(2, 0)]), store, few, "b", how)
    assert not os.path.exists(f"{store}/events/load_id=b")
    # An event that the store has is dropped, whatever has become of its instrument.
    done = ingest.bulk_load(records(spark, [raw(1, 0), raw(2, 0)]), store, few, "b", "drop")
    assert (done.n_rows, done.n_dropped) == (1, 1)


def test_one_known_event_among_many_hits(spark, dim, tmp_path, monkeypatch):
    """The first hits looked up may all be of events that are gone; then all are."""
    store = str(tmp_path / "store")
    monkeypatch.setattr(ingest.eventkeys, "_FEW", 1)
    ingest.bulk_load(records(spark, [raw(1, 0, n) for n in range(4)] + [raw(2, 0)]), store, dim, "a")
    ingest.delete_events(spark, store, spark.createDataFrame([("futures", 1)], "dataset string, instrument_id long"))
    with pytest.raises(ingest.Rejected, match="already"):
        ingest.bulk_load(records(spark, [raw(1, 0, n) for n in range(4)] + [raw(2, 0)]), store, dim, "b")
    assert ingest.bulk_load(records(spark, [raw(1, 0, n) for n in range(4)]), store, dim, "b").n_rows == 4
