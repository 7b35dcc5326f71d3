import pytest

from quaylight import schema as S
from quaylight.operators import ingest, instruments, quality
from quaylight.streaming.ingest_stream import recent_duplicates_dropped, record_stream, start_ingest

from . import fixtures as X


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame(X.FUTURES, S.INSTRUMENTS)


def records(spark, rows):
    return spark.createDataFrame(rows, S.RAW).coalesce(1)


def test_load_duplicate_load_and_order(spark, dim, tmp_path):
    store = str(tmp_path / "store")
    two = [X.raw("futures", 1, X.D1 + 1, 1, 1, action=1), X.raw("futures", 1, X.D1 + 2, 1, 1, action=1)]
    done = ingest.bulk_load(records(spark, two), store, dim, "a")
    assert (done.status, done.mark, done.n_rows) == ("success", 0, 2)
    same = X.raw("futures", 1, X.D2, 1, 1)
    for bad in ([same, same], [two[0]]):
        with pytest.raises(ingest.Rejected):
            ingest.bulk_load(records(spark, bad), store, dim, "b")
    assert ingest.read_store(spark, store).count() == 2
    again = ingest.bulk_load(records(spark, [same]), store, dim, "b")
    assert again.mark == 2 and ingest.read_store(spark, store).count() == 3
    assert ingest.bulk_load(records(spark, [same]), store, dim, "b").status == "done before"
    assert ingest.high_water_mark(ingest.read_store(spark, store)).first().mark == 3
    got = ingest.read_store(spark, store).orderBy("rec_id").collect()
    assert [r.ts_recv for r in got] == [X.D1 + 1, X.D1 + 2, X.D2] and got[0].day == X.D1 // S.DAY


def test_rejections(spark, dim, tmp_path):
    store = str(tmp_path / "store")
    for bad in (X.raw("futures", 99, X.D1, 1, 1), X.raw("equities", 1, X.D1, 1, 1), X.raw("futures", 1, X.D1, 1, 1, rtype="trade")):
        with pytest.raises(ingest.Rejected):
            ingest.bulk_load(records(spark, [bad, X.raw("futures", 1, X.D2, 1, 1)]), store, dim, "x")
    assert ingest.read_store(spark, store).count() == 0


def test_dropping_duplicates(spark, dim, tmp_path):
    store = str(tmp_path / "store")
    one, two = X.raw("futures", 1, X.D1, 1, 1), X.raw("futures", 1, X.D2, 1, 1, levels=2)
    assert ingest.bulk_load(records(spark, [one, one]), store, dim, "a", "drop").n_dropped == 1
    done = ingest.bulk_load(records(spark, [one, two, two]), store, dim, "b", "drop")
    assert (done.n_rows, done.n_dropped) == (1, 2) and ingest.read_store(spark, store).count() == 2


def test_levels_are_part_of_the_event(spark):
    a, b = X.raw("futures", 1, X.D1, 1, 1), X.raw("futures", 1, X.D1, 1, 1, levels=2)
    assert ingest.duplicate_keys(ingest.prepare(records(spark, [a, b]), "x", 0)).isEmpty()


def test_stream_ingest_and_replay(spark, dim, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [X.raw("futures", 1, X.D1 + k, 1, 1) for k in range(6)]
    for part in (rows[:3], rows[3:]):
        records(spark, part).write.mode("append").parquet(source)
    for checkpoint in ("c1", "c2"):  # the second run replays every batch
        start_ingest(record_stream(spark, source, files_per_batch=1), store, dim, str(tmp_path / checkpoint)).awaitTermination()
        assert ingest.read_store(spark, store).count() == 6
    records(spark, rows[:1] + [X.raw("futures", 2, X.D1, 1, 1)]).write.mode("append").parquet(source)
    start_ingest(record_stream(spark, source), store, dim, str(tmp_path / "c2")).awaitTermination()
    assert ingest.read_store(spark, store).count() == 7


def test_stream_drops_recent_duplicates(spark, tmp_path):
    source = str(tmp_path / "in")
    one = X.raw("futures", 1, X.D1, 1, 1)
    ingest.prepare(records(spark, [one, one, X.raw("futures", 1, X.D1 + 5, 1, 1)]), "x", 0).write.parquet(source)
    stream = recent_duplicates_dropped(spark.readStream.schema(S.MBP).parquet(source))
    query = stream.writeStream.format("memory").queryName("recent").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("recent").count() == 2


def test_instruments(spark, dim):
    new = spark.createDataFrame([("futures", "ZZZ"), ("option", "AAPL")], "dataset string, ticker string")
    for c in dim.columns:
        if c not in ("dataset", "ticker", "instrument_id"):
            new = new.withColumn(c, instruments.F.lit(None).cast(dim.schema[c].dataType))
    grown = instruments.create_instruments(dim, new)
    assert {(r.ticker, r.instrument_id) for r in grown.where("instrument_id > 9").collect()} == {("ZZZ", 10), ("AAPL", 11)}
    with pytest.raises(instruments.Conflict):
        instruments.create_instruments(grown, new)
    with pytest.raises(instruments.Conflict):
        instruments.create_instruments(dim, new.unionByName(new))
    assert [r.instrument_id for r in instruments.find_instruments(grown, "equities", ticker="AAPL").collect()] == [7]
    assert instruments.find_instruments(dim, instrument_id=[1, 9]).count() == 2
    changes = dim.where("instrument_id = 1").withColumn("vendor", instruments.F.lit("w"))
    assert instruments.find_instruments(instruments.update_instruments(dim, changes), vendor="w").count() == 1
    with pytest.raises(instruments.Conflict):
        instruments.update_instruments(dim, changes.withColumn("instrument_id", instruments.F.lit(77).cast("long")))
    events = ingest.prepare(records(spark, X.RECORDS), "x", 0)
    ids = spark.createDataFrame([(1,)], "instrument_id long")
    left, kept = instruments.delete_instruments(dim, events, ids)
    assert (left.count(), kept.count(), instruments.affected_days(events, ids).count()) == (8, 7, 2)
    assert dim.select(instruments.dataset_code(instruments.F.col("dataset")).alias("c")).distinct().count() == 3


def test_quality(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 1, 9), (3, 1, 11)], "rec_id long, instrument_id long, ts_recv long")
    assert tuple(quality.chronological_check(df).first()) == (3, 1)
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (3,), (None,)], "x int")
    assert sorted(map(tuple, quality.reconcile(a, b).collect())) == [(1, "left", 1), (2, "left", 1), (3, "right", 2)]
    maps = spark.createDataFrame([("A", [("2024-01-01", "2024-02-01", "A1"), ("2024-02-01", "2024-03-01", "A2")])], "symbol string, intervals array<struct<start:string,end:string,raw:string>>")
    assert quality.flat_symbol_map(maps).first()[0] == {"A": "A2"}
