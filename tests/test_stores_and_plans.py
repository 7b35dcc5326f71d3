"""Plans that must hold at any size, and stores under failing, concurrent and repeated writers."""

import json

import pytest
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight import scratch
from quaylight.functions.numbering import numbered
from quaylight.operators import ingest, quality, results
from quaylight.operators.retrieve import Market, RetrieveParams, retrieve
from quaylight.plans.registry import QUERIES

from . import fixtures as X

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame(X.FUTURES, S.INSTRUMENTS)


def records(spark, rows):
    return spark.createDataFrame(rows, S.RAW).coalesce(1)


@pytest.mark.parametrize("name", ["ohlcv_1m", "bbo_1m", "ohlcv_1d_equities", "ohlcv_1d_continuous"])
def test_bars_and_books_are_summed_by_hash(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_order_key_against_row_numbers(spark):
    rows = [X.raw("futures", 1, X.D1 + t, p, 1) for t, p in ((5, 50), (5, 51), (1, 10), (9, 90), (9, 91))]
    mbp = ingest.prepare(records(spark, rows), "t", 2**40)
    (bar,) = retrieve(Market(mbp, spark.createDataFrame(X.FUTURES, S.INSTRUMENTS)), RetrieveParams(["HEG4"], X.D1, X.D2, "ohlcv-1d")).collect()
    assert (bar.open, bar.close, bar.low, bar.high, bar.volume) == (10, 91, 10, 91, 5)


def test_trades_of_equities_come_by_the_time_of_the_event(spark):
    early, late = X.raw("equities", 7, X.D1 + 9, 1, 1), X.raw("equities", 7, X.D1 + 5, 2, 1)
    rows = [early[:3] + (X.D1 + 1,) + early[4:], late[:3] + (X.D1 + 2,) + late[4:]]
    m = Market(ingest.prepare(records(spark, rows), "t", 0), spark.createDataFrame(X.FUTURES, S.INSTRUMENTS))
    assert [r.price for r in retrieve(m, RetrieveParams(["AAPL"], X.D1, X.D2, "trades", "equities")).collect()] == [1, 2]
    assert [r.price for r in retrieve(m, RetrieveParams(["AAPL"], X.D1, X.D2, "mbp-1", "equities")).collect()] == [2, 1]


def test_a_store_has_one_writer(spark, dim, tmp_path):
    store = str(tmp_path / "store")
    one, two = records(spark, [X.raw("futures", 1, X.D1, 1, 1)]), records(spark, [X.raw("futures", 1, X.D1, 1, 1), X.raw("futures", 2, X.D1, 1, 1)])
    with ingest.only_writer(spark, store, "a"):
        with pytest.raises(ingest.Busy):
            ingest.bulk_load(two, store, dim, "b", "drop")
        assert ingest.read_store(spark, store).count() == 0
        assert ingest.bulk_load(one, store, dim, "a").n_rows == 1  # a retry of the load that holds it
    done = ingest.bulk_load(two, store, dim, "b", "drop")
    assert (done.mark, done.n_rows, done.n_dropped) == (1, 1, 1)
    ids = [r.rec_id for r in ingest.read_store(spark, store).select("rec_id").collect()]
    assert len(set(ids)) == 2 and ingest.store_mark(spark, store) == max(ids)


def test_loads_read_their_days_only(spark, dim, tmp_path):
    store = str(tmp_path / "store")
    ingest.bulk_load(records(spark, [X.raw("futures", 1, X.D1 + i * S.DAY, 1, 1) for i in range(20)]), store, dim, "a")
    new = ingest.prepare(records(spark, [X.raw("futures", 1, X.D1 + 3, 1, 1)]), "b", 20)
    days = ingest.days_of(new)
    joined = ingest.against_store(new, ingest.read_store(spark, store), days=days)
    assert days == [X.D1 // S.DAY]
    scans = [line for line in plan(joined).splitlines() if "FileScan" in line and "events" in line]
    assert scans and all("day#" in line and str(days[0]) in line.split("PartitionFilters")[1].split("]")[0] for line in scans)


def test_deleted_events_stay_away_until_they_are_loaded_again(spark, dim, tmp_path):
    store = str(tmp_path / "store")
    rows = [X.raw("futures", i, X.D1 + i, 1, 1) for i in (1, 2, 1)]
    ingest.bulk_load(records(spark, rows[:2]), store, dim, "a")
    ingest.delete_events(spark, store, spark.createDataFrame([("futures", 1)], "dataset string, instrument_id long"))
    assert [r.instrument_id for r in ingest.read_store(spark, store).collect()] == [2]
    ingest.bulk_load(records(spark, rows[2:]), store, dim, "b")
    assert sorted(r.instrument_id for r in ingest.read_store(spark, store).collect()) == [1, 2]


def test_records_arrive_as_json_lines(spark, dim, tmp_path):
    names = S.RAW.names
    lines = []
    for r in (X.raw("futures", 1, X.D1, 1, 1), X.raw("futures", 2, X.D2, 1, 1, levels=2)):
        one = dict(zip(names, r))
        one["levels"] = [dict(zip(S.LEVEL.names, v)) for v in one["levels"]]
        lines.append(json.dumps(one))
    (tmp_path / "in.json").write_text("\n".join(lines))
    raw = ingest.read_records(spark, str(tmp_path / "in.json"), "json")
    assert ingest.bulk_load(raw, str(tmp_path / "store"), dim, "a").n_rows == 2
    assert sorted(len(r.levels) for r in ingest.read_store(spark, str(tmp_path / "store")).collect()) == [1, 2]


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("y").alias("k")).repartition(7)
    assert all(r.n == r.x + 1 for r in numbered(df, ["x"], "n").collect())
    assert numbered(df.limit(0), ["x"], "n").count() == 0


def test_order_is_checked_across_stretches(spark):
    df = spark.createDataFrame([(i, 100 - i if i == 50 else i) for i in range(100)] + [(100, 3)], "rec_id long, ts_recv long")
    want = (101, 1)
    for stretch in (1_000_000, 10, 100, 1):
        assert tuple(quality.chronological_check(df, stretch=stretch).first()) == want


def test_deleted_documents_stay_away(spark, tmp_path):
    header = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, name string")
    results.write_tables({n: header.withColumn("kind", F.lit("live")) for n in results.PARTS["live"]}, str(tmp_path))
    assert results.read_tables(spark, str(tmp_path), "live")["header"].count() == 2
    results.delete_stored(header.where("doc_id = 1"), str(tmp_path), "live")
    assert all([r.doc_id for r in t.collect()] == [2] for t in results.read_tables(spark, str(tmp_path), "live").values())


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session())


def test_duplicates_are_dropped_by_hash(spark):
    """No struct is carried through a sort to find first arrivals, and books take no part in it."""
    text = plan(QUERIES["dedup_load"](spark, DATA))
    assert "SortAggregate" not in text and "HashAggregate" in text


@pytest.mark.parametrize("name", ["continuous_map", "mbp1_continuous", "ohlcv_1d_continuous"])
def test_days_and_contracts_are_not_multiplied(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_a_changed_folder_gets_a_new_map(spark, tmp_path):
    """Also within one application: the map in use is of the files that are there."""
    from quaylight.sources import feeds

    events = spark.read.parquet(f"{DATA}/events.parquet")
    d = str(tmp_path / "data")
    events.where("event_id < 300").write.parquet(f"{d}/events.parquet")
    first = feeds.market(spark, d, continuous=True).continuous_map
    assert feeds.market(spark, d, continuous=True).continuous_map.inputFiles() == first.inputFiles()
    n = first.select("ts_day").distinct().count()
    events.where("event_id >= 300").write.mode("append").parquet(f"{d}/events.parquet")
    second = feeds.market(spark, d, continuous=True).continuous_map
    assert second.select("ts_day").distinct().count() > n
    assert set(second.inputFiles()).isdisjoint(first.inputFiles())
