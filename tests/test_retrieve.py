import pytest

from quaylight.operators.retrieve import Market, RetrieveParams, metadata, retrieve, symbol_map, write_result

from . import fixtures as X

END = 1_707_177_600_000_000_000
CONT = ["HE.c.0", "HE.v.0"]


@pytest.fixture(scope="module")
def market(spark):
    m = X.market(spark)
    return Market(m.mbp.cache(), m.instruments.cache(), m.continuous_map.cache())


def rows(market, symbols, start, end, schema, dataset="futures", stype="raw"):
    return retrieve(market, RetrieveParams(symbols, start, end, schema, dataset, stype)).collect()


def test_continuous_map(market):
    got = {(r.ts_day, r.continuous_ticker): (r.instrument_id, r.continuous_instrument_id, r.rollover_flag) for r in market.continuous_map.collect()}
    want = {}
    for d in (X.D1, X.D2, X.D3):
        want |= {(d, "HE.c.0"): (1, 5, 0), (d, "HE.c.1"): (2, None, 0), (d, "LE.c.0"): (3, None, 0)}
    want |= {(X.D2, "HE.v.0"): (1, 6, 0), (X.D3, "HE.v.0"): (2, 6, 1)}
    assert got == want


@pytest.mark.parametrize("schema", ["mbp-1", "tbbo", "trades"])
def test_continuous_events(market, schema):
    got = [(r.instrument_id, r.ts_recv, r.rollover_flag) for r in rows(market, CONT, X.D1, END, schema, stype="continuous")]
    t = [x[9] for x in X.RECORDS]
    assert sorted(got) == [(5, t[0], 0), (5, t[1], 0), (6, t[1], 0), (6, t[2], 1)]
    assert [g[1] for g in got] == sorted(g[1] for g in got)


def test_continuous_bars(market):
    got = rows(market, CONT, X.D1, END, "ohlcv-1d", stype="continuous")
    assert [(r.instrument_id, r.ts_event, r.rollover_flag, r.volume) for r in got] == [(5, X.D1, 0, 1), (5, X.D2, 0, 1), (6, X.D2, 0, 1), (6, X.D3, 1, 1)]


def test_continuous_snapshots(market):
    got = rows(market, CONT, X.D1, END, "bbo-1s", stype="continuous")
    assert [(r.instrument_id, r.ts_event, r.rollover_flag) for r in got] == [
        (5, 1_704_209_104_000_000_000, 0),
        (5, 1_704_240_001_000_000_000, 0),
        (6, 1_704_240_001_000_000_000, 0),
        (6, 1_707_117_590_000_000_000, 1),
    ]


def test_flag_belongs_to_the_days_first_event_even_if_it_is_cut_off(market):
    assert rows(market, ["HE.v.0"], 1_707_117_590_000_000_001, END, "mbp-1", stype="continuous") == []


def test_raw_futures(market):
    got = rows(market, ["HEG4"], X.D1, 1_704_225_600_000_000_000, "mbp-1")
    assert [(r.instrument_id, r.price, r.depth, r.bid_ct, r.ask_ct) for r in got] == [(1, 500 * X.UNIT, 0, 10, 20)]


@pytest.mark.parametrize("schema,n", [("mbp-1", 1), ("tbbo", 1), ("trades", 1), ("bbo-1s", 1)])
def test_equities(market, schema, n):
    got = rows(market, ["AAPL"], 1_704_209_103_644_092_563, 1_704_209_903_644_092_567, schema, "equities")
    assert len(got) == n
    if schema == "bbo-1s":
        assert got[0].ts_event == 1_704_209_104_000_000_000


def test_equities_bar(market):
    (bar,) = rows(market, ["AAPL"], 1_704_209_103_644_092_562, 1_704_295_503_654_092_563, "ohlcv-1d", "equities")
    assert tuple(bar) == (7, X.D1, 0, 6770, 6770, 6770, 6770, 1)


def test_option(market):
    start, end = 1_704_209_103_644_092_563, 1_704_209_903_644_092_567
    assert len(rows(market, ["APPLP12345"], start, end, "mbp-1", "option")) == 2
    assert len(rows(market, ["APPLP12345"], start, end, "tbbo", "option")) == 1
    assert len(rows(market, ["APPLP12345"], start, end, "trades", "option")) == 1
    assert len(rows(market, ["APPLP12345"], start, end, "bbo-1s", "option")) == 1
    (bar,) = rows(market, ["APPLP12345"], start, end, "ohlcv-1d", "option")
    assert bar.volume == 1


def test_end_is_outside_for_events_and_inside_for_bars(market):
    t = X.RECORDS[5][9]
    assert rows(market, ["AAPL"], t - 10, t, "trades", "equities") == []
    assert len(rows(market, ["AAPL"], t - 10, t, "ohlcv-1s", "equities")) == 1


def test_unknown_symbols_have_metadata_but_no_records(market):
    p = RetrieveParams(["NONE"], X.D1, END, "trades")
    assert retrieve(market, p).count() == 0
    (m,) = metadata(market, p).collect()
    assert (m.mappings, m.schema, m.start) == ({}, "trades", X.D1)


def test_symbol_map(market):
    assert symbol_map(market.instruments, "futures", ["HEG4", "LEG4", "no"]).first()[0] == {1: "HEG4", 3: "LEG4"}
    assert symbol_map(market.instruments, "futures", None).first()[0].keys() == {1, 2, 3, 4, 5, 6}


def test_errors(market):
    for bad in (("x", "futures", "raw"), ("trades", "x", "raw"), ("trades", "futures", "x")):
        with pytest.raises(ValueError):
            retrieve(market, RetrieveParams(None, 0, 1, *bad))


def test_filters_reach_the_scan(spark, market, tmp_path):
    path = str(tmp_path / "mbp")
    market.mbp.write.partitionBy("dataset", "day").parquet(path)
    stored = Market(spark.read.parquet(path), market.instruments)
    plan = retrieve(stored, RetrieveParams(["HEG4"], X.D1, X.D2, "trades"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "GreaterThanOrEqual(ts_recv" in plan and "EqualTo(action,84)" in plan
    assert "levels" not in plan.split("ReadSchema")[1].split(">")[0]


def test_written_result_keeps_its_order(spark, market, tmp_path):
    from quaylight.operators.quality import file_order_check

    out = str(tmp_path / "out")
    write_result(retrieve(market, RetrieveParams(None, X.D1, END, "trades")), out, 2)
    assert spark.read.parquet(out).count() == 5 and file_order_check(spark, out).count() == 0
