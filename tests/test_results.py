import json

import pytest
from pyspark.sql import functions as F

from quaylight.operators import results as R
from quaylight.sources import documents as D

_STATS = {f.name: i for i, f in enumerate(D.BACKTEST["metadata"].dataType["static_stats"].dataType.fields)}
_PARAMS = {"strategy_name": "s", "capital": 10, "data_type": "BAR", "schema": "ohlcv-1h", "start": 1, "end": 2, "tickers": ["A", "B"]}
_TRADE = {"trade_id": 1, "signal_id": 1, "timestamp": 5, "ticker": "A", "quantity": 4, "avg_price": 1, "trade_value": -2, "trade_cost": -2, "action": "BUY", "fees": 0}
_ORDER = {"ticker": "A", "order_type": "MKT", "action": "BUY", "signal_id": 1, "weight": 5, "quantity": 10, "limit_price": "1", "aux_price": "2"}
_POINT = {"timestamp": 1, "equity_value": 2, "percent_drawdown": 3, "cumulative_return": -4, "period_return": 5}
_SIGNALS = [{"timestamp": 9, "trade_instructions": [_ORDER, _ORDER | {"ticker": "B"}]}, {"timestamp": 10, "trade_instructions": []}]


def backtest(name):
    return {
        "metadata": {"backtest_id": 7, "backtest_name": name, "parameters": _PARAMS, "static_stats": _STATS},
        "period_timeseries_stats": [_POINT | {"extra": "x"}, _POINT | {"timestamp": 0}],
        "daily_timeseries_stats": [_POINT | {"timestamp": 3}],
        "trades": [_TRADE],
        "signals": _SIGNALS,
    }


def as_json(row):
    return json.loads(json.dumps(row.asDict(recursive=True)))


@pytest.fixture()
def stored(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.json").write_text(json.dumps(backtest(n), indent=1))
    docs = D.read_documents(spark, str(tmp_path), "backtest")
    return R.store_documents(R.assign_ids(docs, 100, ["metadata.backtest_name"]), "backtest")


def test_backtests_come_back_as_they_went_in(stored):
    got = {r["doc_id"]: as_json(r) for r in R.assemble(stored, "backtest").collect()}
    assert sorted(got) == [101, 102]
    for doc_id, name in ((101, "a"), (102, "b")):
        want = backtest(name)
        want["metadata"]["backtest_id"] = doc_id
        for p in want["period_timeseries_stats"]:
            p.pop("extra", None)
        assert {k: v for k, v in got[doc_id].items() if k != "doc_id"} == want


def test_names_lists_and_deletion(spark, stored):
    assert [r.doc_id for r in R.ids_by_name(stored["header"], ["b"]).collect()] == [102]
    assert sorted(map(tuple, R.list_documents(stored["header"], "backtest").collect())) == [(101, "a"), (102, "b")]
    assert R.unique_names(stored["header"], stored["header"]).count() == 2
    left = R.delete_documents(stored, "backtest", spark.createDataFrame([(101,)], "doc_id long"))
    assert all([r.doc_id for r in t.select("doc_id").distinct().collect()] == [102] for t in left.values())


def test_live_documents(spark, tmp_path):
    account = {f.name: i for i, f in enumerate(D.LIVE["account"].dataType.fields)} | {"currency": "USD"}
    doc = {"parameters": _PARAMS, "account": account, "trades": [], "signals": _SIGNALS}
    (tmp_path / "l.json").write_text(json.dumps(doc))
    tables = R.store_documents(R.assign_ids(D.read_documents(spark, str(tmp_path), "live")).withColumn("doc_id", F.lit(5).cast("long")), "live")
    (got,) = R.assemble(tables, "live").collect()
    assert as_json(got) == doc | {"doc_id": 5}
    ((doc_id, created),) = R.list_documents(tables["header"], "live").collect()
    assert doc_id == 5 and created.startswith("20")


def test_tables_are_written_by_kind(spark, stored, tmp_path):
    R.write_tables(stored, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "signals")).where("kind = 'backtest'").count() == 4
