"""Tables repeated with keys shifted near and far, so that most contracts expire later than a long of nanoseconds can tell."""

import duckdb
import pytest

from quaylight.plans.registry import QUERIES
from quaylight.plans.sql import SQL

_SHIFTS = (0, 60_000, 1_000_000_000, 600_000_000_000)
_NAMES = [
    "bbo_1s_continuous",
    "continuous_map",
    "continuous_map_calendar",
    "continuous_map_refreshed",
    "continuous_map_stored",
    "continuous_map_volume",
    "mbp1_continuous",
    "ohlcv_1d_continuous",
    "ohlcv_1h_continuous",
    "ohlcv_1m_continuous",
    "ohlcv_1s_continuous",
    "rollover_count",
    "rollover_events",
    "symbol_intervals",
    "tbbo_continuous",
    "trades_continuous",
    "window_mbp1_continuous",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    events = "event_id + s AS event_id, ts, user_id + s AS user_id, event_type, value, props"
    con.execute(f"COPY (SELECT {events} FROM '/root/testdata/sf0.001/events.parquet', unnest({list(_SHIFTS)}) u(s)) TO '{d}/events.parquet' (FORMAT PARQUET)")
    return str(d)


@pytest.mark.parametrize("query", _NAMES)
def test_results_are_those_of_exact_expiries(spark, tables, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    text = SQL[query].replace("((user_id // 5) * 9 + 8)", "((CAST(user_id AS HUGEINT) // 5) * 9 + 8)")
    assert text != SQL[query]
    want = con.sql(text)
    got = QUERIES[query](spark, tables).select(*want.columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str) != []
