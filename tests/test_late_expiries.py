"""Contracts that expire later than a long of nanoseconds can tell: exact integers say what their ranks are."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quaylight.plans.registry import QUERIES
from quaylight.plans.sql import SQL
from quaylight.sources import feeds

_KINDS = ["purchase", "view", "error", "purchase", "click"]
#: Of each root two contracts of the first days, and later ones about the last that a long can tell and far beyond it.
_USERS = [u + r for u in (0, 10, 48_330, 48_340, 48_345, 48_350, 48_355, 89_995, 539_995) for r in range(5)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("late")
    start, n = datetime.datetime(2024, 1, 1, 3), 4 * len(_USERS)
    at = [start + datetime.timedelta(hours=5 * i // 2, microseconds=i) for i in range(n)]
    users = [_USERS[(i * 7) % len(_USERS)] for i in range(n)]
    pq.write_table(pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()),
        "event_type": [_KINDS[i % 5] for i in range(n)], "value": [float(i % 50) + 1 for i in range(n)], "props": [f'{{"k": {i % 97}}}' for i in range(n)],
    }), d / "events.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array([0, 1], pa.int64()), "s_name": ["S0", "S1"], "s_nationkey": pa.array([0, 1], pa.int32()), "s_acctbal": [1.0, -1.0]}), d / "supplier.parquet")
    return str(d)


def _exact(d, query):
    """The query's SQL with expiries of 128 bits, of which 64-bit ones show the last instant at most."""
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    text = SQL[query].replace("((user_id // 5) * 9 + 8)", "((CAST(user_id AS HUGEINT) // 5) * 9 + 8)")
    assert text != SQL[query]
    rows = con.execute(text).fetchall()
    return sorted((tuple(min(v, feeds.LATEST) if isinstance(v, int) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("query", ["continuous_map", "continuous_map_refreshed", "mbp1_continuous", "rollover_events", "symbol_intervals", "instrument_create"])
def test_late_contracts_are_ranked_as_by_exact_expiries(spark, tables, query):
    got = sorted((tuple(r) for r in QUERIES[query](spark, tables).collect()), key=str)
    assert got and got == _exact(tables, query)
