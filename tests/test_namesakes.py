"""Suppliers that share a name, as in tables repeated with shifted keys."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quaylight.plans.registry import QUERIES
from quaylight.plans.sql import SQL


def test_suppliers_of_one_name_are_an_instrument_each(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    names = [f"S{i % 7}" for i in range(60)] + [None, None]
    pq.write_table(pa.table({"s_suppkey": pa.array(range(62), pa.int64()), "s_name": names}), tmp_path / "supplier.parquet")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    got = sorted((tuple(r) for r in QUERIES["instrument_create"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(SQL["instrument_create"]).fetchall(), key=str)
    assert sum(r[0] == "equities" for r in got) == 62 and len({r[1] for r in got}) == len(got)
