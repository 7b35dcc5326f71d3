"""Lines of an order are numbered once, so that exchanges carry a number and not the key that they are ordered by."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from quaylight.plans import registry


def test_places_are_numbers_in_order_of_the_key(spark, tmp_path):
    at = datetime.datetime(1996, 1, 2)
    lines = [(1, 2, 9, 5.0), (1, 1, 8, 3.0), (1, 1, 8, 2.0), (2, 1, 7, 1.0), (3, 1, 6, 1.0)]  # two that differ in quantity only
    pq.write_table(pa.table({
        "l_orderkey": [r[0] for r in lines], "l_linenumber": pa.array([r[1] for r in lines], pa.int32()), "l_partkey": [r[2] for r in lines],
        "l_suppkey": [4] * 5, "l_extendedprice": [1.5] * 5, "l_quantity": [r[3] for r in lines], "l_shipdate": pa.array([at] * 5, pa.timestamp("us")),
    }), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": [1, 2], "o_custkey": [11, 11], "o_orderdate": pa.array([at] * 2, pa.timestamp("us"))}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"c_custkey": [11], "c_name": ["C"]}), tmp_path / "customer.parquet")
    instructions = registry._documents(spark, str(tmp_path))[2]
    assert instructions.schema["pos"].dataType.typeName() == "integer"
    got = sorted((r.doc_id, r.signal_pos, r.pos, r.ticker, r.quantity) for r in instructions.collect())
    assert got == [(11, 1, 1, "8", 2), (11, 1, 2, "8", 3), (11, 1, 3, "9", 5), (11, 2, 1, "7", 1)]
