"""Lines that are sent twice: they move once, before records are made of them, and first arrivals are as they are read."""

from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.operators import ingest
from quaylight.plans import registry
from quaylight.plans.registry import QUERIES
from quaylight.scratch import exists, scratch_dir
from quaylight.sources.folders import names

from .test_first_arrivals import _event
from .test_stores_and_plans import DATA, plan

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp, l_returnflag string"


def test_no_fingerprint_is_moved_or_written(spark):
    held = lambda: names(spark, scratch_dir(spark)) if exists(spark, scratch_dir(spark)) else []
    before = held()
    df = QUERIES["dedup_load"](spark, DATA)
    moves = [line for line in plan(df).splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
    assert df.count() > 0 and held() == before
    assert len(moves) == 2 and all("hashpartitioning(l_orderkey" in line for line in moves)  # lines, and the keys of returned ones


def test_many_lines_are_many_parts(spark, monkeypatch):
    monkeypatch.setattr(registry, "_LINES_A_PART", 500)
    df = QUERIES["dedup_load"](spark, DATA)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert n > 4 and plan(df).count(f", {n}), REPARTITION_BY_NUM") == plan(df).count("Exchange hashpartitioning") == 2
    assert df.rdd.getNumPartitions() == n


def test_first_arrivals_of_awkward_lines(spark, tmp_path):
    at = datetime(1995, 1, 2)
    rows = [
        (1, 1, 10, 5, 2.0, 4.0, at, "R"),
        (1, 1, 11, 5, 2.0, 4.0, at, "N"),  # the same event of another part: the first one stays
        (1, 1, 12, 6, 2.0, 4.0, at, "N"),  # another instrument; its line was returned, too
        (1, 2, 13, 5, 2.0, 4.0, at, None),
        (2, 1, None, 5, 2.0, 4.0, at, "R"),
        (None, 1, 14, 5, 2.0, 4.0, at, "R"),  # without an order it is no returned line
        (None, 1, 15, 5, 2.0, 4.0, at, "R"),
        (3, None, 16, 5, 2.0, 4.0, at, "R"),
        (4, 1, 17, None, None, 4.0, None, "R"),
    ]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    returned = {r[:2] for r in rows if r[7] == "R" and None not in r[:2]}
    first, sent = {}, Counter()
    for r in rows:
        key = (r[3], r[4] and int(r[4]), r[0], r[1])
        first.setdefault(key, r[2])
        sent[key] += 1 + (r[:2] in returned)
    key = lambda r: (r.instrument_id, r["size"], r.sequence, r.discriminator)
    got = QUERIES["dedup_load"](spark, str(tmp_path)).collect()
    assert len(got) == len(first) and {key(r): r.ts_in_delta for r in got} == first
    assert {key(r): r.n for r in QUERIES["duplicate_keys"](spark, str(tmp_path)).collect()} == {k: n for k, n in sent.items() if n > 1}


def test_a_promise_that_does_not_hold_loses_nothing(spark):
    """Events that are said to lie together and do not are brought together."""
    rows = spark.createDataFrame([_event(i + 1, "ab12", i % 5) for i in range(50)], S.MBP).repartition(7, "rec_id")
    assert sorted(r.rec_id for r in ingest.drop_duplicates(rows, dealt=True).collect()) == [1, 2, 3, 4, 5]
    assert ingest.drop_duplicates(rows.where(F.lit(False)), dealt=True).count() == 0
