"""The first arrival of each key: one exchange, and whole keys, whatever the fingerprint looks like."""

from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.operators import ingest


def _event(rec_id, book_hash, instrument_id=1, price=5):
    return ("futures", rec_id, instrument_id, 7, price, 1, 84, 65, 0, 7, 0, 3, 0, book_hash, [(0, 1, 1, 1, 2, 1, 1)], 0, "load")


def test_first_arrivals_by_the_whole_key(spark):
    hashes = ["ab12", "AB12", "ab1", "", None, "ab13", "xy", "ab12\n"]
    rows = [_event(i + 1, h) for i, h in enumerate(hashes)] + [_event(50 + i, h) for i, h in enumerate(hashes)]
    rows += [_event(99, "ab12", None), _event(98, "ab12", None), _event(97, "ab12", 1, 6)]
    got = ingest.drop_duplicates(spark.createDataFrame(rows, S.MBP))
    assert got.schema.names == S.MBP.names
    want = [(i + 1, h) for i, h in enumerate(hashes)] + [(97, "ab12"), (98, "ab12")]
    assert sorted((r.rec_id, r.order_book_hash) for r in got.collect()) == want


def test_one_exchange(spark):
    rows = spark.createDataFrame([_event(i, "ab12") for i in range(50)], S.MBP)
    plan = ingest.drop_duplicates(rows).withColumn("one", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
