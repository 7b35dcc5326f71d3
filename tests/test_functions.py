import hashlib
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.functions.book import book_hash
from quaylight.functions.last_value import fill_forward, last_non_null
from quaylight.functions.timeutil import bucket_end, bucket_start, display_time, end_of_day, floor_day


def test_buckets_are_exact(spark):
    i = S.SECOND
    ts = [k * i + d for k in (0, 1, 1_704_209_103, 9_000_000_000) for d in (0, 1, 127, i - 1)]
    got = spark.createDataFrame([(t,) for t in ts], "t long").select("t", bucket_start("t", i).alias("a"), bucket_end("t", i).alias("b")).collect()
    for r in got:
        assert r.a == r.t // i * i and (r.t == 0 or r.b == -(-r.t // i) * i)


@given(st.integers(0, 2**62))
@settings(max_examples=200)
def test_days(t):
    assert floor_day(t) <= t < end_of_day(t) == floor_day(t) + S.DAY


_signed, _unsigned = st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**32 - 1)
_level = st.tuples(_signed, _signed, _unsigned, _unsigned, _unsigned, _unsigned)


@given(st.lists(st.lists(_level, max_size=3), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_book_hash(spark, books):
    rows = [(i, [(d, bp, bs, bc, ap, as_, ac) for d, (bp, ap, bs, as_, bc, ac) in enumerate(b)]) for i, b in enumerate(books)]
    got = {r.i: r.h for r in spark.createDataFrame(rows, S.columns("i int, levels levels", levels=S.LEVELS)).select("i", book_hash(F.col("levels")).alias("h")).collect()}
    for i, b in enumerate(books):
        assert got[i] == hashlib.sha256(b"".join(struct.pack(">qqIIII", *x) for x in b)).hexdigest()


def test_last_values(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 7), (1, 4, None), (2, 1, None)], "g int, t int, v int")
    assert {r.g: r.v for r in df.groupBy("g").agg(last_non_null(F.col("v"), F.col("t")).alias("v")).collect()} == {1: 7, 2: None}
    w = Window.partitionBy("g").orderBy("t")
    assert [r.v for r in df.withColumn("v", fill_forward(F.col("v"), w)).orderBy("g", "t").collect()] == [5, 5, 7, 7, None]


def test_display_time(spark):
    assert spark.range(1).select(display_time(F.lit(1_704_067_200_000_000_999)).cast("string").alias("t")).first().t == "2024-01-01 00:00:00"
