from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylight.functions.last_value import filled_forward

ROW = st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 50), st.one_of(st.none(), st.integers(0, 9)))


def check(spark, rows, parts):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, t long, v long, id long").repartition(parts)
    got = {r.id: r.f for r in filled_forward(df, "k", ["t", "id"], F.col("v"), "f").collect()}
    want, last = {}, {}
    for k, _, i, v in sorted(((k, t, i, v) for i, (k, t, v) in enumerate(rows)), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want


@given(st.lists(ROW, min_size=1, max_size=40))
@settings(max_examples=5, deadline=None)
def test_small(spark, rows):
    check(spark, rows, 3)


def test_one_key_over_many_ranges(spark):
    rows = [("a", t, t if t % 97 == 5 else None) for t in range(5000)] + [(None, 1, None), (None, 2, 7), ("z", 0, None)]
    check(spark, rows, 7)
    df = spark.createDataFrame(rows, "k string, t long, v long")
    assert filled_forward(df, "k", ["t"], F.col("v"), "f").groupBy("k").count().count() == 3


def test_a_busy_key_is_several_tasks(spark):
    df = spark.range(40000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") == 3, 1).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = filled_forward(df, "k", ["t"], F.col("v"), "f")
        sizes = [r[0] for r in done.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 40000 and done.where("f is null").count() == 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
