import threading

from pyspark.sql import functions as F

from quaylight.llm import exactdedup, mixing, shared

from .util import HARD, hard


def test_a_scratch_is_its_thread_s_own(spark):
    """What another thread writes while a scratch is open outlives it; what its own thread writes does not."""
    made = {}

    def other():
        made["df"], made["path"] = shared.materialize(spark.range(5), "other")

    with shared.scratch(spark):
        _, mine = shared.materialize(spark.range(3), "mine")
        with shared.scratch(spark):
            _, inner = shared.materialize(spark.range(3), "inner")
        assert not shared.exists(spark, inner) and shared.exists(spark, mine)
        t = threading.Thread(target=other)
        t.start()
        t.join()
    assert not shared.exists(spark, mine) and made["df"].count() == 5
    shared.discard(spark, [made["path"]])


def test_exact_dedup_with_a_column_called_metadata(spark, tmp_path):
    path = str(tmp_path / "docs")
    hard(spark).withColumn("_metadata", F.lit("clash")).coalesce(2).write.parquet(path)
    got = exactdedup.exact_duplicates(spark, path).collect()
    assert len(got) == len(HARD) and sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_rows_that_are_the_same_are_many_tasks_work(spark):
    same = spark.range(60000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("t").alias("text"))
    docs = same.unionByName(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("u").alias("text"))).repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.pfair(docs, block=7)
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 0.6 * sum(sizes) and sum(sizes) == 60003
        assert got.select("mix_slot", "mix_place").distinct().count() == 60003
        assert [r.mix_place for r in got.where("doc_id is not null").orderBy("doc_id").collect()] == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_thousands_of_sources(spark):
    """A block or two of each of 3000 sources, against one loop over all slots."""
    from .test_mixture_deadlines import slots_by_force

    weights = {f"s{i:05d}": 50 + i * 7919 % 200 for i in range(3000)}
    blocks = {k: 1 + w % 2 for k, w in weights.items()}
    got = mixing.deadlines(spark, weights, blocks).collect()
    assert sorted((r.mix_slot, r.key, r.mix_block) for r in got) == [(t, k, b) for k, b, t in slots_by_force(weights, blocks)]
