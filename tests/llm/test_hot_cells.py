"""Hot buckets and hot lines are many tasks' work, and nothing is lost by it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.llm import linededup, simhash


def test_a_bucket_that_does_not_fall_apart_is_many_cells(spark):
    """100,000 fingerprints that agree on 44 bits, so that they share buckets, and parts of buckets, in many ways."""
    n, shard, group = 100_000, 512, 4
    values = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 20))).alias("fp")).distinct()
    cells = simhash.bucket_cells(values, shard=shard, group=group)
    sizes = cells.groupBy("choice", "bits", "i", "probes").agg(F.count("*").alias("n"), F.sum((~F.col("second")).cast("int")).alias("own"))
    most, own, least = sizes.agg(F.max("n"), F.max("own"), F.min("own")).first()
    assert most < 1.3 * (group + 1) * shard and own < 1.3 * shard and least > 0


@pytest.mark.parametrize(("shard", "group"), [(7, 1), (7, 3), (40, 2), (4096, 8)])
def test_every_pair_of_a_bucket_meets_in_a_cell(spark, shard, group):
    rng = np.random.default_rng(5)
    fps = sorted({int(v) for v in rng.integers(0, 1 << 11, 300)})
    cells = simhash.bucket_cells(spark.createDataFrame([(v,) for v in fps], "fp long"), shard=shard, group=group).collect()
    met, tree = set(), {}
    for r in cells:
        tree.setdefault((r.choice, r.bits, r.i, r.probes), ([], []))[r.second].append(r.fp)
    for own, probes in tree.values():
        met |= {(min(a, b), max(a, b)) for a in own for b in [*own, *probes] if a != b}
    near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert near and near <= met


def test_a_line_that_all_documents_hold_spreads(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the license line that all documents hold\n"), F.col("id").cast("string")).alias("text")).repartition(8)
    lines = linededup.long_lines(docs)
    assert [tuple(r)[2:] for r in linededup.repeated_keys(lines).collect()] == [(39_999,)]
    ranged = lines.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange(8, "h1", "h2", "salt")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
    plan = linededup.repeated_keys(lines)._jdf.queryExecution().toString()
    assert plan.count("rangepartitioning") >= 1
