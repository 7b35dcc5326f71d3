from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quaylight.llm.shared import materialize

from .test_packing_tokens import check_packing
from .util import empty, hard


def test_sequences_follow_the_mixture_after_write_and_reread(spark):
    counts = {"a": 4500, "b": 2000, "c": 500}
    rows = [(i * 10_000 + k, ("long " if s == "a" else "short ") * (60 if s == "a" else 6), "en", s, 1) for i, (s, n) in enumerate(counts.items()) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed, _ = materialize(corpus_pipeline.mixture(spark, docs, ""), "mixed")
    got = corpus_pipeline.packed(spark, mixed, "").orderBy("sequence_id", "offset").collect()
    assert len(got) == len(rows)
    total, seen = sum(n**0.5 for n in counts.values()), Counter()
    for m, r in enumerate(got, 1):
        seen["abc"[r.doc_id // 10_000]] += 1
        if m in (1024, 2048):  # whole runs, before a source has run out
            assert all(abs(seen[s] - m * n**0.5 / total) < 2 * 16 for s, n in counts.items())


def test_packing_by_runs_hard_cases(spark):
    docs = hard(spark).select(*corpus_pipeline.COLUMNS)
    check_packing([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.packed(spark, docs, "").collect(), 2048)
    assert corpus_pipeline.packed(spark, empty(spark), "").count() == 0
    many = docs.where("doc_id = 8").crossJoin(spark.range(41).select(F.col("id").alias("copy"))).withColumn("doc_id", F.col("copy")).select(*corpus_pipeline.COLUMNS)
    rows = corpus_pipeline.packed(spark, many, "").collect()
    assert {(r.doc_id, r.piece) for r in rows} == {(d, p) for d in range(41) for p in range(-(-30001 // 2048))} and len(rows) == 41 * 15
