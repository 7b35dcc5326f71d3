"""What the mixture lays out is what is packed: all documents, in the order of its files, whatever their ids."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quaylight.llm import mixing, packing
from quaylight.llm.shared import materialize

from .util import empty, hard


def documents(spark):
    """Documents of two sources, a third of them without an id and the others in pairs that share one; checksums tell them apart."""
    text = F.concat(F.repeat(F.lit("word "), F.expr("cast(id % 40 as int)")), F.col("id").cast("string"))
    source = F.when(F.col("id") % 4 == 0, "a").otherwise("b")
    shared = F.expr("CASE WHEN id % 3 > 0 THEN id div 6 END")
    return spark.range(4000).repartition(3).select(shared.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), source.alias("source"), F.length(text).cast("long").alias("n_chars"))


def test_all_columns_of_all_documents_stay(spark):
    for docs in (documents(spark), hard(spark).select(*corpus_pipeline.COLUMNS), empty(spark)):
        mixed, _ = materialize(corpus_pipeline.mixture(spark, docs, ""), "mixed")
        assert mixed.exceptAll(docs).isEmpty() and docs.exceptAll(mixed).isEmpty()


def test_runs_are_those_of_the_mixture_whatever_the_ids(spark):
    docs, _ = materialize(documents(spark), "docs")
    place = mixing.pfair(docs, corpus_pipeline.BLOCK)
    told = packing.cut_documents(place.select("doc_id", "text", "mix_slot", "mix_place"), corpus_pipeline.VOCABULARY, also={"mix_slot": "long", "mix_place": "long"})
    order = [r.c for r in told.orderBy("mix_slot", "mix_place").select(F.expr("pieces[0].ids_crc32").alias("c")).collect()]
    assert len(set(order)) == len(order) == 4000
    laid = corpus_pipeline.mixture(spark, docs, "")
    for mixed in (materialize(laid, "mixed")[0], laid):
        got = {r.ids_crc32: r.run for r in corpus_pipeline.packed(spark, mixed, "").collect()}
        assert got == {c: i // corpus_pipeline.RUN for i, c in enumerate(order)}


def test_packing_goes_by_the_files_and_mixes_nothing_again(spark, tmp_path, monkeypatch):
    """The order of files counts, not that in which their sizes have them read; more files than five digits count go on in order."""
    rows = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(90).collect()
    path, order = tmp_path / "mixed", []
    path.mkdir()
    for number, n in ((9, 3), (99_999, 50), (100_000, 37)):
        part = spark.createDataFrame(rows[len(order) : len(order) + n]).coalesce(1)
        part.write.parquet(str(tmp_path / f"w{number}"))
        (made,) = (tmp_path / f"w{number}").glob("part-*.parquet")
        (path / made.name.replace("part-00000", f"part-{number:05d}")).write_bytes(made.read_bytes())
        order += [r.doc_id for r in rows[len(order) : len(order) + n]]
    monkeypatch.setattr(corpus_pipeline, "RUN", 10)
    monkeypatch.setattr(mixing, "pfair", None)
    got = corpus_pipeline.packed(spark, spark.read.parquet(str(path)), "").collect()
    assert {r.doc_id: r.run for r in got} == {d: i // 10 for i, d in enumerate(order)}
    assert max(Counter(r.run for r in got).values()) == 10
