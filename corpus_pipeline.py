"""A corpus from documents to packed sequences: language, repeated lines, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import langid, linededup, mixing, nearcopies, packing
from quaylight.llm.shared import discard, materialize, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A document stays if its best language has at least this posterior.
SURE = 0.5
#: Documents of a block of the mixture, and those that are packed together.
BLOCK, RUN = 16, 1024


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is likelier than all others together, go; lang becomes
    the predicted language. A document that has no model to judge it stays if it has a letter. Learns from the
    documents it is given. Null and empty texts go; repeated rows stay or go alike; rows without a doc_id are judged
    like any; columns besides those of documents are left out here and in all stages; no documents give none."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, PIECES)
    found = langid.predict_rows(docs, model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)) if model else found.where(F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.col("lang_pred") if model else F.col("lang")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold are kept in the largest doc_id only; all documents stay, as empty texts if no line
    does. A null text becomes empty; rows without a doc_id keep all lines; rows that share one are one document."""
    done = linededup.dedup_lines(docs.select(*COLUMNS), min_chars=20, min_docs=3)
    return done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked by a Jaccard similarity of five-word shingles of 0.8 or more, the smallest doc_id
    stays; documents without a word left are one group. Rows that share a doc_id stay or go together; rows without one
    belong to no group and stay."""
    return nearcopies.one_of_each(docs.select(*COLUMNS), size=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order in which sources interleave by their target weights: what is written stands in that
    order, file after file, and the packing stage goes by it. A null source is one of its own; a source's documents go by doc_id,
    nulls last, repeated rows each in a place of its own."""
    return mixing.lay_out(mixing.pfair(docs.select(*COLUMNS), BLOCK), COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, numbered in the order in which documents stand in their files, which is that of the
    mixture: each run of RUN documents (column ``run``) is packed by itself. Null and empty texts are the end id alone; long ones
    are cut into full pieces and a last one. Documents that come from no file stand as they come."""
    cut, _ = materialize(packing.cut_documents(mixing.standing(docs), VOCABULARY, capacity=2048, also=mixing.STANDS), "cut")
    return packing.pack_runs(mixing.runs(cut, RUN).select("run", "doc_id", F.inline("pieces")), capacity=2048)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", mixture),
    ("best-fit packing", packed),
]

#: No SQL: tokens, fingerprints and the language model are beyond it. Tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves in the scratch folder is deleted as soon as the next has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), leaves=True)
        discard(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
