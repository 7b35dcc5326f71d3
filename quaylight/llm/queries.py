"""The registered queries of this subpackage and their SQL, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chunkdedup, convrepair, exactdedup, langid, linededup, merkle, mixing, packing, quality, simhash, tokencounts, topk, toxicity
from .shared import documents

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), VOCABULARY, capacity=2048)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir), size=3, radius=3)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeated_runs(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir), PIECES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_bitmaps(documents(spark, sf_dir), min_chars=20, min_docs=3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.context_limits(tokencounts.length_histogram(documents(spark, sf_dir), VOCABULARY))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pfair(documents(spark, sf_dir).select("doc_id", "source"), block=16)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return convrepair.repair_report(said, convrepair.damage(said))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_simhash_near_dedup,
        op3_substring_dedup,
        op4_exact_dedup,
        op5_toxicity,
        op6_language_id,
        op7_line_dedup,
        op8_token_counts,
        op9_source_mixing,
        op10_exact_top_k,
        op11_quality_classifier,
        op12_merkle_manifest,
        op13_conversation_repair,
    )
}
SQL = {
    "op4_exact_dedup": exactdedup.EXACT_SQL,
    "op7_line_dedup": linededup.LINES_SQL,
    "op9_source_mixing": mixing.MIX_SQL,
    "op10_exact_top_k": topk.TOP_K_SQL,
    "op12_merkle_manifest": merkle.MERKLE_SQL,
    "op13_conversation_repair": convrepair.REPAIR_SQL,
}
