"""Exact length histogram: documents counted by encoded length; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder, slices


def _lengths(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            found = [len(raw) // 4 for texts in slices(x.as_py() for x in batch.column(1)) for raw in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["part", "n_tokens"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str, by: str = "source") -> DataFrame:
    """Count documents by (``by``, encoded length).

    Returns ``by``, n_tokens, n_docs. Counts are exact and add up before the shuffle, so a hot group sends a row
    for each length and task. A null or empty text has length 0; a null group is a group. Repeated rows count as
    often as they come; an empty table gives an empty histogram; other columns are not read. A very long text takes the
    memory of its words and ids in one task.
    """
    encoded = docs.select(F.col(by).cast("string").alias("part"), "text").mapInArrow(_lengths(vocabulary), "part string, n_tokens long")
    return encoded.groupBy("part", "n_tokens").agg(F.count("*").alias("n_docs")).withColumnRenamed("part", by)


def context_limits(histogram: DataFrame, by: str = "source") -> DataFrame:
    """What each observed length means as a context limit, by suffix sums over the histogram.

    Adds to each (``by``, n_tokens, n_docs): docs_ge and tokens_ge (documents at least that long, and their
    tokens), truncated_total (tokens of the group if each document is cut to n_tokens), total_docs,
    total_tokens, and quantile (the share of documents no longer than n_tokens). A limit L between two observed
    lengths has the suffix sums of the next longer one: its truncated total is
    total_tokens - tokens_ge + L * docs_ge there; the windows see a row for each length, never documents.
    """
    tokens = F.col("n_docs") * F.col("n_tokens")
    suffix = Window.partitionBy(by).orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    return (
        histogram.withColumn("docs_ge", F.sum("n_docs").over(suffix))
        .withColumn("tokens_ge", F.sum(tokens).over(suffix))
        .withColumn("total_docs", F.sum("n_docs").over(whole))
        .withColumn("total_tokens", F.sum(tokens).over(whole))
        .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge"))
        .withColumn("quantile", (F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("total_docs"))
    )


def at_limits(histogram: DataFrame, limits: list[int], by: str = "source") -> DataFrame:
    """For each group and each of the given context limits, observed or not: docs_over (documents longer than the limit)
    and truncated_total (the group's tokens if each document is cut to it)."""
    at = histogram.withColumn("context_limit", F.explode(F.array(*map(F.lit, limits)).cast("array<bigint>")))
    over = F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0))
    total = F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs"))
    return at.groupBy(by, "context_limit").agg(over.alias("docs_over"), total.alias("truncated_total"))
