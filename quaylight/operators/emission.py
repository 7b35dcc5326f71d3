"""A result as ordered chunks: files of bounded size, a manifest of them, and a reader that can stop and go on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieve import write_result

MANIFEST = "number bigint, file string, n_records bigint, first_ts bigint, last_ts bigint, n_before bigint"


@dataclass(frozen=True)
class Chunk:
    """``number`` counts from 0; a reader that has taken in this chunk goes on after it. ``n_before``: records in the chunks
    before. ``records``: its rows, in order if collected or iterated over as they are."""

    number: int
    n_records: int
    first_ts: int
    last_ts: int
    n_before: int
    records: DataFrame


def emit(result: DataFrame, path: str, time: str = "ts_recv", records_per_file: int = 1_000_000) -> DataFrame:
    """Write an ordered result to ``path`` as files of at most so many records and return their manifest, which is written
    beside them last: a result without one is not whole. A row a file is all that the driver ever holds."""
    write_result(result, f"{path}/records", records_per_file)
    rows = result.sparkSession.read.schema(result.schema).parquet(f"{path}/records")
    by_file = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_records"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    # Names go up with the task and then with the file of it, as the records do.
    order = Window.orderBy("file")
    before = F.coalesce(F.sum("n_records").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = by_file.select((F.row_number().over(order) - 1).cast("long").alias("number"), "file", "n_records", "first_ts", "last_ts", before.cast("long").alias("n_before"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest(result.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """number, file, n_records, first_ts, last_ts and n_before of each chunk."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def chunks(spark: SparkSession, path: str, after: int = -1, from_ts: int | None = None) -> Iterator[Chunk]:
    """The result's chunks in order, one at a time: those after chunk ``after``, and with ``from_ts`` without those that end
    before it. Nothing is read until a chunk's records are."""
    listed = manifest(spark, path).where(F.col("number") > after)
    if from_ts is not None:
        listed = listed.where(F.col("last_ts") >= from_ts)
    schema = spark.read.parquet(f"{path}/records").schema
    for r in listed.orderBy("number").toLocalIterator():
        rows = spark.read.schema(schema).parquet(f"{path}/records/{r.file}")
        place = F.col("_metadata.row_index").alias("_row")
        records = rows.select("*", place).coalesce(1).sortWithinPartitions("_row").drop("_row")
        yield Chunk(r.number, r.n_records, r.first_ts, r.last_ts, r.n_before, records)


def steps_between(listed: DataFrame) -> DataFrame:
    """Chunks that begin before the chunk before them has ended."""
    return listed.withColumn("before", F.lag("last_ts").over(Window.orderBy("number"))).where("first_ts < before").drop("before")
