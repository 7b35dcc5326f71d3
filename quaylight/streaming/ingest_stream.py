"""Ingest of records as they arrive: a file stream whose batches go through the bulk load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions.timeutil import display_time
from ..operators.ingest import bulk_load


def record_stream(spark: SparkSession, path: str, file_format: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format(file_format).schema(S.RAW).option("maxFilesPerTrigger", files_per_batch).load(path)


def start_ingest(records: DataFrame, store: str, instruments: DataFrame, checkpoint: str, name: str = "stream", duplicates: str = "drop", trigger: dict | None = None) -> StreamingQuery:
    """Load each micro-batch as a load of its own. A batch that is replayed has the same load_id: if it was published
    it is done already, if not it overwrites its own partition, so replays leave no duplicates."""

    def load(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            bulk_load(batch, store, instruments, f"{name}-{batch_id:012d}", duplicates)

    return records.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def recent_duplicates_dropped(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events (with order_book_hash) without repeats that come within the delay of one another; state
    older than the watermark is let go. Nanoseconds stay beside the watermark's timestamp."""
    timed = events.withColumn("arrived_at", display_time("ts_recv"))
    return timed.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["dataset", *S.EVENT_KEY]).drop("arrived_at")
