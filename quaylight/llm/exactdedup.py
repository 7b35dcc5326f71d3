"""Exact dedup by a stateful stream, in DataFrame functions only.

A streaming aggregation without a watermark keeps, for each digest of a normalised text, the stable identifier and
the content locator (file and row) of the row that stays, and a count. The state lives on disk (RocksDB) and is
checkpointed to the shared folder; it never expires, so later runs over new files continue it. Results are read
from the state. Every hit is then compared byte for byte with the text that the locator names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, discard, materialize, new_path

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Each state partition would set some megabytes of disk aside for its logs, whatever it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Each run of the named white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _seen(frame: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, and who: doc_id (nulls last) and where the row's content lies; the scan's metadata is asked for before
    the text is touched, since it belongs to the scan."""
    place = frame.metadataColumn("_metadata")  # also where the table has a column of that name
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return frame.select(who.alias("who"), "text").select("who", digest(normalised(F.col("text"))).alias("digest"))


def update_state(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> None:
    """Stream what is new under ``path`` (Parquet) into the keyed state at ``state``; safe to repeat."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may also name a single file
    keyed = _seen(reader.parquet(glob), digest).groupBy("digest").agg(F.min("who").alias("keeper"), F.count("*").alias("n"))
    with _settings(spark, _STATE):
        query = keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state's rows: digest, keeper, n."""
    with _settings(spark, _STATE):
        kept = spark.read.format("statestore").load(state)
        value = [f.name for f in kept.schema["value"].dataType.fields]
        return kept.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("keeper"), F.col(f"value.`{value[1]}`").alias("n"))


def exact_duplicates(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """A row for each row of the Parquet table at ``path``, dropped ones too: doc_id, keep_id, group_size, kept,
    text_sha256.

    The table needs doc_id and text; other columns are not read. Texts are equal if their normalised forms are;
    of equal texts the smallest doc_id stays (null ids last; of rows that share it, the first by file and row, so
    exactly one row of a group is kept). Null texts equal empty ones. An empty table gives no rows. Very long texts take
    their own memory in one task, as they do in the scan. If texts
    share a digest without being equal, their rows are grouped by the whole text instead.
    """
    state = new_path(spark, "exact-state")
    update_state(spark, path, state, digest, files_per_batch)
    states, _ = materialize(read_state(spark, state), "exact-keys")
    discard(spark, [state])
    found, _ = materialize(_seen(spark.read.parquet(path), digest).join(states, "digest"), "exact-rows")

    # Hits and the rows they hit, with their texts; rows meet their texts by locator, which is spread evenly.
    wanted = found.where("n > 1").select(F.col("who.file").alias("file"), F.col("who.row").alias("row"), "who", "keeper", "digest")
    table = spark.read.parquet(path)
    place = table.metadataColumn("_metadata")
    placed = table.select(place["file_path"].alias("file"), place["row_index"].alias("row"), "text")
    texts, texts_path = materialize(placed.join(wanted, ["file", "row"]).select("digest", "who", "keeper", normalised(F.col("text")).alias("norm")), "exact-texts")
    holders = texts.where("who = keeper").select("digest", F.col("norm").alias("held"))
    differ = texts.where("who <> keeper").join(holders, "digest").where("norm <> held")
    # Not made distinct here: that would tie the join to one task for each digest, and Spark could not split hot ones.
    clashes, _ = materialize(differ.select("digest"), "exact-clashes")

    result = found
    if not clashes.isEmpty():
        again = texts.join(clashes, "digest", "left_semi")
        groups = again.groupBy("digest", "norm").agg(F.min("who").alias("keeper"), F.count("*").alias("n"))
        redone = again.drop("keeper").join(groups, ["digest", "norm"]).select("digest", "who", "keeper", "n")
        result = found.join(clashes, "digest", "left_anti").unionByName(redone)
    else:
        discard(spark, [texts_path])
    return result.select(
        F.col("who.doc_id").alias("doc_id"),
        F.col("keeper.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("who") == F.col("keeper")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
