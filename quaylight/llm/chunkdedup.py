"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; where it falls below a threshold, a chunk may end. Cuts depend
on a few bytes before them and on nothing else, so an insertion moves only the chunks around it, and two documents
that share a passage share its inner chunks wherever it stands. Chunks are counted by digest over all documents;
neighbouring chunks that other documents hold too form runs, and runs that are long enough are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, wrapped
from .tokens import release, slices

_CHUNKS = "doc_id long, start long, length int, d1 long, d2 long"
#: A pseudo-random 16-bit number for each byte value, by rule.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) & 0xFFFF for b in range(256)], dtype=np.uint16)


@dataclass(frozen=True)
class Settings:
    """A byte may end a chunk with probability ``chance``; it does if the last ``shortest`` bytes before it could
    not. Chunks over ``longest`` bytes are cut into pieces of it. ``run`` bytes of neighbouring repeated chunks are
    reported: a repeated passage loses about a chunk at either end, so passages of some 50 words (300 bytes) and more
    have such a run, and single short lines have not."""

    chance: float = 1 / 20
    shortest: int = 12
    longest: int = 256
    run: int = 120


def gear(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: twice the hash before plus the byte's number, so that a byte is shifted
    out after 16 steps. Windows of 1, 2, 4, 8 and 16 bytes are added up, each from the one before."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8):
        longer = h.copy()
        longer[w:] += h[:-w] << np.uint16(w)
        h = longer
    return h


def cuts(data: np.ndarray, settings: Settings) -> np.ndarray:
    """Where chunks end, the end of the text included; increasing."""
    may = np.flatnonzero(gear(data) < int(65536 * settings.chance)) + 1
    ends = may[np.diff(may, prepend=-settings.shortest) >= settings.shortest]
    ends = np.unique(np.append(ends, len(data)))
    starts = np.concatenate([[0], ends[:-1]])
    if len(long := np.flatnonzero(ends - starts > settings.longest)):
        more = [np.arange(starts[i] + settings.longest, ends[i], settings.longest) for i in long]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, length in bytes, 128-bit digest as two longs) of each chunk; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for part in slices(x.as_py() for x in batch.column(1)):
                docs_, starts, lengths, found = [], [], [], []
                for t in part:
                    doc, raw = next(ids), t.encode()
                    if not raw:
                        continue
                    end = cuts(np.frombuffer(raw, dtype=np.uint8), settings)
                    start = np.concatenate([[0], end[:-1]])
                    found += [digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]
                    docs_.append(np.full(len(end), doc, dtype=np.int64))
                    starts.append(start)
                    lengths.append(end - start)
                if found:
                    both = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
                    cols = [np.concatenate(docs_), np.concatenate(starts), np.concatenate(lengths).astype(np.int32), both[:, 0].copy(), both[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "start", "length", "d1", "d2"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CHUNKS)


def repeated_runs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Runs of neighbouring chunks that other documents hold too.

    ``docs`` needs doc_id and text; other columns are not read. Returns a row for each run of ``settings.run`` bytes
    or more: doc_id, start and length (bytes of the UTF-8 text), n_chunks, keep_id (the smallest doc_id that holds
    one of its chunks) and n_removed (bytes of chunks whose first holder is another document; 0 where all stays).

    Chunks repeated within one document only, and rows without a doc_id, take no part; rows that share a doc_id are
    one document. Null and empty texts have no chunks. An empty table gives no rows. A chunk's first holder is the
    smallest doc_id. Digests are counted before the shuffle and joined by Spark's skew-splitting join, so a passage
    that a third of all documents hold is no single task's work. A very long text is cut in the memory of its bytes.
    """
    cut = chunks(docs, settings)
    often = cut.groupBy("d1", "d2").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last_id")).where("keep_id <> last_id")
    keys, _ = materialize(often.select("d1", "d2", "keep_id"), "chunk-keys")
    shared = cut.join(keys, ["d1", "d2"]).select("doc_id", "start", "length", "keep_id").distinct()
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    end = F.col("start") + F.col("length")
    breaks = F.when(F.col("start") == F.lag(end).over(by_doc), 0).otherwise(1)
    runs = shared.withColumn("new", breaks).withColumn("run", F.sum("new").over(by_doc))
    lost = F.when(F.col("keep_id") != F.col("doc_id"), F.col("length")).otherwise(0)
    return (
        runs.groupBy("doc_id", "run")
        .agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.count("*").alias("n_chunks"), F.min("keep_id").alias("keep_id"), F.sum(lost).alias("n_removed"))
        .where(F.col("length") >= settings.run)
        .select("doc_id", "start", "length", "n_chunks", "keep_id", "n_removed")
    )


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (all columns) with text cut: runs that an earlier document holds are taken out of later ones.

    A run goes whole if all its chunks have an earlier holder; runs that are partly their document's own stay.
    Documents keep their rows, even if nothing is left; texts without such a run, null and empty ones stay as they are.
    Spans are shifted to whole characters. Input columns may have any names. Rows that share a doc_id have all spans of
    that doc_id, so they should be repeated rows. A very long text is one task's work. An empty table gives no rows.
    """
    gone = repeated_runs(docs, settings).where("n_removed = length").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    joined = wrapped(docs).join(gone, F.col("row.doc_id") == gone["doc_id"], "left").select("row", "spans")

    @F.pandas_udf("string")
    def cut_out(text, spans):
        def one(t, found):
            raw, out, at = t.encode(), [], 0
            for s in found:
                a, b = s["start"], min(len(raw), s["start"] + s["length"])
                while a < len(raw) and a > at and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b += 1
                out.append(raw[at:a])
                at = max(at, b)
            return b"".join([*out, raw[at:]]).decode()

        return text.where(spans.isna() | text.isna(), [one(t, s) if t is not None and s is not None else t for t, s in zip(text, spans)])

    shorter = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut_out(F.col("row.text"), F.col("spans")))
    return joined.select(*((shorter if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))
