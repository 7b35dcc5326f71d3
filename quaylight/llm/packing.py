"""Best-fit packing by sums of squares: documents' tokens into sequences of a fixed length.

One stage tokenizes and writes the table of pieces (some 30 bytes each); no text and no ids are shuffled. A second
stage, which holds no tokenizer, packs: each of its partitions packs the pieces that it reads. Spark sorts them by
length, longest first (spilling if need be), and the packer streams over them; its memory is the list of open
sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import encoder, release, slices

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"
_IMPOSSIBLE = 1 << 60


class SumOfSquares:
    """Places items one by one. ``count[g]`` is the number of open bins whose residual gap is g; an item goes to
    the gap that leaves the sum of the squared counts smallest (ties: the smallest gap), and to a new bin only
    if it fits in no open one."""

    def __init__(self, capacity: int, first_bin: int = 0):
        self.capacity = capacity
        self._count = np.zeros(capacity + 1, dtype=np.int64)
        self._bins: dict[int, list[int]] = {}
        self._next = first_bin

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        if not 0 < size <= self.capacity:
            raise ValueError(f"an item of {size} can't go into a bin of {self.capacity}")
        here = self._count[size : self.capacity]
        if here.any():
            # (n - 1)^2 + (m + 1)^2 - n^2 - m^2 = 2 (m - n + 1) for the gap left and the gap made; a gap of
            # nothing is no gap, so a perfect fit costs 1 - 2 n.
            cost = 2 * (self._count[: self.capacity - size] - here + 1)
            cost[0] = 1 - 2 * here[0]
            cost[here == 0] = _IMPOSSIBLE
            left = int(cost.argmin())
            bin_id = self._bins[size + left].pop()
            self._count[size + left] -= 1
            offset = self.capacity - size - left
        else:
            bin_id, offset, left = self._next, 0, self.capacity - size
            self._next += 1
        if left:
            self._bins.setdefault(left, []).append(bin_id)
            self._count[left] += 1
        return bin_id, offset


def _cut(vocabulary: str, capacity: int, end_id: int):
    """Tokenize whole texts (the last column), add the end id and cut what is longer than a sequence."""
    end = int(end_id).to_bytes(4, "little")
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            done, others = 0, batch.columns[:-1]
            for texts in slices(x.as_py() for x in batch.column(batch.num_columns - 1)):
                cut = []
                for raw in enc.encode(texts):
                    raw += end
                    parts = [(start, raw[4 * start : 4 * (start + capacity)]) for start in range(0, len(raw) // 4, capacity)]
                    cut.append([{"piece": i, "start": s, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for i, (s, x) in enumerate(parts)])
                yield pa.RecordBatch.from_arrays([*(c[done : done + len(texts)] for c in others), pa.array(cut, kind)], names=[*batch.schema.names[:-1], "pieces"])
                done += len(texts)

    return run


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, also: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns of ``also`` (name → type), and pieces (piece, start, length, ids_crc32) for each document."""
    also = also or {}
    kind = ", ".join(["doc_id long", *(f"{c} {t}" for c, t in also.items()), "pieces array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"])
    return docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast(t) for c, t in also.items()), "text").mapInArrow(_cut(vocabulary, capacity, end_id), kind)


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            if placed:
                seq, off = (pa.array(c, pa.int64()) for c in zip(*placed))
                yield pa.RecordBatch.from_arrays([*batch.columns, seq, off], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not read. ``vocabulary`` is the path
    of a `tokenizers` file, which the executors must see. A document is its ids and then ``end_id``; only longer
    ones are cut, into full pieces and a last one. Returns a row a piece: doc_id, piece, start, length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit), sequence_id, offset (gapless from 0).

    A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed as often as they
    come; their pieces then share doc_id and piece. An empty table gives no rows. A long text takes the memory of
    its own ids. Pieces of equal length go by doc_id, piece and checksum. Sequence numbers are unique; they depend on
    how the table of pieces is read.
    """
    pieces = cut_documents(docs, vocabulary, capacity, end_id).select("doc_id", F.inline("pieces"))
    table, _ = materialize(pieces, "pieces")
    return table.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32").mapInArrow(_pack(capacity), _PACKED)


def _pack_runs(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        packer, now = None, None
        for batch in batches:
            placed = []
            for r, n in zip(batch.column("run").to_pylist(), batch.column("length").to_pylist()):
                if r != now:
                    packer, now = SumOfSquares(capacity, r << 32), r
                placed.append(packer.place(n))
            if placed:
                seq, off = (pa.array(c, pa.int64()) for c in zip(*placed))
                rest = batch.drop_columns(["run"])
                yield pa.RecordBatch.from_arrays([*rest.columns, seq, off, batch.column("run")], names=[*rest.schema.names, "sequence_id", "offset", "run"])

    return run


def pack_runs(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pack each ``run`` (long, from 0) of ``pieces`` (run and the columns of a piece) by itself, so that sequences rise
    with the runs, however the input is partitioned. Returns what pack_documents does, and the run; the price is about
    one part-filled sequence a run. Nulls, ties and repeated rows are as there; no run is null."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    dealt = pieces.select("run", *names).repartitionByRange("run")
    return dealt.sortWithinPartitions("run", F.desc("length"), "doc_id", "piece", "ids_crc32").mapInArrow(_pack_runs(capacity), _PACKED + ", run long")
