"""SimHash near-duplicates with BK-trees.

64-bit fingerprints of word shingles link at ``radius`` or fewer differing bits. Two such fingerprints agree on
at least ``blocks - radius`` of ``blocks`` bit blocks, so each distinct fingerprint is filed under every choice of
``blocks - radius`` blocks and any linked pair meets in a bucket. A bucket of more than ``shard`` fingerprints falls
apart by its other bits, and what is still larger is dealt out in shards. Each shard has a BK-tree (children keyed by
their Hamming distance to the parent); the fingerprints of later shards of its bucket come by and follow only edges
within the radius. They come in groups of shards, each of which brings a tree of its own, so that no task has to see a
whole bucket. They travel to the trees by the shuffle instead of the driver: a broadcast of all
trees would pass every fingerprint through the driver and grow with the corpus. Links to a root leave, not pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import materialize
from .tokens import release, slices

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SEED = 42
_CHUNK = 1 << 16
#: What tells cells apart: a way to choose bits, their values, a shard of the bucket and a group of its probes.
_CELL = ("choice", "bits", "i", "probes")


def fingerprint(text: str, size: int) -> int:
    """Unsigned 64-bit SimHash of one text: a bit is set if it is set in over half of the shingles' XXH64."""
    words = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        part = words[lo : min(n, lo + _CHUNK) + size - 1]
        runs = [part[i : len(part) - size + 1 + i] for i in range(size)] if len(part) >= size else None
        texts = map(" ".join, zip(*runs)) if runs else [" ".join(part)]
        hashes = np.fromiter((digest(t, _SEED) for t in texts), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; null or wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = np.fromiter((fingerprint(t, size) for part in slices(x.as_py() for x in batch.column(1)) for t in part), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints under a root; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self._children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a value that is not in the tree yet; its number."""
        new = len(self.values)
        if new:
            at = 0
            while (nxt := self._children[at].get(d := (self.values[at] ^ value).bit_count())) is not None:
                at = nxt
            self._children[at][d] = new
        self.values.append(value)
        self._children.append({})
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of all values at most ``radius`` bits away; only edges d - radius to d + radius are followed."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self._children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [c for e, c in below.items() if -radius <= e - d <= radius]
            else:
                todo += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return found


class _Shard:
    """A shard's BK-tree, and which of its fingerprints are linked; probes come by and only links to a root leave."""

    def __init__(self, radius: int):
        self._tree, self._boss, self._radius = BKTree(), [], radius

    def _top(self, i: int) -> int:
        boss = self._boss
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    def _join(self, near: list[int]) -> int:
        least = min(map(self._top, near))
        for j in near:
            self._boss[self._top(j)] = least
        return least

    def add(self, value: int) -> None:
        near = self._tree.within(value, self._radius)
        self._boss.append(self._tree.add(value))
        if near:
            self._join([*near, len(self._boss) - 1])

    def probe(self, value: int) -> int | None:
        """What the value links to; all that it is near to is linked from now on."""
        near = self._tree.within(value, self._radius)
        return self._tree.values[self._join(near)] if near else None

    def links(self) -> Iterator[tuple[int, int]]:
        for i, v in enumerate(self._tree.values):
            if (t := self._top(i)) != i:
                yield v, self._tree.values[t]


def _walk(radius: int):
    """Rows arrive sorted by cell, first a shard's own fingerprints, then those of a group of later shards of its bucket,
    which stream past its tree; a task holds one tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shard, now = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            cells = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _CELL], axis=1)
            second = batch.column("second").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(fp)] if len(fp) else []
            for lo, hi in zip(edges, edges[1:]):
                if (cell := cells[lo].tolist()) != now:
                    out += shard.links() if shard else ()
                    shard, now = _Shard(radius), cell
                own = lo + int(np.count_nonzero(~second[lo:hi]))
                for v in fp[lo:own].tolist():
                    shard.add(v)
                out += [(v, near) for v in fp[own:hi].tolist() if (near := shard.probe(v)) is not None]
            if out:
                yield _pairs(out)
        if shard and (out := list(shard.links())):
            yield _pairs(out)

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, dtype=np.uint64).view(np.int64) for x in zip(*links))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(bits: list[int], parts: int) -> list[int]:
    """Masks of so many runs of the bits, of about equal length."""
    edges = [round(len(bits) * i / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def bucket_cells(values: DataFrame, radius: int = 3, blocks: int = 5, shard: int = 4096, group: int = 8) -> DataFrame:
    """(choice, bits, i, probes, second, fp): each shard i of a bucket with its own fingerprints and, as ``second``, those
    of the bucket's later shards, so that any two fingerprints within the radius meet in a cell. Probes are dealt out by
    groups of so many shards, each with a copy of the shard: a cell has about (group + 1) * shard rows at most, however
    large the bucket is."""
    if not radius < blocks <= 64:
        raise ValueError("blocks must be more than the radius")
    runs = _split(list(range(64)), blocks)
    masks = [sum(runs[b] for b in choice) for choice in combinations(range(blocks), blocks - radius)]
    finer = [_split([b for b in range(64) if not m >> b & 1], radius + 1) for m in masks]

    def sized(filed: DataFrame) -> DataFrame:
        return filed.join(filed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"), ["choice", "bits"])

    filed = sized(values.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "bits")))
    # In a bucket of more than a shard, two that are linked differ in ``radius`` of the other bits at most, so they agree on
    # one of radius + 1 parts of them, and the bucket falls apart into smaller ones by these parts.
    parts = F.array(*(F.array(*(F.lit(_signed(m)) for m in ms)) for ms in finer))[F.col("choice")]
    parted = filed.where(F.col("n") > shard).select("fp", "choice", "bits", F.posexplode(F.transform(parts, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "rest"))
    kind = (F.lit(len(masks)) + F.col("choice") * (radius + 1) + F.col("part")).cast("int").alias("choice")
    again = sized(parted.select("fp", kind, F.xxhash64("bits", "rest").alias("bits")))
    met = filed.where(F.col("n") <= shard).select("fp", "choice", "bits", "n").unionByName(again.select("fp", "choice", "bits", "n"))
    shards = F.ceil(F.col("n") / shard).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    at = F.expr(f"mine div {group}").cast("int")
    copies = F.sequence(at, F.expr(f"(shards - 1) div {group}").cast("int"))
    own = F.transform(copies, lambda p: F.struct(F.col("mine").alias("i"), p.alias("probes"), F.lit(False).alias("second")))
    earlier = F.filter(F.sequence(F.lit(0), F.col("mine")), lambda i: i < F.col("mine"))
    probing = F.transform(earlier, lambda i: F.struct(i.alias("i"), at.alias("probes"), F.lit(True).alias("second")))
    return (
        met.withColumn("shards", shards)
        .withColumn("mine", mine)
        .select("choice", "bits", "fp", F.inline(F.concat(own, probing)))
        .select(*_CELL, "second", "fp")
    )


def near_links(values: DataFrame, radius: int = 3, blocks: int = 5, shard: int = 4096) -> DataFrame:
    """Links (a, b) that connect exactly the distinct ``values.fp`` within the radius of one another, transitively."""
    cells = bucket_cells(values, radius, blocks, shard)
    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "second", "fp").mapInArrow(_walk(radius), "a long, b long")


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 3, blocks: int = 5, shard: int = 4096) -> DataFrame:
    """Near-duplicate groups of whole texts.

    ``docs`` needs doc_id and text; other columns are not read. Returns a row for each input row: doc_id,
    fingerprint (16 lower-case hex digits), component_id (the smallest doc_id reachable over links, its own
    included). Null and wordless texts have the fingerprint zero and link like any other. A row whose doc_id is
    null gets the smallest id of its group, null only if the group has none. Repeated rows come back as often as
    they came. An empty table gives no rows. A very long text takes the memory of its words in one task.
    """
    fps, _ = materialize(fingerprints(docs, size), "simhash-fp")
    roots, _ = components(near_links(fps.select("fp").distinct(), radius, blocks, shard))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(labels, "fp").select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay: the one with the smallest doc_id of each near-duplicate group, all columns kept.

    A row whose doc_id is null belongs to no group and stays; rows that share a doc_id stay or go together.
    """
    kept = simhash_groups(docs.where("doc_id is not null"), **how).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").unionByName(docs.where("doc_id is null"))
