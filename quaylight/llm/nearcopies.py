"""Near copies by SimHash and BK-trees, held to an exact Jaccard similarity of word shingles.

Fingerprints alone can't find texts of a Jaccard similarity of 0.8: these differ in some 10 of 64 bits, and within so wide
a radius neither bit blocks nor a BK-tree over all texts rule much out. So texts meet in buckets first: those of one
least shingle under each of ROWS orders, BANDS times over. In a bucket a BK-tree over the SimHash fingerprints names those within
RADIUS bits, and only these are compared, shingle by shingle. At a similarity of just 0.8 two texts share a bucket with a
chance of 0.98 and are within the radius with one of over 0.99; nearer ones are missed less.

Texts of one set of shingles are one class from the start, whatever their number, and only classes that share a bucket with
another class bring their shingles along. A bucket that is large in classes or in shingles is dealt out in shards; each has a
tree, which the later shards of the bucket pass in groups. Links to a root leave, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import materialize
from .simhash import _CHUNK, _LOWER, _SEED, _WORD, BKTree
from .tokens import release, slices

BANDS, ROWS = 4, 2
#: Bits: the mean of 9.7 at a similarity of 0.8, and 3.6 standard deviations; of unlike texts 1 in 400 is as near.
RADIUS = 20
#: Orders of the shingles: their hashes times an odd number.
_ORDERS = np.array([xxhash.xxh64_intdigest(f"order {i}") | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)
_KEYS = [f"k{i}" for i in range(BANDS)]
_CELL = ["band", "key", "i", "probes"]


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles: of all words if there are fewer, none if there is none."""
    words = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    n = max(1, len(words) - size + 1) if words else 0
    hashed, found = xxhash.xxh64_intdigest, []
    for lo in range(0, n, _CHUNK):
        part = words[lo : min(n, lo + _CHUNK) + size - 1]
        texts = map(" ".join, zip(*(part[i : len(part) - size + 1 + i] for i in range(size)))) if len(part) >= size else [" ".join(part)]
        found.append(np.fromiter((hashed(t, _SEED) for t in texts), dtype=np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets that are not both empty."""
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (len(a) + len(b) - common)


def digest(found: np.ndarray) -> list[int]:
    """128 bits of a set, as two signed longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(found.astype("<u8").tobytes()), dtype="<i8").tolist()


def sketch(found: np.ndarray) -> list[int]:
    """d0, d1 (a 128-bit digest of the set), n, fp (SimHash) and a key for each band, as signed longs; no shingle gives 0."""
    d, n = digest(found), len(found)
    if not n:
        return [*d, 0, 0, *[0] * BANDS]
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        counts += np.unpackbits(found[lo : lo + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])
    least = np.array([(found * m).min() for m in _ORDERS], dtype="<u8").reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in least], dtype=np.uint64).view(np.int64)
    return [*d, n, fp, *keys.tolist()]


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, d0, d1, n, fp, k0, ...) of each row."""
    names = ["doc_id", "d0", "d1", "n", "fp", *_KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = [sketch(shingles(t, size)) for part in slices(x.as_py() for x in batch.column(1)) for t in part]
            table = np.array(rows, dtype=np.int64).reshape(len(rows), len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, d0, d1, found): the shingles themselves, as bytes; rows leave one by one where texts are long."""
    names = ["doc_id", "d0", "d1", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at = 0
            for part in slices(x.as_py() for x in batch.column(1)):
                all_found = [shingles(t, size) for t in part]
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                d = [digest(f) for f in all_found]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array([f.tobytes() for f in all_found], pa.binary())], names=names
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, d0 long, d1 long, found binary")


class _Tree(BKTree):
    """A BK-tree of fingerprints with the classes that have them."""

    def __init__(self):
        super().__init__()
        self._at: dict[int, int] = {}
        self._classes: list[list[int]] = []
        self.size = 0

    def file(self, fp: int, i: int) -> None:
        if fp not in self._at:
            self._at[fp] = self.add(fp)
            self._classes.append([])
        self._classes[self._at[fp]].append(i)
        self.size += 1

    def near(self, fp: int, radius: int) -> Iterator[int]:
        """Classes at most ``radius`` bits away, one by one: who has seen enough need not walk the rest."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ fp).bit_count()
            if d <= radius:
                yield from self._classes[at]
            todo += [c for e, c in self._children[at].items() if -radius <= e - d <= radius]

    def take(self, other: _Tree) -> None:
        for fp, at in other._at.items():
            for i in other._classes[at]:
                self.file(fp, i)


class _Shard:
    """A shard's classes: a BK-tree of those that link to no other yet, and one of each linked group. Of a group one
    member that is near is enough, so a large group of near copies costs a few comparisons a probe."""

    def __init__(self, similarity: float, radius: int):
        self._similarity, self._radius = similarity, radius
        self._loose, self._groups = _Tree(), {}
        self._ids: list[int] = []
        self._fps: list[int] = []
        self._found: list[np.ndarray] = []
        self._boss: list[int] = []

    def _top(self, i: int) -> int:
        boss = self._boss
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    def _alike(self, i: int, found: np.ndarray) -> bool:
        other = self._found[i]
        few, many = sorted((len(other), len(found)))
        return few / many >= self._similarity and jaccard(other, found) >= self._similarity

    def _near(self, fp: int, found: np.ndarray) -> list[int]:
        """Tops of the groups, and the loose classes, that are near."""
        loose = [i for i in self._loose.near(fp, self._radius) if self._boss[i] == i and i not in self._groups and self._alike(i, found)]
        return loose + [top for top, tree in self._groups.items() if any(self._alike(i, found) for i in tree.near(fp, self._radius))]

    def _join(self, near: list[int]) -> int:
        """Make one group of groups and loose classes; its top, that of the largest."""
        if len(near) == 1:
            return near[0]
        trees = {t: self._groups.pop(t, None) for t in near}
        top = max(near, key=lambda t: trees[t].size if trees[t] else 0)
        mine = trees[top] or _Tree()
        for t in near:
            self._boss[t] = top
            if trees[t] is None:
                mine.file(self._fps[t], t)
            elif t != top:
                mine.take(trees[t])
        self._groups[top] = mine
        return top

    def add(self, doc_id: int, fp: int, found: np.ndarray) -> None:
        near, new = self._near(fp, found), len(self._ids)
        self._ids.append(doc_id)
        self._fps.append(fp)
        self._found.append(found)
        self._boss.append(new)
        if near:
            self._join([*near, new])
        else:
            self._loose.file(fp, new)

    def probe(self, fp: int, found: np.ndarray) -> int | None:
        """The doc_id that it links to; all that it is near to is linked from now on."""
        near = self._near(fp, found)
        return self._ids[self._join(near)] if near else None

    def links(self) -> Iterator[tuple[int, int]]:
        for i, doc_id in enumerate(self._ids):
            if (t := self._top(i)) != i:
                yield doc_id, self._ids[t]


def _walk(similarity: float, radius: int):
    """Rows arrive sorted by cell, a shard's own classes first; a task holds one shard at a time. A class that comes
    more than once (a repeated row) is met once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shard, now, last = None, None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in (*_CELL, "second", "rep", "d0", "d1", "fp")]
            found = batch.column("found")
            for k, (*cell, second, rep, d0, d1, fp) in enumerate(zip(*columns)):
                if cell != now:
                    out += shard.links() if shard else ()
                    shard, now, last = _Shard(similarity, radius), cell, None
                if (this := (second, rep, d0, d1)) == last:
                    continue
                last = this
                mine = np.frombuffer(found[k].as_py(), dtype=np.uint64)
                if not second:
                    shard.add(rep, fp & (1 << 64) - 1, mine)
                elif (near := shard.probe(fp & (1 << 64) - 1, mine)) is not None:
                    out.append((rep, near))
            if out:
                yield _pairs(out)
        if shard and (out := list(shard.links())):
            yield _pairs(out)

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def shared_buckets(classes: DataFrame, similarity: float, shard: int, held: int) -> DataFrame:
    """(rep, d0, d1, fp, band, key, shards, mine): each class in each bucket that it shares with another class. A shard has
    about ``shard`` classes and ``held`` shingles at most (one that has more by itself aside)."""
    # The smaller of two unequal sets has n of at most n + 1 shingles in common.
    filed = classes.where(F.col("n") / (F.col("n") + 1) >= similarity).select("rep", "d0", "d1", "n", "fp", F.posexplode(F.array(*_KEYS)).alias("band", "key"))
    sizes = filed.groupBy("band", "key").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    shards = F.ceil(F.greatest(F.col("members") / shard, F.col("total") / held)).cast("int")
    met = filed.join(sizes, ["band", "key"]).withColumn("shards", shards)
    return met.select("rep", "d0", "d1", "fp", "band", "key", "shards", F.pmod(F.xxhash64("d0", "d1"), "shards").cast("int").alias("mine"))


def near_links(docs: DataFrame, classes: DataFrame, size: int, similarity: float, radius: int = RADIUS, shard: int = 4096, held: int = 1 << 21, group: int = 8) -> DataFrame:
    """Links (a, b) of classes' doc_ids that connect what is as near as the similarity, in buckets that are shared."""
    met, _ = materialize(shared_buckets(classes, similarity, shard, held), "near-buckets")
    needed = met.select(F.col("rep").alias("_rep")).distinct()
    sets = _sets(docs.join(needed, F.col("doc_id").cast("long") == F.col("_rep"), "left_semi"), size)
    at = F.expr(f"mine div {group}").cast("int")
    copies = F.sequence(at, F.expr(f"(shards - 1) div {group}").cast("int"))
    own = F.transform(copies, lambda p: F.struct(F.col("mine").alias("i"), p.alias("probes"), F.lit(False).alias("second")))
    earlier = F.filter(F.sequence(F.lit(0), F.col("mine")), lambda i: i < F.col("mine"))
    probing = F.transform(earlier, lambda i: F.struct(i.alias("i"), at.alias("probes"), F.lit(True).alias("second")))
    brought = met.join(sets.withColumnRenamed("doc_id", "rep"), ["rep", "d0", "d1"])
    cells = brought.select("band", "key", "rep", "d0", "d1", "fp", "found", F.inline(F.concat(own, probing)))
    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "second", "rep", "d0", "d1").mapInArrow(_walk(similarity, radius), "a long, b long")


def _rooted(docs: DataFrame, size: int, similarity: float, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of the rows, their classes, and (node, root) of classes' doc_ids that are linked to others."""
    rows, _ = materialize(sketches(docs, size), "near-sketches")
    # All but doc_id follow from the set of shingles: grouping by longs alone is an aggregation by hash.
    classes, _ = materialize(rows.groupBy("d0", "d1", "n", "fp", *_KEYS).agg(F.min("doc_id").alias("rep")), "near-classes")
    several = rows.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("d0", "d1") for f in (F.min, F.max))).where("min_d0 <> max_d0 or min_d1 <> max_d1")
    named = rows.join(several, "doc_id", "left_semi").join(classes.select("d0", "d1", "rep"), ["d0", "d1"])
    same_id = named.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = near_links(docs, classes, size, similarity, **how).unionByName(same_id)
    return rows, classes, components(links)[0]


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """Groups of documents that are linked by an exact Jaccard similarity of ``size``-word shingles of ``similarity`` or more.

    ``docs`` needs doc_id and text; other columns are not read. Returns a row for each row that has a doc_id: doc_id and
    component_id (the smallest doc_id reachable over links, its own included). Null and wordless texts are one group. Fewer
    words than ``size`` are one shingle. Rows of one doc_id are one document, whatever their texts. An empty table gives no
    rows. A very long text takes the memory of its words in one task.
    """
    rows, classes, roots = _rooted(docs.where("doc_id is not null"), size, similarity, **how)
    least = classes.join(roots, classes["rep"] == roots["node"], "left").select("d0", "d1", F.coalesce("root", "rep").alias("component_id"))
    return rows.join(least, ["d0", "d1"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """The documents that stay: the one with the smallest doc_id of each group of ``near_groups``, all columns kept. A row
    whose doc_id is null belongs to no group and stays; rows that share a doc_id stay or go together."""
    _, classes, roots = _rooted(docs.where("doc_id is not null").select("doc_id", "text"), size, similarity, **how)
    under = roots.where("node <> root").select("node")
    kept = classes.select(F.col("rep").alias("_kept")).distinct().join(under, F.col("_kept") == F.col("node"), "left_anti")
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").unionByName(docs.where("doc_id is null"))
