"""Exact top-k by distributed histogram selection.

Queries go in blocks of a bounded number, each broadcast to the tasks that hold candidates. Every candidate is
scored against every query of the block. A round bins scores for each query between two bounds that hold its kth
highest score; tasks send the counts of the highest bins that reach k, which are summed over tasks, and the bin
with the kth score becomes the next bounds, until it is one score wide. A last pass filters: what is above the kth
score, and of the ties at it the smallest ids; it is appended to a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import exists, new_path

_EXACT = 1 << 53
_SIGN = 1 << 63
_CELLS = 2_000_000
_FOUND = "query_id long, vec_id long, score long"


def quantize(vectors: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """floor(scale * x) of each vector without nulls, as doubles by length: (row numbers by length, matrices).

    Vectors that are null, empty, or hold a null or a number that is not finite are left out. A finite one whose product
    with the scale is beyond a double is an OverflowError: it would have scores, but none that we can tell.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    rows, mats = {}, {}
    for n in np.unique(lengths):
        if n:
            at = np.flatnonzero(lengths == n)
            x = values[starts[at][:, None] + np.arange(n)]
            with np.errstate(over="ignore"):
                m = np.floor(scale * x)
            good = np.isfinite(x).all(axis=1)
            if not np.isfinite(m[good]).all():
                raise OverflowError("a component times the scale is beyond a double")
            rows[int(n)], mats[int(n)] = at[good], m[good]
    return rows, mats


@dataclass(frozen=True)
class Block:
    """Queries of one length: ids, vectors, and for each the bounds [low, top] that hold its kth highest score. Scores
    are kept as unsigned longs with 2^63 added, so that differences of any two of them fit."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    top: np.ndarray
    above: np.ndarray  #: how many candidates score over ``top``


def _scores(block: Block, ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Inner products (queries × candidates), with 2^63 added; exact, as products of doubles are below 2^53, or by
    integers. A score beyond a long is an OverflowError, but for a query's own row, which is no candidate."""
    bound = float(np.abs(block.vectors).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * matrix.shape[1]
    if bound < _EXACT:
        return (block.vectors @ matrix.T).astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    q, c = ([[int(x) for x in row] for row in m] for m in (block.vectors, matrix))
    whole = [[sum(a * b for a, b in zip(x, y)) + _SIGN if i != j else 0 for j, y in zip(ids, c)] for i, x in zip(block.ids, q)]
    if any(not 0 <= s < 2 * _SIGN for row in whole for s in row):
        raise OverflowError("a score is beyond a long")
    return np.array(whole, dtype=np.uint64).reshape(len(q), len(c))


def _parts(batches: Iterator[pa.RecordBatch], block: Block, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of candidates of the block's length, in runs that bound the score matrix."""
    size = max(1, _CELLS // max(1, len(block.ids)))
    for batch in batches:
        rows, mats = quantize(batch.column(1), scale)
        n = block.vectors.shape[1]
        if n in mats:
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows[n]]
            for lo in range(0, len(ids), size):
                yield ids[lo : lo + size], _scores(block, ids[lo : lo + size], mats[n][lo : lo + size])


def _width(block: Block, bins: int) -> np.ndarray:
    return (block.top - block.low) // np.uint64(bins) + np.uint64(1)


def _histogram(shared, k: int, bins: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        nq = len(block.ids)
        low, top, width = block.low[:, None], block.top[:, None], _width(block, bins)[:, None]
        counts = np.zeros(nq * bins, dtype=np.int64)
        for ids, scores in _parts(batches, block, scale):
            at = ((np.maximum(scores, low) - low) // width).astype(np.int64)
            ok = (scores >= low) & (scores <= top) & (ids[None, :] != block.ids[:, None])
            counts += np.bincount((at + bins * np.arange(nq)[:, None])[ok], minlength=nq * bins)
        counts = counts.reshape(nq, bins)
        over = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (over < k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b], pa.int64())], names=["q", "bin", "n"])

    return run


def _filter(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        ties: dict[int, np.ndarray] = {}
        for ids, scores in _parts(batches, block, scale):
            own = ids[None, :] == block.ids[:, None]
            q, c = np.nonzero((scores > block.top[:, None]) & ~own)
            yield _rows(block.ids[q], ids[c], scores[q, c])
            tied = (scores == block.top[:, None]) & ~own
            for i in np.flatnonzero(tied.any(axis=1)):
                ties[i] = np.sort(np.concatenate([ties.get(i, np.zeros(0, np.int64)), ids[tied[i]]]))[:k]
        for i, ids in ties.items():
            yield _rows(np.full(len(ids), block.ids[i]), ids, np.full(len(ids), block.top[i], dtype=np.uint64))

    return run


def _rows(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    signed = (s ^ np.uint64(_SIGN)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (q, v, signed)], names=["query_id", "vec_id", "score"])


def _refine(candidates: DataFrame, block: Block, k: int, bins: int, scale: int) -> Block:
    """One round: histogram, and the bin that holds each query's kth highest score."""
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(block)
    counts = candidates.mapInArrow(_histogram(shared, k, bins, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    over = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
    cut = counts.withColumn("upto", over).join(spark.createDataFrame([(i, int(a)) for i, a in enumerate(block.above)], "q int, above long").hint("broadcast"), "q")
    reached = F.col("upto") + F.col("above") >= k
    found = cut.groupBy("q").agg(F.max(F.when(reached, F.col("bin"))).alias("bin"), F.max(F.when(~reached, F.col("upto"))).alias("before")).collect()
    shared.destroy()
    low, top, above = block.low.copy(), block.top.copy(), block.above.copy()
    width = _width(block, bins)
    short = np.ones(len(block.ids), dtype=bool)
    for r in found:
        if r.bin is not None:
            short[r.q] = False
            low[r.q] = block.low[r.q] + np.uint64(r.bin) * width[r.q]
            top[r.q] = low[r.q] + min(width[r.q] - np.uint64(1), block.top[r.q] - low[r.q])
            above[r.q] = block.above[r.q] + (r.before or 0)
    low[short] = top[short] = 0  # fewer than k candidates: all of them count, those over the lowest long and ties at it
    return replace(block, low=low, top=top, above=above)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, bins: int = 2048, block: int = 1024) -> DataFrame:
    """Each query's ``k`` highest integer inner products over all other rows.

    ``vectors`` and ``queries`` need vec_id and embedding; other columns are not read. Components are
    floor(scale * x). Candidates are all rows whose vec_id is not the query's own. Returns query_id, rank (from 1),
    vec_id, score; equal scores rank by the smaller vec_id; fewer rows if there are fewer candidates.

    Vectors that are null or empty or hold null or non-finite components take no part, nor do null ids. Only vectors
    of the query's length are its candidates. A repeated query row asks once; a repeated candidate row counts
    each time. An empty table gives no rows. A score that a long can't hold is an OverflowError, and so is a component that
    a double can't hold once it is scaled; all other scores are exact.

    The query set is read in blocks of ``block`` rows, so what is broadcast and what the driver holds at a time is
    bounded, and each block's rows are written before the next begins. A block reads the candidates three to five
    times, one job after another; scoring 1024 queries costs far more than reading a candidate, so larger blocks would
    save little. A million queries are about 1000 blocks.
    """
    spark = vectors.sparkSession
    candidates = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding")
    asked = queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    path = None
    for some in _blocks(asked, scale, block):
        path = path or new_path(spark, "top-k")
        _select(candidates, some, k, bins, scale, path)
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spark.read.schema(_FOUND).parquet(path).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, scale: int, size: int) -> Iterator[Block]:
    """Queries arrive at the driver a partition at a time and leave it in blocks of one length."""
    waiting: dict[int, dict[int, np.ndarray]] = {}

    def block(n: int) -> Block:
        some = waiting.pop(n)
        lots = np.zeros(len(some), dtype=np.int64)
        return Block(np.array(list(some)), np.stack(list(some.values())), lots.view(np.uint64), lots.view(np.uint64), lots)

    for row in asked.dropDuplicates(["vec_id"]).toLocalIterator():
        rows, mats = quantize(pa.array([row.embedding], pa.list_(pa.float64())), scale)
        for n, m in mats.items():
            if len(m):
                mine = waiting.setdefault(n, {})
                mine[row.vec_id] = m[0]
                if len(mine) >= size:
                    yield block(n)
    for n in list(waiting):
        yield block(n)


def _select(candidates: DataFrame, block: Block, k: int, bins: int, scale: int, path: str) -> None:
    """Append the block's rows to the table at ``path``: each task's k best at most, and ties."""
    spark = candidates.sparkSession
    # By Cauchy and Schwarz no score is beyond the product of the norms; the longest candidate bounds them all.
    size = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * scale) + 1, F.lit(2.0)))
    longest = candidates.where(F.size("embedding") == block.vectors.shape[1]).agg(F.max(F.when(~F.isnan(size), size))).first()[0]
    if longest is None:
        return
    reach = np.minimum(np.ceil(np.linalg.norm(block.vectors, axis=1) * np.sqrt(longest)) * (1 + 1e-9) + 2, float(_SIGN))
    far = [min(int(r), _SIGN) for r in reach]
    low, top = (np.array(x, dtype=np.uint64) for x in ([_SIGN - r for r in far], [min(_SIGN + r, 2 * _SIGN - 1) for r in far]))
    block = replace(block, low=low, top=top)
    while (block.top > block.low).any():
        block = _refine(candidates, block, k, bins, scale)
    shared = spark.sparkContext.broadcast(block)
    candidates.mapInArrow(_filter(shared, k, scale), _FOUND).write.mode("append").parquet(path)
    shared.destroy()


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
