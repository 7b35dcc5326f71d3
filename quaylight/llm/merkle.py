"""Merkle manifest of a table by time-forward processing.

Each row's digest is a leaf. A group's leaves in their order, and then the groups' roots, are folded in runs of ``arity``
until one node remains. Every node has a label, the last leaf below it and then its level, so that children come
before their parents. A sweep in the order of labels takes nodes as they come; each sends its digest to its parent through a
priority queue ordered by label, which holds a few messages a level. A sweep in the reversed order sends each node the
suffix of its proof (the siblings from there to the root), and leaves receive whole proofs.

Nodes are swept in blocks of ``arity`` ** h consecutive ones, many a task. What goes from block to block is addressed to
(group, block) and delivered in the order of labels by Spark's sort: that is the queue's external part, and it spills as
any shuffle. A block's top is a node of the next, some hundred times smaller table, so three tables serve 10^7 leaves
and five 10^10. No task sees more than its blocks, however large a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, refuse, wrapped
from .tokens import release

#: Nodes of a block at most.
BLOCK = 256
ADDS = ("subroot", "root", "proof")
_PROOF = "array<struct<left: string, right: string>>"
_TYPES = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
Steps = tuple[str, str, "Steps"] | None


def leaf_digest(values: dict[str, Column | None] | list[str], schema: T.StructType) -> Column:
    """SHA-256 in hex over the columns one after another: "-" for null, else the count of UTF-8 bytes, ":" and the
    value, integers in decimal. A dict names columns and what to put in place of one (None: the column itself)."""
    values = dict.fromkeys(values) if isinstance(values, list) else values
    for name in values:
        if not isinstance(schema[name].dataType, _TYPES):
            raise TypeError(f"column {name} is neither text nor an integer")
    texts = [(F.col(f"`{n}`") if c is None else c).cast("string") for n, c in values.items()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def fold(leaves: Sequence[str], levels: int, arity: int = 2) -> list[list[str]]:
    """The digests of each level's nodes, from the leaves up, by one sweep in the order of labels."""
    nodes: list[list[str]] = [list(leaves), *([] for _ in range(levels))]
    queue: list[tuple[int, int, int, str]] = []

    def send(level: int, index: int, digest: str) -> None:
        if level < levels:
            last = min((index // arity + 1) * arity ** (level + 1), len(leaves)) - 1
            heapq.heappush(queue, (last, level + 1, index, digest))

    for now, leaf in enumerate(leaves):
        send(0, now, leaf)
        while queue and queue[0][0] == now:
            label, got = queue[0][:2], []
            while queue and queue[0][:2] == label:
                got.append(heapq.heappop(queue)[3])
            nodes[label[1]].append(_h("".join(got)))
            send(label[1], len(nodes[label[1]]) - 1, nodes[label[1]][-1])
    return nodes


def unfold(nodes: list[list[str]], suffix: Steps, arity: int = 2) -> list[Steps]:
    """Each leaf's proof, by one sweep in the reversed order: (digests left of it, right of it, the parent's proof)."""
    proofs: list[Steps] = [None] * len(nodes[0])
    queue: list[tuple[int, int, int, Steps]] = [(1 - len(nodes[0]), 1 - len(nodes), 0, suffix)]
    while queue:
        _, level, index, steps = heapq.heappop(queue)
        if not level:
            proofs[index] = steps
            continue
        level = -level - 1
        first, below = index * arity, nodes[level][index * arity : (index + 1) * arity]
        for i in range(len(below)):
            last = min((first + i + 1) * arity**level, len(nodes[0])) - 1
            heapq.heappush(queue, (-last, -level, first + i, ("".join(below[:i]), "".join(below[i + 1 :]), steps)))
    return proofs


def _height(n: int, arity: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def _whole_blocks(batches: Iterator[pa.RecordBatch], heads: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """Rows of one or more whole blocks; ``heads`` marks the first row of each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = np.flatnonzero(heads(batch))
        if not len(at):
            held.append(batch)
            continue
        held.append(batch.slice(0, int(at[-1])))
        if any(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(int(at[-1]))]
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _rise(arity: int, depth: int):
    """Nodes by (g, rank), whole blocks together: the top of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        size = arity**depth
        for table in _whole_blocks(batches, lambda b: b.column("rank").to_numpy() % size == 0):
            rank, n, digest = table["rank"].to_numpy(), table["n"].to_numpy(), table["digest"].to_pylist()
            starts = np.flatnonzero(rank % size == 0)
            tops = [fold(digest[lo:hi], min(depth, _height(int(n[lo]), arity)), arity)[-1][0] for lo, hi in pairwise([*starts.tolist(), len(rank)])]
            yield pa.RecordBatch.from_arrays([table["g"].combine_chunks().take(pa.array(starts)), pa.array(rank[starts] // size), pa.array(-(-n[starts] // size)), pa.array(tops, pa.string())], names=["g", "rank", "n", "digest"])

    return run


def _sink(arity: int, depth: int):
    """Each block's head, which brings the proof of its top, and then its nodes: the nodes with their proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in _whole_blocks(batches, lambda b: b.column("head").to_numpy(zero_copy_only=False)):
            head = table["head"].combine_chunks().to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(head)
            brought, tops = table["proof"].combine_chunks().take(pa.array(heads)).to_pylist(), table["top"].combine_chunks().take(pa.array(heads))
            n, digest = table["n"].to_numpy(), table["digest"].to_pylist()
            ends, left, right, mine = [0], [], [], []
            for b, (at, hi) in enumerate(pairwise([*heads.tolist(), len(head)])):
                lo, suffix = at + 1, None
                for s in reversed(brought[b]):
                    suffix = (s["left"], s["right"], suffix)
                nodes = fold(digest[lo:hi], min(depth, _height(int(n[lo]), arity)), arity)
                for steps in unfold(nodes, suffix, arity):
                    while steps:
                        left.append(steps[0])
                        right.append(steps[1])
                        steps = steps[2]
                    ends.append(len(left))
                mine += [b] * (hi - lo)
            flat = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
            kept = table.filter(pa.array(~head)).combine_chunks()
            cols = [kept[c].combine_chunks() for c in ("g", "rank", "row")]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), tops.take(pa.array(mine, pa.int64()))], names=["g", "rank", "row", "proof", "top"])

    return run


def _ranked(rows: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``rows`` (g, digest, row) with their rank within g, nulls first and equal rows in any order, and the group's size n.
    They are sorted by ranges of (g, order, digest), as many as the data asks for; a rank is the place in the range after the
    group's rows in the ranges before."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("g").asc_nulls_first(), *order, F.col("digest"), F.col("tie")]
    laid, _ = materialize(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33).alias("part")
    ranges = laid.groupBy("g", part).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select(F.col("g").alias("of"), F.col("part").alias("of_part"), (before - F.col("first")).alias("shift"), F.sum("size").over(Window.partitionBy("g")).alias("n"))
    placed = laid.withColumn("part", part).join(shifts, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return placed.select("g", (F.col("at") + F.col("shift")).alias("rank"), "n", "digest", "row")


def _tower(nodes: DataFrame, arity: int, depth: int, label: str) -> list[DataFrame]:
    """Tables of nodes from ``nodes`` (g, rank, n, digest, row) up to one node for each g."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        last = found[-1].select("g", "rank", "n", "digest").withColumn("block", F.call_function("div", F.col("rank"), F.lit(arity**depth).cast("long")))
        laid = last.repartition("g", "block").sortWithinPartitions("g", "block", "rank").select("g", "rank", "n", "digest")
        found.append(materialize(laid.mapInArrow(_rise(arity, depth), "g string, rank long, n long, digest string"), label)[0])
    return found


def _proofs(tables: list[DataFrame], tops: DataFrame, arity: int, depth: int) -> DataFrame:
    """(g, rank, row, proof, top) of the first table's nodes; ``tops`` (g, proof, top) of each group's last one."""
    above = tables[-1].alias("t").join(tops.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of"))).select("g", "rank", *(["row"] if "row" in tables[-1].columns else []), "proof", "top")
    for nodes in reversed(tables[:-1]):
        row = F.col("row") if "row" in nodes.columns else F.lit(None).cast("string").alias("row")
        heads = above.select("g", F.col("rank").alias("block"), F.lit(True).alias("head"), "proof", "top")
        below = nodes.select("g", F.call_function("div", F.col("rank"), F.lit(arity**depth).cast("long")).alias("block"), F.lit(False).alias("head"), "rank", "n", "digest", row)
        laid = heads.unionByName(below, allowMissingColumns=True).repartition("g", "block").sortWithinPartitions("g", "block", F.desc("head"), "rank")
        kind = T.StructType([T.StructField("g", T.StringType()), T.StructField("rank", T.LongType()), below.schema["row"], tops.schema["proof"], tops.schema["top"]])
        above = laid.select("head", "g", "rank", "n", "digest", "row", "proof", "top").mapInArrow(_sink(arity, depth), kind)
    return above


def manifest(rows: DataFrame, group: str, order: str, digest: str = "leaf", arity: int = 2) -> DataFrame:
    """All columns of ``rows`` and subroot (the root of the row's group), root (of the groups' roots) and proof.

    A group's leaves come in the order of the long column ``order``, nulls first, then of their digests; groups by the text of
    ``group``, null first and then by UTF-8 bytes. A proof has a step for each level from the leaf to the root: the digests
    left and right of the node in its run, empty where there are none. ``folded`` goes through them.

    Every row is a leaf of its own, repeated rows too; a null group is one of its own, and a null digest is a leaf with an
    empty digest. Texts are not looked into. Columns may have any names but the three that are added, which are a
    ValueError. An empty table gives no rows. ``arity`` is 2 to ``BLOCK``.
    """
    refuse(rows, ADDS)
    if not 2 <= arity <= BLOCK:
        raise ValueError(f"arity is 2 to {BLOCK}")
    depth = max(d for d in range(1, 9) if arity**d <= BLOCK)
    field = lambda c: F.col("row").getField(c)
    leaves, _ = materialize(wrapped(rows).select(field(group).cast("string").alias("g"), F.coalesce(field(digest), F.lit("")).alias("digest"), "row"), "merkle-leaves")
    ranked, _ = materialize(_ranked(leaves, [F.col("row").getField(order).cast("long").asc_nulls_first()], "merkle-sorted"), "merkle-ranked")
    tables = _tower(ranked, arity, depth, "merkle-nodes")
    # The groups' roots are the leaves of one more tree.
    roots = tables[-1].select(F.lit("").alias("g"), "digest", F.struct(F.col("g").alias("of")).alias("row"))
    order_of = F.col("row").getField("of").asc_nulls_first()
    upper = _tower(materialize(_ranked(roots, [order_of], "merkle-sorted"), "merkle-ranked")[0], arity, depth, "merkle-nodes")
    whole = upper[-1].select("g", F.array().cast(_PROOF).alias("proof"), F.col("digest").alias("top"))
    down = _proofs(upper, whole, arity, depth)
    subroots = tables[-1].select(F.col("g").alias("name"), F.col("digest").alias("subroot"))
    met = down.select(F.col("row").getField("of").alias("g"), "proof", "top").join(subroots, F.col("g").eqNullSafe(F.col("name")))
    tops, _ = materialize(met.select("g", "proof", F.struct("subroot", F.col("top").alias("root")).alias("top")), "merkle-tops")
    done = _proofs(tables, tops, arity, depth)
    return done.select(*(field(c).alias(c) for c in rows.columns), "top.subroot", "top.root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 over a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document; where 7 divides the CRC-32 of
    doc_id, n_chars is one more when the root is folded again. A null doc_id or n_chars is not tampered with."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    tampered = dict.fromkeys(LEAF) | {"n_chars": F.col("n_chars") + 1}
    leaf = leaf_digest(LEAF, docs.schema)
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(hit, leaf_digest(tampered, docs.schema)).alias("tampered"))
    found = manifest(rows, "lang", "doc_id").withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = "list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1))), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), CAST(4294967295 AS BIGINT))"
_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
MERKLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang,
         sha256({" || ".join(_PART.format(c) for c in LEAF)}) AS leaf,
         CASE WHEN xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) % 7 = 0
              THEN sha256({" || ".join(_PART.format("(n_chars + 1)" if c == "n_chars" else c) for c in LEAF)}) END AS tampered
  FROM documents),
leaves AS (
  SELECT *, coalesce('+' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM rows),
low AS (
  SELECT g, 0 AS level, rank, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY g, level, rank // 2),
subroots AS (
  SELECT g, level AS height, digest AS subroot,
         row_number() OVER (ORDER BY CASE WHEN g = '-' THEN 0 ELSE 1 END, g) - 1 AS place, count(*) OVER () AS n
  FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place AS rank, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY level, rank // 2),
top AS (SELECT digest AS root FROM high WHERE n = 1),
steps AS (
  SELECT l.g, l.rank AS leaf_rank, s.level, coalesce(o.digest, '') AS digest, (l.rank >> s.level) % 2 = 1 AS before
  FROM leaves l JOIN subroots r ON l.g = r.g JOIN (SELECT DISTINCT g, level FROM low WHERE n > 1) s ON s.g = l.g
  LEFT JOIN low o ON o.g = l.g AND o.level = s.level AND o.rank = xor(l.rank >> s.level, 1)
  UNION ALL
  SELECT l.g, l.rank, r.height + s.level, coalesce(o.digest, ''), (r.place >> s.level) % 2 = 1
  FROM leaves l JOIN subroots r ON l.g = r.g CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) s
  LEFT JOIN high o ON o.level = s.level AND o.rank = xor(r.place >> s.level, 1)),
proofs AS (
  SELECT g, leaf_rank, list({{'digest': digest, 'before': before}} ORDER BY level) AS proof FROM steps GROUP BY g, leaf_rank),
folded AS (
  SELECT l.*, r.subroot, t.root, p.proof,
         list_reduce(list_transform(coalesce(p.proof, []), lambda s: [s.digest, CASE WHEN s.before THEN 'l' ELSE 'r' END]),
                     lambda a, s: [CASE WHEN s[2] = 'l' THEN sha256(s[1] || a[1]) ELSE sha256(a[1] || s[1]) END, ''],
                     [coalesce(l.tampered, l.leaf), ''])[1] AS folded_root
  FROM leaves l JOIN subroots r ON l.g = r.g CROSS JOIN top t LEFT JOIN proofs p ON p.g = l.g AND p.leaf_rank = l.rank)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda s: s.digest), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
