"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks of documents. With a share s of S slots, its block k is released at slot
floor(k S / s) and due by ceil((k + 1) S / s); at each slot the released block with the earliest deadline goes, so
after any number of slots a source is less than one block off its share. When a source runs out its slots stay
empty and the others go on in their proportion; no document is left out or repeated.

``pfair`` (op9 and the pipeline) takes exact weights in place of shares and lays out all slots. ``schedule`` rounds weights
down to whole slots of a period, one at least, so that it repeats: it lays one period out (a fold over S slots, one row)
and joins blocks to it, block k of a source to slot (k div s) S + slot(k mod s); from the weight w itself a source then
drifts by |s / S - w| a slot, without end.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .shared import materialize, refuse, wrapped

#: All sources' exact weights together, as ``pfair`` and ``spread`` count them.
UNITS = 10**9
#: Slots that one row of ``deadlines`` lays out at least.
STRETCH = 2048
#: Bytes after which its fold starts a new value, as adding to one copies it.
PART = 4096
#: Copies of a row that one row stands for while it is multiplied.
COPIES = 4096
ADDS = ("mix_block", "mix_slot", "mix_place", "mix_share", "mix_slots")


def source_key(source: Column) -> Column:
    """A key under which null is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def shares(counts: DataFrame, slots: int, weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """(key, share): whole shares of about ``slots`` slots, one at least for each source in ``counts`` (key, n).

    Targets are the given weights by source name (sources without one weigh nothing but their one slot), or the
    counts to the ``power``.
    """
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double")) if power == 0.5 else F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        table = F.create_map(*(F.lit(x) for k, v in sorted(weights.items()) for x in ("+" + k, float(v))))
        weight = F.coalesce(F.try_element_at(table, F.col("key")), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    total = weighed.agg(F.sum("weight").alias("total"))
    part = F.when(F.col("total") > 0, F.floor(slots * F.col("weight") / F.col("total"))).otherwise(0)
    return weighed.crossJoin(F.broadcast(total)).select("key", F.greatest(F.lit(1), part).cast("int").alias("share"))


def period(share: DataFrame) -> DataFrame:
    """One period of the schedule: (key, turn, slot, share, slots), a row for each slot.

    Earliest deadline first among released blocks, ties to the smaller key. The fold's state has an entry for each
    source, so this is for source lists (thousands at most), not for documents.
    """
    entry = F.struct("key", F.col("share").cast("long").alias("share"))
    one = share.agg(F.sort_array(F.collect_list(entry)).alias("src"), F.sum("share").cast("long").alias("slots")).where("slots > 0")
    fold = """
      aggregate(
        sequence(0L, slots - 1),
        named_struct('done', transform(src, x -> 0L), 'plan', cast(array() as array<int>)),
        (acc, t) -> transform(
          array(array_min(filter(
            transform(src, (x, i) -> named_struct(
              'due', ((acc.done[i] + 1) * slots + x.share - 1) div x.share,
              'i', i,
              'released', (acc.done[i] * slots) div x.share <= t AND acc.done[i] < x.share)),
            y -> y.released)).i),
          p -> named_struct(
            'done', transform(acc.done, (d, j) -> if(j = p, d + 1, d)),
            'plan', concat(acc.plan, array(p))))[0],
        acc -> acc.plan)
    """
    laid = one.select("src", "slots", F.posexplode(F.expr(fold)).alias("slot", "i")).select(F.col("src")[F.col("i")].alias("s"), "slot", "slots")
    turn = F.row_number().over(Window.partitionBy("s.key").orderBy("slot")) - 1
    return laid.select(F.col("s.key").alias("key"), turn.cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"), F.col("s.share").alias("share"), "slots")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, key, id, tie), the numbers of each id and tie in their source (key, id, tie, number of the first, n), and
    the sources' counts (key, n).

    Only ids are sorted: by ranges of (source, doc_id, hash of the row, place read), as many as the data asks for, so that
    neither a hot source nor rows without a doc_id meet in one task. A row's number is its place in its range after the
    source's rows in the ranges before. ``docs`` is read twice, but rows that are the same may come in any order.
    """
    hashed = [F.col("row").getField(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rows = wrapped(docs).select("row", source_key(F.col("row.source")).alias("key"), F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(*hashed).alias("tie"))
    # Ids that are the same are told apart by where they were read, so that many of them are several ranges.
    salted = rows.select("key", "id", "tie").withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("key"), F.col("id").asc_nulls_last(), F.col("tie"), F.col("salt")]
    ids, _ = materialize(salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id()), "mix-ids")
    part = F.shiftright("at", 33).alias("part")  # of the range sort
    ranges = ids.groupBy("key", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("key", "part", (before - F.col("first")).alias("shift"))
    numbers = ids.select("key", part, "id", "tie", "at").join(offsets, ["key", "part"]).select("key", "id", "tie", (F.col("at") + F.col("shift")).alias("number"))
    sure = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    firsts = numbers.groupBy("key", sure(F.col("id")).alias("id"), "tie").agg(F.min("number").alias("number"), F.count("*").alias("n"))
    return rows.withColumn("id", sure(F.col("id"))), firsts, ranges.groupBy("key").agg(F.sum("n").alias("n"))


def _placed(rows: DataFrame, firsts: DataFrame, turns: DataFrame, block: int) -> DataFrame:
    """``rows`` with what ``turns`` (key, mix_block, ...) says of their blocks, and mix_place.

    Numbers meet turns first, so that rows are shuffled once, to where their numbers are. Rows that are the same in all columns
    are counted there, multiplied again in pieces, so that no task sees all of them, and then meet turns themselves.
    """
    in_block = [F.expr(f"number div {block}").alias("mix_block"), (F.col("number") % block).alias("mix_place")]
    told = firsts.select("*", *in_block).join(turns, ["key", "mix_block"], "left")
    met = rows.join(told, ["key", "id", "tie"])
    out = ["row", "key", "mix_block", "mix_place", *(c for c in turns.columns if c not in ("key", "mix_block"))]
    same = met.where("n > 1").groupBy("key", "id", "tie", "number", "row").agg(F.count("*").alias("n"))
    # Rows that differ, but not in their hashes, follow one another.
    fields = [F.col("row").getField(f.name) for f in rows.schema["row"].dataType.fields if f.dataType.typeName() not in ("map", "variant")]
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("key", "id", "tie").orderBy(F.xxhash64(F.lit(1), *fields)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = same.withColumn("number", F.col("number") + ahead).withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition("key", "id", "tie", "piece")
    copies = pieces.withColumn("copy", F.explode(F.expr(f"sequence(piece * {COPIES}, least(n, (piece + 1) * {COPIES}) - 1)")))
    again = copies.select("row", "key", (F.col("number") + F.col("copy")).alias("number")).select("row", "key", *in_block).join(turns, ["key", "mix_block"])
    return met.where("n = 1").select(*out).unionByName(again.select(*out))


def schedule(docs: DataFrame, block: int = 16, slots: int = 1000, weights: dict[str, float] | None = None) -> DataFrame:
    """All columns of ``docs`` and where each document goes: mix_block (in its source), mix_slot, mix_place (in the
    block) and mix_share, mix_slots (the source's share of a period's slots). (mix_slot, mix_place) is the order.

    ``docs`` needs doc_id and source. A source's documents come by doc_id, nulls last; rows that share a doc_id
    come in the order of a hash of the row. A null source is a source of its own. Every row comes back once, with
    repeated rows each in a place of its own. An empty table gives no rows. Texts, of any length, are not looked into.
    Columns of the input may have any names but the five that are added, which are a ValueError.
    """
    refuse(docs, ADDS)
    rows, firsts, totals = _numbered(docs)
    turns = period(shares(totals, slots, weights))
    mine = turns.select("key", F.col("turn").alias("at_turn"), "slot", F.col("slots").alias("mix_slots"))
    sized = turns.select("key", F.col("share").alias("mix_share")).distinct()
    # Both sides have a row for each source or slot, so they are bounded by the period, not by the documents.
    every = _blocks(totals, block)
    sharing = every.join(F.broadcast(sized), "key").withColumn("at_turn", F.expr("mix_block % mix_share"))
    placed = sharing.join(F.broadcast(mine), ["key", "at_turn"]).withColumn("mix_slot", F.expr("(mix_block div mix_share) * mix_slots + slot"))
    return _placed(rows, firsts, placed.select("key", *(c for c in ADDS if c != "mix_place")), block).select(*_columns(docs), *ADDS)


def _blocks(totals: DataFrame, block: int) -> DataFrame:
    """(key, mix_block) for each block of each source."""
    return totals.select("key", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("mix_block"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def deadlines(spark: SparkSession, weights: dict[str, int], blocks: dict[str, int], stretch: int = STRETCH) -> DataFrame:
    """``slots_of`` for weights and numbers of blocks by source."""
    return slots_of(spark.createDataFrame([(k, weights[k], blocks[k]) for k in weights], "key string, own long, blocks long"), stretch)


_TAKEN = "unhex(array_join(transform(slice(acc.queue, 1, acc.gone), c -> lpad(hex(c), 16, '0')), ''))"
#: The fold over the times of releases: the queue in order of deadline, of which the first ones go until the next such time.
#: All that a fold carries is copied at each step but binary values, so what has gone is kept as one, 8 bytes each.
_FOLD = f"""
  aggregate(
    events,
    named_struct('queue', cast(array() as array<bigint>), 'gone', 0, 'part', X'', 'whole', X''),
    (acc, e) -> named_struct(
      'queue', sort_array(concat(slice(acc.queue, acc.gone + 1, size(acc.queue)), e.codes)),
      'gone', cast(e.until - e.at as int),
      'part', concat(if(length(acc.part) < {PART}, acc.part, X''), {_TAKEN}),
      'whole', if(length(acc.part) < {PART}, acc.whole, concat(acc.whole, acc.part))),
    acc -> concat(acc.whole, acc.part, {_TAKEN}))
"""


def slots_of(sources: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(key, mix_block, mix_slot) for blocks 0 to ``blocks`` - 1 of each of ``sources`` (key, own, blocks), by earliest
    deadlines first over exact whole weights: with a weight of w (own) in W, block k is released at floor(k W / w) and due by
    ceil((k + 1) W / w). After any number of slots a source is less than one block off its weight. Ties go to the smaller
    key; the slots of a source that has run out stay empty.

    Slots are laid out in stretches, each for itself. Which blocks have gone by slot t hangs only on releases up to t, and
    of those that are due after t only on how many blocks, not which, waited some slots before, if all that waited then
    are due by t. None waits longer than its window, W / w + 2 slots at most. So a stretch begins that many slots ahead,
    with any blocks waiting in the right number, and from its own first slot on the schedule is that of one fold over all
    slots. A stretch is as long as this lead, so the work is at most twice that of the slots.

    A stretch's blocks, some two for each slot and source, are one row: by time of release, as one number each in which
    the deadline comes first. The fold goes from release to release with a sorted queue; between two releases its first
    blocks go as they stand. So a stretch takes a merge of the queue, which has a block a source at most or so, for each
    release. Only four numbers come to the driver, whatever the number of sources. Slots times all weights must stay
    below 2^62.
    """
    spark, kind = sources.sparkSession, "key string, mix_block long, mix_slot long"
    # Weights up to 2^61 are summed without overflow.
    wide = F.col("own").cast("decimal(38,0)")
    whole, least, n = sources.agg(F.sum(wide), F.min("own"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], kind)
    whole = int(whole)
    slots = int(sources.agg(F.max(F.expr(f"cast(ceil(blocks * {whole}BD / own) as decimal(38,0))"))).first()[0])
    if slots * whole >= 1 << 62:
        raise OverflowError("slots times weights are beyond 2^62")
    if not slots:
        return spark.createDataFrame([], kind)
    lead = -(-whole // least) + 2
    step = max(stretch, lead)
    named = numbered(sources, ["key"], "place").withColumn("i", F.col("place") - 1).select("key", "own", "blocks", "i")
    each = named.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((slots - 1) // step).cast("long"))))
    bounds = each.selectExpr("own", "i", "j", f"greatest(0L, j * {step} - {lead}) AS ahead", f"least({slots}L, (j + 1) * {step}) AS until")
    gone = bounds.selectExpr("*", f"own * ahead div {whole} AS least", f"own * ahead % {whole} > 0 AS begun")
    # As many of those that have begun another block are taken to have gone as makes the count right.
    within = Window.partitionBy("j")
    begun = F.sum(F.col("begun").cast("long")).over(within.orderBy("i"))
    more = F.col("begun") & (begun <= F.col("ahead") - F.sum("least").over(within))
    open_ = gone.withColumn("k", F.col("least") + more.cast("long")).selectExpr("*", f"(until * own + {whole - 1}) div {whole} - 1 AS top").where("k <= top")
    jobs = open_.selectExpr("own", "i", "j", "ahead", "until", "explode(sequence(k, top)) AS k")
    coded = jobs.selectExpr("j", "ahead", "until", f"greatest(ahead, k * {whole} div own) AS at", f"(((k + 1) * {whole} + own - 1) div own - ahead) * {n} + i AS code")
    released = coded.groupBy("j", "ahead", "until", "at").agg(F.collect_list("code").alias("codes"))
    times = released.groupBy("j", "ahead", "until").agg(F.sort_array(F.collect_list(F.struct("at", "codes"))).alias("times"))
    folded = times.select("j", "ahead", F.expr("transform(times, (e, x) -> named_struct('at', e.at, 'codes', e.codes, 'until', coalesce(get(times, x + 1).at, until)))").alias("events"))
    laid = folded.select("j", "ahead", F.expr(_FOLD).alias("taken"))
    each_slot = laid.select("j", "ahead", F.posexplode(F.expr("transform(sequence(1, length(taken), 8), p -> cast(conv(hex(substring(taken, p, 8)), 16, 10) as bigint))")).alias("pos", "code")).selectExpr("ahead + pos AS mix_slot", f"ahead + code div {n} AS due", f"code % {n} AS i", f"j * {step} AS first").where("mix_slot >= first")
    met = each_slot.join(named, "i").selectExpr("key", f"due * own div {whole} - 1 AS mix_block", "mix_slot", "blocks")
    return met.where("mix_block < blocks").select("key", "mix_block", "mix_slot")


def weighed(totals: DataFrame, block: int) -> DataFrame:
    """(key, own, blocks) of sources with their counts (key, n): square roots of the counts in units of about a billionth of
    all, by operations that any engine rounds alike, one at least."""
    root = F.sqrt(F.col("n").cast("double"))
    whole = totals.agg(F.sum(F.ceil(root))).first()[0]
    own = F.greatest(F.lit(1), F.floor(root * float(UNITS) / float(whole or 1))).cast("long")
    return totals.select("key", own.alias("own"), F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))


def pfair(docs: DataFrame, block: int = 16) -> DataFrame:
    """All columns of ``docs`` and mix_block, mix_slot, mix_place, as by ``schedule``, but from exact weights and without
    a period: those of ``weighed``.

    Blocks' slots are joined to rows' numbers by source and block, which no hot source can skew, and rows are then shuffled
    once. Nulls, ties, repeated rows, empty tables and names are as for ``schedule``.
    """
    refuse(docs, ADDS[:3])
    rows, firsts, totals = _numbered(docs)
    sources, _ = materialize(weighed(totals, block), "mix-sources")
    turns, _ = materialize(slots_of(sources), "mix-slots")
    return _placed(rows, firsts, turns, block).select(*_columns(docs), *ADDS[:3])


def _units(counts: dict[str, int]) -> dict[str, int]:
    """Square roots of the counts in units of a billionth of all."""
    whole = sum(n**0.5 for n in counts.values())
    return {k: max(1, round(UNITS * n**0.5 / whole)) for k, n in counts.items()}


def tree(weights: dict[str, int]) -> dict[str, list[tuple[int, int, bool]]]:
    """For each source the way up a Huffman tree of the weights: (both children's weight, the child's own, whether it is
    the first of the two) from the leaf to the root."""
    up: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in weights}
    parent: dict[int, tuple[int, int, int, bool]] = {}
    leaves = sorted(weights)
    heap = [(weights[k], i) for i, k in enumerate(leaves)]
    heapq.heapify(heap)
    new = len(leaves)
    while len(heap) > 1:
        (w, i), (v, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = (new, w + v, w, False), (new, w + v, v, True)
        heapq.heappush(heap, (w + v, new))
        new += 1
    for i, k in enumerate(leaves):
        at = i
        while at in parent:
            at, whole, own, first = parent[at]
            up[k].append((whole, own, first))
    return up


def spread(docs: DataFrame, block: int = 16) -> DataFrame:
    """What ``pfair`` returns, by a closed form without deadlines, for more sources than a fold over them can serve.

    A binary tree of the sources splits slots: of the first m slots of a node its first child has m w / (w + v), rounded.
    So a block's slot follows from its number by one division for each node up the tree, for each row alone. Rounding
    is half a block off at most, and what a node is off comes down by the child's part of it; in a Huffman tree an
    ancestor weighs 1, 2, 3, 5, 8, ... times a leaf at least, so a source is never more than 1.7 blocks off its weight,
    after any number of slots and for any number of sources. Slots of a source that has run out stay empty.

    One row for each source comes to the driver. Slots times ``UNITS`` must stay below 2^62. Nulls, ties, repeated rows,
    empty tables and names are as for ``schedule``.
    """
    refuse(docs, ADDS[:3])
    rows, firsts, totals = _numbered(docs)
    ways = tree(_units({r.key: r.n for r in totals.collect()}))
    table = docs.sparkSession.createDataFrame(list(ways.items()), "key string, way array<struct<whole: bigint, own: bigint, first: boolean>>")
    slot = F.expr("""
      aggregate(way, mix_block, (k, s) -> if(s.first,
        (s.whole * (2 * k + 1) + 2 * s.own - 1) div (2 * s.own) - 1,
        (s.whole * (2 * k + 1)) div (2 * s.own)))
    """)
    turns = _blocks(totals, block).join(table, "key").select("key", "mix_block", slot.alias("mix_slot"))
    return _placed(rows, firsts, turns, block).select(*_columns(docs), *ADDS[:3])


def lay_out(placed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of placed rows in the order of slot and place: range-partitioned and sorted."""
    return placed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*columns)


#: What ``standing`` adds, with types.
STANDS = {"mix_part": "long", "mix_file": "string", "mix_row": "long"}


def standing(docs: DataFrame) -> DataFrame:
    """``docs`` and where each row stands in the files that ``lay_out`` was written to: mix_part, mix_file, mix_row. Files are read
    in an order of their own, but each holds its rows in theirs, and its name has the number of the task that wrote it. Rows that
    come from no Parquet file stand as they come."""
    refuse(docs, STANDS)
    part = F.expr("coalesce(try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS bigint), -1L)")
    try:
        return docs.select("*", part.alias("mix_part"), F.col("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return docs.select("*", F.shiftright(at, 33).alias("mix_part"), F.lit("").alias("mix_file"), at.bitwiseAND((1 << 33) - 1).alias("mix_row"))


def runs(stood: DataFrame, size: int) -> DataFrame:
    """``stood``, rows with the columns of ``standing``, and ``run``: which ``size`` rows of that order each is among. No row is
    moved or sorted for it; the window sees a row for each file."""
    files = stood.groupBy("mix_part", "mix_file").agg((F.max("mix_row") + 1).alias("_n"))
    before = Window.orderBy("mix_part", "mix_file").rowsBetween(Window.unboundedPreceding, -1)
    shifts = files.select("mix_part", "mix_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return stood.join(shifts, ["mix_part", "mix_file"]).withColumn("run", F.expr(f"(_before + mix_row) div {size}")).drop("_before")


def in_order(docs: DataFrame, **how) -> DataFrame:
    """The same rows and columns, laid out in the order of the schedule."""
    return lay_out(schedule(docs, **how), docs.columns)


MIX_SQL = """
WITH RECURSIVE counts AS (
  SELECT CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key, count(*) AS n FROM documents GROUP BY 1),
weights AS (
  SELECT key, (n + 15) // 16 AS blocks, greatest(1, CAST(floor(sqrt(n) * 1000000000.0::DOUBLE / (SELECT CAST(sum(ceil(sqrt(n))) AS DOUBLE) FROM counts)) AS BIGINT)) AS own
  FROM counts),
src AS (
  SELECT list(own ORDER BY key) AS own, list(key ORDER BY key) AS keys, CAST(sum(own) AS BIGINT) AS whole FROM weights),
ends AS (SELECT max((blocks * whole + own - 1) // own) AS slots FROM weights, (SELECT whole FROM src)),
plan AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(own, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM src
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, j: CASE WHEN j = p THEN d + 1 ELSE d END), p
  FROM (
    SELECT t, done,
           list_min(list_filter(list_transform(own, lambda s, i: CASE
             WHEN (done[i] * whole) // s <= t + 1
             THEN (((done[i] + 1) * whole + s - 1) // s) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS p
    FROM plan, src) z
  WHERE t + 1 < (SELECT slots FROM ends)),
turns AS (
  SELECT keys[pick] AS key, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM plan, src WHERE t >= 0),
numbered AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
SELECT n.doc_id, n.source, n.k // 16 AS mix_block, t.slot AS mix_slot, n.k % 16 AS mix_place
FROM numbered n JOIN turns t ON n.key = t.key AND n.k // 16 = t.turn
"""
