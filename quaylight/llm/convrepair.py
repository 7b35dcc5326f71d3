"""Conversation structure repair by Four-Russians block tables.

A conversation is repaired by the cheapest edits after which its roles are none, or user and assistant in turn, ending with
the assistant, after a system message or not. What the rest of a conversation costs is a vector over the grammar's four
states. With its least entry taken out only some dozens of vectors occur, so a table says for each vector and each
block of ``WIDTH`` symbols which vector stands before the block and what it adds. Conversations are read from their end by
one lookup a block; the edits are then told from the start: each block is expanded backward from the vector behind it,
and of the edits that cost least the first letter is taken, so ties go to the least audit.

Rows lie in one order by ranges of (conversation, turn); a stretch of ``STRETCH`` places cuts a conversation into pieces of
that many rows at most. For pieces that do not end their conversation the tables give the vector before them for any
vector behind them, and the state behind them for any state before them; so pieces are worked on apart, and only their
maps (a row a piece) are put together along a conversation. However long it is, no task gathers its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import release

#: Symbols of a block.
WIDTH = 4
#: Places of a stretch, as a power of two.
STRETCH = 12
_BLANKS = " \t\n\x0b\x0c\r"

# Fixed values: the edits' costs, the grammar's states (nothing yet, after system, after user, after assistant), which roles
# lead where, and where the grammar may end.
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MOVES = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
FINAL = (0, 3)

_INITIALS = "sua-"
#: A row's code is 3 times its initial's place in _INITIALS, plus 0 if it is whole, 1 if truncated, 2 if it must go.
_GONE = 8
#: Codes → symbols: rows that must go are alike.
_SYMBOL = np.array([_GONE if c % 3 == 2 else c // 3 * 2 + c % 3 for c in range(12)], dtype=np.int64)
_SYMBOLS = 9
_FAR = 1 << 40


def _made(state: int) -> tuple[str, int]:
    """The role that Insert and Rerole give in a state, and the state after it."""
    return next((r, to) for r, to in MOVES[state].items() if r != "s")


def _inserting(costs: list[int]) -> list[int]:
    """Costs from each state if messages may be inserted first."""
    found = list(costs)
    for _ in MOVES:
        found = [min(c, INSERT + found[_made(q)[1]]) for q, c in enumerate(found)]
    return found


def _options(symbol: int, state: int, after: list[int]) -> dict[str, tuple[int, int]]:
    """Edits of a symbol that take it up: letter → (cost of them and of all after, the state after)."""
    found = {"D": (DELETE + after[state], state)}
    if symbol != _GONE:
        initial, more = _INITIALS[symbol // 2], TRUNCATED * (symbol % 2)
        if (to := MOVES[state].get(initial)) is not None:
            found["K"] = (KEEP + more + after[to], to)
        to = _made(state)[1]
        found["R"] = (RENAME + more + after[to], to)
    return found


@dataclass(frozen=True)
class Tables:
    """``vectors``: normalised costs of what follows, from each state; the first is that of the end. ``one``, ``block``:
    [vector, symbol or block] → the vector before; ``one_adds``, ``block_adds``: what is taken out of it.
    ``policy`` [vector after a symbol, symbol, state] → the first letter of the edits that cost least."""

    vectors: np.ndarray
    end_adds: int
    one: np.ndarray
    one_adds: np.ndarray
    block: np.ndarray
    block_adds: np.ndarray
    policy: list[list[list[str]]]


@cache
def tables(width: int = WIDTH) -> Tables:
    """All vectors that can be reached, and all blocks of ``width`` symbols."""

    def normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
        return tuple(c - min(costs) for c in costs), min(costs)

    first, end_adds = normal(_inserting([0 if q in FINAL else _FAR for q in range(len(MOVES))]))
    number, steps, policy = {first: 0}, [], []
    for vector in (found := [first]):
        row, letters = [], []
        for x in range(_SYMBOLS):
            options = [_options(x, q, list(vector)) for q in range(len(MOVES))]
            costs = _inserting([min(c for c, _ in o.values()) for o in options])
            before, adds = normal(costs)
            if before not in number:
                number[before] = len(found)
                found.append(before)
            row.append((number[before], adds))
            best = [o | {"I": (INSERT + costs[_made(q)[1]], 0)} for q, o in enumerate(options)]
            letters.append([min(e for e, (c, _) in o.items() if c == costs[q]) for q, o in enumerate(best)])
        steps.append(row)
        policy.append(letters)
    one, adds = np.moveaxis(np.array(steps, dtype=np.int64), 2, 0)
    block, block_adds = one, adds
    for _ in range(width - 1):  # a symbol more at the front; the one at the back is read first
        block, block_adds = (
            np.concatenate([one[block[:, None, :], np.arange(_SYMBOLS)[None, :, None]]], axis=1).reshape(len(found), -1),
            (adds[block[:, None, :], np.arange(_SYMBOLS)[None, :, None]] + block_adds[:, None, :]).reshape(len(found), -1),
        )
    return Tables(np.array(found), end_adds, one, adds, block, block_adds, policy)


def _blocks(symbols: np.ndarray, width: int = WIDTH) -> tuple[list[int], list[int]]:
    """Whole blocks as numbers, and the symbols left over at the end."""
    n = len(symbols) // width * width
    weights = _SYMBOLS ** np.arange(width - 1, -1, -1)
    return (symbols[:n].reshape(-1, width) @ weights).tolist(), symbols[n:].tolist()


def before(symbols: np.ndarray, after) -> tuple:
    """The vectors that stand before the symbols, for each of the vectors ``after``, and what they add."""
    t, at, adds = tables(), after, 0
    blocks, rest = _blocks(symbols)
    for x in reversed(rest):
        at, adds = t.one[at, x], adds + t.one_adds[at, x]
    for b in reversed(blocks):
        at, adds = t.block[at, b], adds + t.block_adds[at, b]
    return at, adds


def trace(symbols: np.ndarray, state: int, after: int, last: bool) -> tuple[str, int]:
    """The least audit from a state, with the vector behind the symbols known, and the state after it; at the end of a
    conversation with the inserts that it takes to end."""
    t, (blocks, rest), letters, syms = tables(), _blocks(symbols), [], symbols.tolist()
    behind = [after]
    for x in reversed(rest):
        behind.append(int(t.one[behind[-1], x]))
    edges = [behind[-1]]
    for b in reversed(blocks):
        edges.append(int(t.block[edges[-1], b]))
    for i, edge in enumerate(edges[-2::-1]):
        part, inner = syms[i * WIDTH : (i + 1) * WIDTH], [edge]
        for x in reversed(part[1:]):
            inner.append(int(t.one[inner[-1], x]))
        state = _tell(part, inner[::-1], state, letters)
    state = _tell(rest, behind[-2::-1], state, letters)
    while last and state not in FINAL:
        letters.append("I")
        state = _made(state)[1]
    return "".join(letters), state


def _tell(symbols: list[int], behind: list[int], state: int, letters: list[str]) -> int:
    """Add the letters for symbols whose vectors behind them are known; the state after them."""
    policy = tables().policy
    for x, vector in zip(symbols, behind):
        while (letter := policy[vector][x][state]) == "I":
            letters.append(letter)
            state = _made(state)[1]
        letters.append(letter)
        if letter == "K":
            state = MOVES[state][_INITIALS[x // 2]]
        elif letter == "R":
            state = _made(state)[1]
    return state


def edits(audit: str, codes: list[int], state: int) -> list[tuple[str, str]]:
    """For each row its letters (inserts before it first; those that end a conversation after its last row's) and, letter
    for letter, the initials of the roles that are made ("-" if none is)."""
    found: list[tuple[str, str]] = []
    letters = roles = ""
    for letter in audit:
        made = "-"
        if letter == "K":
            state = MOVES[state][_INITIALS[codes[len(found)] // 3]]
        elif letter != "D":
            made, state = _made(state)
        letters, roles = letters + letter, roles + made
        if letter != "I":
            found.append((letters, roles))
            letters = roles = ""
    if letters:
        found[-1] = (found[-1][0] + letters, found[-1][1] + roles)
    return found


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the vectors before them (for each vector behind; of a last piece only for that of the end), and their
    adjacent roles that may not follow one another."""
    release()
    every = np.arange(len(tables().vectors))
    legal = {(_INITIALS.index(a), _INITIALS.index(b)) for a, b in ("su", "ua", "au")}
    for batch in batches:
        to, adds, illegal = [], [], []
        for codes, after in zip(batch.column("codes").to_pylist(), batch.column("next_code").to_pylist()):
            symbols = _SYMBOL[np.array(codes)]
            at, add = before(symbols, every if after is not None else every[:1])
            to.append(at.tolist())
            adds.append((add + np.zeros_like(at)).tolist())
            initials = [c // 3 for c in codes] + ([after // 3] if after is not None else [])
            illegal.append(sum(pair not in legal for pair in zip(initials, initials[1:])))
        cols = [pa.array(to, pa.list_(pa.int64())), pa.array(adds, pa.list_(pa.int64())), pa.array(illegal, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "to", "adds", "illegal"])


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from each conversation's last to its first: the vector behind each, and at the first one the whole cost."""
    release()
    t, at, total = tables(), 0, 0
    for batch in batches:
        behind, cost = [], []
        for to, adds, after, first in zip(*(batch.column(c).to_pylist() for c in ("to", "adds", "next_code", "first"))):
            if after is None:
                at, total = 0, t.end_adds
            behind.append(at)
            at, total = to[at], total + adds[at]
            cost.append(total + int(t.vectors[at][0]) if first else None)
        keep = [batch.column(c) for c in ("conv_id", "seg", "first_at", "first", "next_code", "codes", "illegal")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(behind, pa.int64()), pa.array(cost, pa.int64())], names=[*_PIECE, "illegal", "behind", "cost"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the audit and the state after it, for each state before (of a first piece for the first state only)."""
    release()
    for batch in batches:
        audits, states = [], []
        for codes, behind, after, first in zip(*(batch.column(c).to_pylist() for c in ("codes", "behind", "next_code", "first"))):
            symbols = _SYMBOL[np.array(codes)]
            told = [trace(symbols, q, behind, after is None) for q in range(1 if first else len(MOVES))]
            audits.append([a for a, _ in told])
            states.append([q for _, q in told])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64()))], names=[*batch.schema.names, "audits", "states"])


def _forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from each conversation's first to its last: the state before each, and the audit that it takes."""
    release()
    state = 0
    for batch in batches:
        audit, before_it = [], []
        for audits, states, first in zip(*(batch.column(c).to_pylist() for c in ("audits", "states", "first"))):
            state = 0 if first else state
            audit.append(audits[state])
            before_it.append(state)
            state = states[state]
        keep = [batch.column(c) for c in ("conv_id", "seg", "first_at", "codes", "illegal", "cost")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(audit, pa.string()), pa.array(before_it, pa.int64())], names=["conv_id", "seg", "first_at", "codes", "illegal", "cost", "audit", "state"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row of a piece: its letters and the initials of what is made."""
    release()
    for batch in batches:
        ends, at, letters, roles = [], [], [], []
        for i, (audit, codes, state, first_at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("audit", "codes", "state", "first_at")))):
            for k, (e, r) in enumerate(edits(audit, codes, state)):
                ends.append(i)
                at.append(first_at + k)
                letters.append(e)
                roles.append(r)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(ends, pa.int64())), pa.array(at, pa.int64()), pa.array(letters, pa.string()), pa.array(roles, pa.string())], names=["conv_id", "at", "letters", "roles"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their conversations: the SHA-256 of each one's lines, joined by line feeds."""
    release()
    now, state = None, None
    for batch in batches:
        out = []
        for conv_id, line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "line"))):
            if state and conv_id == now:
                state.update(b"\n" + line.encode())
                continue
            if state:
                out.append((now, state.hexdigest()))
            now, state = conv_id, sha256(line.encode())
        if out:
            yield _digests(out)
    if state:
        yield _digests([(now, state.hexdigest())])


def _digests(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    ids, found = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])


_PIECE = ["conv_id", "seg", "first_at", "first", "next_code", "codes"]
_PIECE_TYPE = "conv_id long, seg long, first_at long, first boolean, next_code int, codes array<int>"


@dataclass(frozen=True)
class Repair:
    """``rows``: conv_id, at (the place in the order), turn, role, text, fault (blank, duplicate, truncated or null), letters
    and roles of its edits. ``pieces``: conv_id, seg, cost (of all of the conversation, at its first piece), illegal, audit."""

    rows: DataFrame
    pieces: DataFrame


def repair(conversations: DataFrame) -> Repair:
    """The cheapest edits of each conversation.

    ``conversations`` needs conv_id, turn, role and text; other columns are not read. Rows come by turn, nulls first, then
    by role and text; a null role or text reads as one blank. A row without a character but white space is blank; one
    whose role and text came before in its conversation is a duplicate; one whose last such character is none of . ! ? is
    truncated; the first that holds counts. Repeated rows are rows of their own (and duplicates). A null conv_id is one
    more conversation. Roles count by their first letter; ones other than s, u and a must be given another or go. Texts of any
    length go through as they are. An empty table gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)  # noqa: E731
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text"))
    # Equal rows are told apart by where they were, so that many of them are several ranges.
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "tie")]
    laid, _ = materialize(tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id()), "conv-rows")

    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    what = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    facts = laid.select("conv_id", "at", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("ended"), F.when(end != "", what).alias("what"))
    firsts = facts.where("not blank").groupBy("conv_id", "what").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("in_conv"), F.col("what").alias("seen"), "first_at")
    met = facts.join(firsts, F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("what") == F.col("seen")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first_at"), "duplicate").when(~F.col("ended"), "truncated")
    initial = F.coalesce(*(F.when(F.col("initial") == c, i) for i, c in enumerate(_INITIALS[:3])), F.lit(3))
    code = initial * 3 + F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNull(), 0).otherwise(2)
    coded, _ = materialize(met.withColumn("fault", fault).select("conv_id", "at", "fault", code.cast("int").alias("code")), "conv-codes")

    # A piece has the rows of one conversation in one stretch of places: consecutive ones, so a row's place is the first one's
    # and its number in the piece.
    pieces = coded.groupBy("conv_id", F.shiftright("at", STRETCH).alias("seg")).agg(F.min("at").alias("first_at"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("c"))
    along = Window.partitionBy("conv_id").orderBy("seg")
    chained = pieces.select("conv_id", "seg", "first_at", F.lag("seg").over(along).isNull().alias("first"), F.lead(F.col("c")[0]["code"]).over(along).alias("next_code"), F.col("c.code").alias("codes"))
    mapped = chained.mapInArrow(_maps, f"{_PIECE_TYPE}, to array<long>, adds array<long>, illegal long")
    ends = mapped.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")).mapInArrow(_back, f"{_PIECE_TYPE}, illegal long, behind long, cost long")
    traced = ends.repartition("conv_id", "seg").mapInArrow(_traces, f"{_PIECE_TYPE}, illegal long, behind long, cost long, audits array<string>, states array<long>")
    done = traced.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_forth, "conv_id long, seg long, first_at long, codes array<int>, illegal long, cost long, audit string, state long")
    kept, _ = materialize(done, "conv-pieces")
    told = kept.repartition("conv_id", "seg").mapInArrow(_told, "conv_id long, at long, letters string, roles string")
    # A place names one row, of whatever conversation.
    judged = coded.select(F.col("at").alias("of"), "fault").join(told.select(F.col("at").alias("told_of"), "letters", "roles"), F.col("of") == F.col("told_of"))
    return Repair(laid.join(judged, F.col("at") == F.col("of")).select("conv_id", "at", "turn", "role", "text", "fault", "letters", "roles"), kept.select("conv_id", "seg", "cost", "illegal", "audit"))


def repaired(rows: DataFrame) -> DataFrame:
    """The messages after the edits: conv_id, at and nth (their order), role, text, edit. Inserted ones have an empty text."""
    each = rows.select("conv_id", "at", "role", "text", "roles", F.posexplode(F.split("letters", "")).alias("nth", "edit")).where("edit in ('I', 'K', 'R')")
    made = F.when(F.substring(F.col("roles"), F.col("nth") + 1, F.lit(1)) == "u", "user").otherwise("assistant")
    return each.select("conv_id", "at", "nth", F.when(F.col("edit") == "K", F.col("role")).otherwise(made).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")


def repaired_digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over each conversation's messages, "role:text", joined by line feeds. A hash is a chain, so
    a conversation's messages stream through one task, a batch at a time; conversations without one have no row."""
    lines = messages.select("conv_id", "at", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "nth").select("conv_id", "line").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the CRC-32 of "conv_id:turn" modulo 20: 0 drops a row, 1 empties its text, 2
    takes . ! ? out of it, 3 repeats the row, 4 makes it the user's. Nulls read as one blank but for conv_id and turn
    themselves, which stay null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    hit = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of its rows in ``damaged`` (None: its own). Conversations without rows there have zeros, an empty audit
    and the hash of an empty text. Gaps beyond a long count as the largest long."""
    done = repair(conversations if damaged is None else damaged)
    rows, _ = materialize(done.rows, "conv-told")
    # First by turn, so that distinct turns are counted without being gathered.
    by_turn = rows.groupBy("conv_id", "turn").agg(*(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731
    span = F.coalesce(F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count("turn"), F.lit(0))
    counts = by_turn.groupBy("conv_id").agg(span.alias("span"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    told = done.pieces.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("seg", "audit")))["audit"], "").alias("audit"))
    parts = [counts.withColumn("gaps", F.least("span", F.lit((1 << 63) - 1)).cast("long")).drop("span"), told, repaired_digests(repaired(rows))]
    whole = conversations.select(F.col("conv_id").cast("long")).distinct().withColumn("here", F.lit(1))
    for p in parts:
        whole = whole.unionByName(p, allowMissingColumns=True)
    found = whole.groupBy("conv_id").agg(F.max("here").alias("here"), *(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)  # noqa: E731
    hash_or_empty = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.where("here = 1").select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), hash_or_empty)


_CRC = "list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1))), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), CAST(4294967295 AS BIGINT))"
_NAME = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_BEFORE = "(PARTITION BY conv_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ADD = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _taken(state: int, initial: str, sources: list[str]) -> str:
    """The least of the edits of a row that lead to a state: Delete in it, Keep and, but for a system's, Rerole from others."""
    kept = [f"CASE WHEN fault < 2 AND initial = '{initial}' THEN {_ADD.format(s, 'CASE WHEN fault = 1 THEN 3 ELSE 0 END', 'K')} END" for s in sources]
    made = [f"CASE WHEN fault < 2 THEN {_ADD.format(s, 'CASE WHEN fault = 1 THEN 6 ELSE 3 END', 'R')} END" for s in sources if initial != "s"]
    found = ", ".join([_ADD.format(f"s{state}", 4, "D"), *kept, *made])
    return f"list_sort(list_filter([{found}], lambda x: x IS NOT NULL))[1]"


#: Forward instead of backward: the least (cost, audit) of each state after each row.
REPAIR_SQL = rf"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format(_NAME)}, 4294967295) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE 'none' END AS named,
         CASE named WHEN 'none' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS fault
  FROM placed),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS s0, {{'c': CAST(1000000 AS BIGINT), 'a': ''}} AS s1,
         {{'c': CAST(3 AS BIGINT), 'a': 'I'}} AS s2, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} AS s3
  FROM judged
  UNION ALL
  SELECT conv_id, pos, n0, n1, m2, {_least("n3", _ADD.format("m2", 3, "I"))}
  FROM (SELECT *, {_least("n2", _ADD.format("n0", 3, "I"), _ADD.format("n1", 3, "I"), _ADD.format("n3", 3, "I"))} AS m2
        FROM (SELECT w.conv_id, j.pos, {_ADD.format("s0", 4, "D")} AS n0, {_taken(1, "s", ["s0"])} AS n1,
                     {_taken(2, "u", ["s0", "s1", "s3"])} AS n2, {_taken(3, "a", ["s2"])} AS n3
              FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = w.pos + 1))),
answers AS (
  SELECT conv_id, {_least("s0", "s3")} AS best FROM walk
  QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)),
letters AS (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS j, substr(best.a, j, 1) AS e FROM answers),
counted AS (
  SELECT conv_id, j, e, 1 + count(*) FILTER (e <> 'I') OVER {_BEFORE} AS pos, count(*) FILTER (e <> 'D') OVER {_BEFORE} AS o FROM letters),
met AS (
  SELECT c.*, r.role, r.text, CAST(bool_or(c.e = 'K' AND c.o = 0 AND r.initial = 's') OVER (PARTITION BY c.conv_id) AS INTEGER) AS head
  FROM counted c LEFT JOIN judged r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.pos = r.pos),
hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - head) % 2 = 0 THEN 'user' ELSE 'assistant' END
                                    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS digest
  FROM met WHERE e <> 'D' GROUP BY conv_id),
stepped AS (SELECT *, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (named = 'blank') AS blank,
         count(*) FILTER (named = 'duplicate') AS duplicate, count(*) FILTER (named = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM stepped GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(a.best.c, 0) AS cost, coalesce(a.best.a, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) b
LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN answers a ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN hashed h ON b.conv_id IS NOT DISTINCT FROM h.conv_id
"""
