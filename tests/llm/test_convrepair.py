import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylight.llm import convrepair

SCHEMA = "conv_id long, turn long, role string, text string"
_BLANKS = " \t\n\x0b\x0c\r"


def scripts(rows, i=0, grammar="0"):
    """Every edit script with at most two inserts in a row, as (cost, audit, output initials); only for a few rows."""
    for inserts in range(3):
        lead, made = "I" * inserts, grammar
        for _ in range(inserts):
            made += "u" if made[-1] in "0sa" else "a"
        if i == len(rows):
            if re.fullmatch(r"0(s?(ua)+)?", made):
                yield 3 * inserts, lead, made[1:]
            continue
        initial, fault = rows[i]
        options = [(4, "D", made)]
        if fault != 2:
            options.append((3 * fault, "K", made + initial))
            options += [(3 + 3 * fault, "R", made + x) for x in "ua"]
        for cost, letter, out in options:
            if re.fullmatch(r"0s?(ua)*u?", out):
                for more, audit, whole in scripts(rows, i + 1, out):
                    yield 3 * inserts + cost + more, lead + letter + audit, whole


def plain_least(rows):
    """The least (cost, audit) by going forward with the least of each grammar state."""
    moves = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"0": (0, "")}

    def inserted(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                to = "a" if q == "u" else "u"
                best[to] = min(best.get(to, (1 << 60, "")), (c + 3, a + "I"))
        return best

    inserted(best)
    for initial, fault in rows:
        new = {}

        def offer(q, c, a):
            new[q] = min(new.get(q, (1 << 60, "")), (c, a))  # noqa: B023

        for q, (c, a) in best.items():
            offer(q, c + 4, a + "D")
            if fault != 2:
                if initial in moves[q]:
                    offer(moves[q][initial], c + 3 * fault, a + "K")
                offer("a" if q == "u" else "u", c + 3 + 3 * fault, a + "R")
        best = inserted(new)
    return min(best[q] for q in ("0", "a") if q in best)


ROWS = st.lists(st.tuples(st.sampled_from("sua-"), st.integers(0, 2)), min_size=1)


def symbols(rows):
    return convrepair._SYMBOL[np.array(["sua-".index(i) * 3 + f for i, f in rows])]


def by_tables(rows, piece):
    """Cost and audit by pieces of so many rows, put together as the tasks do."""
    t, whole = convrepair.tables(), symbols(rows)
    parts = [whole[i : i + piece] for i in range(0, len(rows), piece)]
    every = np.arange(len(t.vectors))
    maps = [convrepair.before(p, every) for p in parts]
    behind, total = [0], t.end_adds
    for to, adds in reversed(maps):
        total += int((adds + np.zeros_like(to))[behind[-1]])
        behind.append(int(to[behind[-1]]))
    cost = total + int(t.vectors[behind[-1]][0])
    state, audit = 0, ""
    for p, after, i in zip(parts, behind[-2::-1], range(len(parts))):
        told = [convrepair.trace(p, q, after, i == len(parts) - 1) for q in range(4)]
        audit, state = audit + told[state][0], told[state][1]
    return cost, audit


@given(ROWS.filter(lambda r: len(r) <= 4))
@settings(max_examples=80, deadline=None)
def test_plain_against_every_script(rows):
    assert plain_least(rows) == min((c, a) for c, a, _ in scripts(rows))


@given(ROWS, st.sampled_from([1, 3, 4, 7, 64]))
@settings(max_examples=300, deadline=None)
def test_tables_against_plain(rows, piece):
    assert by_tables(rows, piece) == plain_least(rows)


def test_vectors_are_few():
    t = convrepair.tables()
    assert len(t.vectors) <= 64 and (t.vectors.min(axis=1) == 0).all() and t.vectors.max() <= 7
    assert t.block.shape == (len(t.vectors), 9**convrepair.WIDTH)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def plain_report(rows, damaged):
    of = defaultdict(list)
    for r in damaged:
        of[r[0]].append(r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(of[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            end = text.rstrip(_BLANKS)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] if r[1][:1] in set("sua") else "-" for r in mine]
        coded = [(i, {None: 0, "truncated": 1}.get(f, 2)) for i, f in zip(initials, faults)]
        cost, audit = plain_least(coded) if mine else (0, "")
        turns = [r[0] for r in mine if r[0] is not None]
        lines, at, before = [], 0, "0"
        for letter in audit:
            made = "u" if before in "0sa" else "a"
            if letter == "K":
                before = initials[at]
                lines.append(f"{mine[at][1]}:{mine[at][2]}")
            elif letter != "D":
                before = made
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[made]}:{mine[at][2] if letter == 'R' else ''}")
            at += letter != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


HARD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hello!"), (1, 3, "assistant", "Hello!"), (1, 9, "user", " \t"),
    (2, None, None, None), (2, None, "user", None), (2, None, "user", "x"),
    (None, 1, "user", "no id."), (None, 1, "user", "no id."), (None, None, "tool", "é日本語 🙂 \x0b"), (None, 7, "assistant", "."),
    (3, 5, "", "role without a letter."), (3, 5, "SYSTEM", "Loud."), (3, 5, "umpire", "Not out.\r\n"), (3, -4, "assistant", "word " * 20000),
    (4, 1, "assistant", "a."), (4, 1, "assistant", "b."), (4, 2, "system", "late."), (4, 3, "user", "c"), (4, 4, "assistant", "d"),
    (5, 0, "user", "."), (5, 10, "user", "line\nbreak?"),
]


def report(df, damaged=None):
    return sorted(map(tuple, convrepair.repair_report(df, damaged).collect()), key=repr)


def test_hard_rows(spark):
    df = spark.createDataFrame(HARD, SCHEMA).withColumns({c: F.lit("clash") for c in ("at", "seg", "code", "fault", "letters", "roles", "kind", "copy", "tie", "n", "what")})
    as_they_are = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in HARD]
    assert report(df) == plain_report(HARD, as_they_are)
    assert report(df, convrepair.damage(df)) == plain_report(HARD, plain_damage(HARD))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert report(none) == [] and report(none, convrepair.damage(none)) == []
    one = spark.createDataFrame([(1, 1, "user", "x.")], SCHEMA)
    assert report(one, none) == [(1, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_damage_against_plain(spark):
    rows = [(i, t, "assistant", f"Text {i}. And {t}!") for i in range(60) for t in range(5)] + HARD
    got = convrepair.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_damage(rows)))


def test_long_conversations_in_pieces(spark, monkeypatch):
    """One conversation holds most rows, many of them alike; pieces have 8 rows at most."""
    monkeypatch.setattr(convrepair, "STRETCH", 3)
    import random

    pick = random.Random(5)
    role = lambda: pick.choice(["system", "user", "assistant", "user", "assistant", "tool"])
    text = lambda: pick.choice(["Fine.", "cut", " ", f"Own {pick.random()}!", f"Own {pick.random()}", f"Own {pick.random()}?"])
    rows = [(7, t // 2, role(), text()) for t in range(900)] + [(7, None, "user", "same.")] * 200
    rows += [(100 + i, t, role(), text()) for i in range(60) for t in range(i % 9)] + [(None, t, role(), text()) for t in range(77)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert report(df, convrepair.damage(df)) == plain_report(rows, plain_damage(rows))


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "Yes."), (1, 1, "user", "Why?"), (1, 2, "user", "Why"), (2, 0, "tool", "x.")]
    done = convrepair.repair(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.conv_id, r.at, r.nth, r.role, r.text, r.edit) for r in convrepair.repaired(done.rows).collect())
    for conv in (1, 2):
        mine = [r for r in got if r[0] == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[3][0] for r in mine))
        assert all((r[5] == "I") == (r[4] == "") for r in mine)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain(spark, sf):
    from quaylight.llm.queries import QUERIES

    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_conversation_repair"](spark, d).collect()), key=repr) == plain_report(rows, plain_damage(rows))
