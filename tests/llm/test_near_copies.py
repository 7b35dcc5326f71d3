"""Near copies against all pairs of word-shingle sets."""

import random
from itertools import combinations

import pytest

from quaylight.llm import nearcopies

from .util import HARD, SCHEMA, empty, hard

DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def sets_by_force(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def links_by_force(rows, similarity=0.8):
    """Unequal pairs of at least the similarity, by all pairs of documents."""
    sets = {d: sets_by_force(t) for d, t in rows}
    return [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] != sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


def groups_by_force(rows, links):
    """The least doc_id reachable, by links and equal sets."""
    boss = {d: d for d, _ in rows}

    def top(d):
        while boss[d] != d:
            d = boss[d]
        return d

    first = {}
    same = [(d, first.setdefault(frozenset(sets_by_force(t)), d)) for d, t in rows]
    for a, b in [*links, *same]:
        x, y = sorted((top(a), top(b)))
        boss[y] = x
    return {d: top(d) for d in boss}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def family(seed, bases, copies, edits, length=(40, 300)):
    rng, rows = random.Random(seed), []
    for _ in range(bases):
        base = [rng.choice(WORDS) for _ in range(rng.randint(*length))]
        rows += [base, *(edited(rng, base, rng.randint(0, max(1, len(base) * edits // 100))) for _ in range(copies))]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: r.component_id for r in nearcopies.near_groups(docs, **how).collect()}


def test_recall_of_links(spark):
    """Nine of ten unequal pairs of 0.8 or more end in one group, and groups hold nothing that all pairs don't link."""
    rows = family(1, 300, 2, 4)
    links = links_by_force(rows)
    got, want = run(spark, rows), groups_by_force(rows, links)
    near = [(a, b) for a, b in links if len(sets_by_force(rows[a][1]) & sets_by_force(rows[b][1])) < 0.85 * len(sets_by_force(rows[a][1]) | sets_by_force(rows[b][1]))]
    assert len(links) > 300 and len(near) > 50
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    assert all(want[d] == want[c] for d, c in got.items())


@pytest.mark.parametrize("shard, held, group", [(7, 1 << 20, 2), (1000, 5000, 1)])
def test_a_large_group_in_small_shards(spark, shard, held, group):
    """One base of 150 unequal copies, dealt out in shards, is one group all the same."""
    rows = family(2, 1, 150, 1, (200, 200)) + [(1000 + i, t) for i, t in family(3, 30, 0, 0)]
    want = groups_by_force(rows, links_by_force(rows))
    assert run(spark, rows, shard=shard, held=held, group=group) == want


def test_groups_of_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    links = links_by_force(rows)
    got, want = {r.doc_id: r.component_id for r in nearcopies.near_groups(docs).collect()}, groups_by_force(rows, links)
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(want[d] == want[c] for d, c in got.items())


def test_hard_cases(spark):
    got = sorted((r.doc_id, r.component_id) for r in nearcopies.near_groups(hard(spark)).collect())
    rows = [h[:2] for h in HARD if h[0] is not None]
    want = groups_by_force(rows, links_by_force(rows))
    assert got == sorted((h[0], want[h[0]]) for h in HARD if h[0] is not None)
    kept = nearcopies.one_of_each(hard(spark))
    assert kept.columns == hard(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(h[0] or 0 for h in HARD if h[0] is None or want[h[0]] == h[0])
    assert nearcopies.near_groups(empty(spark)).count() == nearcopies.one_of_each(empty(spark)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "u v w x y z"), (3, "u v w x y z"), (9, "a b c d e f"), (None, "a b c d e f"), (8, "other words")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in nearcopies.near_groups(docs).collect()} == {(5, 3), (3, 3), (9, 3), (8, 8)}
    assert sorted((r.doc_id or 0) for r in nearcopies.one_of_each(docs).collect()) == [0, 3, 8]


def test_just_similar_enough(spark):
    """Four of five shingles are enough; three of four are not."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (11, "p q r s t u v"), (12, "p q r s t u v w")]
    assert links_by_force(rows) == [(1, 2)]
    assert nearcopies.jaccard(nearcopies.shingles(rows[0][1], 5), nearcopies.shingles(rows[1][1], 5)) == 0.8
    got = run(spark, rows)
    assert got[11] == 11 and got[12] == 12
