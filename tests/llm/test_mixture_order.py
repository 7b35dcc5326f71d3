from collections import Counter, defaultdict

from quaylight.llm import mixing

from .util import HARD, empty, hard


def furthest(rows, counts):
    """The most blocks (of one document) that a source is off its exact weight, up to the slot where the first has run out."""
    total = sum(n**0.5 for n in counts.values())
    last, seen, worst = defaultdict(int), Counter(), 0.0
    for slot, source in rows:
        last[source] = max(last[source], slot)
    for slot, source in sorted(rows):
        if slot > min(last.values()):
            break
        before = seen[source]
        seen[source] += 1
        w = counts[source] ** 0.5 / total
        worst = max(worst, abs(before - slot * w), abs(seen[source] - (slot + 1) * w))
    return worst


def test_spread_keeps_to_exact_weights(spark):
    counts = {f"s{i:03d}": 20 if i < 300 else 102 for i in range(400)}
    rows = [(i * 1000 + k, s) for i, (s, n) in enumerate(sorted(counts.items())) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = [(r.mix_slot, r.source) for r in mixing.spread(docs, block=1).collect()]
    assert len(got) == len(rows) == len({t for t, _ in got})
    assert furthest(got, counts) < 1.7
    # Whole shares, which the pipeline had before, are off by more.
    floored = [(r.mix_slot, r.source) for r in mixing.schedule(docs, block=1, slots=1000).collect()]
    assert furthest(floored, counts) > 1.7


def test_tree_keeps_to_exact_weights_without_end():
    weights = {"a": 400_000_000, "b": 1_900_000, **{f"c{i:02d}": 26_000_000 + 500_000 * (i % 5) for i in range(22)}}
    whole = sum(weights.values())
    taken, at = set(), [*range(200), *range(10_000_000, 10_000_200)]
    for key, way in mixing.tree(weights).items():
        for k in at:
            t = k
            for both, own, first in way:
                t = -(-both * (2 * t + 1) // (2 * own)) - 1 if first else both * (2 * t + 1) // (2 * own)
            assert abs(k - t * weights[key] / whole) < 1.7 and abs(k + 1 - (t + 1) * weights[key] / whole) < 1.7
            assert t not in taken
            taken.add(t)


def test_spread_hard_cases(spark):
    got = mixing.spread(hard(spark), block=2).collect()
    assert sorted(repr(r[:5]) for r in got) == sorted(repr(h) for h in HARD)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(got)
    assert mixing.spread(empty(spark)).count() == 0
