from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaylight.llm import mixing

from .test_mixture_order import furthest
from .util import HARD, empty, hard


def slots_by_force(weights, blocks):
    """One loop over all slots: the released block with the earliest deadline, ties to the smaller key."""
    whole, done, slot, out = sum(weights.values()), Counter(), 0, []
    while any(done[k] < n for k, n in blocks.items()):
        due = [(-(-(done[k] + 1) * whole // w), k) for k, w in weights.items() if done[k] * whole // w <= slot]
        k = min(due)[1]
        if done[k] < blocks[k]:
            out.append((k, done[k], slot))
        done[k] += 1
        slot += 1
    return out


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 12)), min_size=1, max_size=7), st.sampled_from([1, 7, 64]))
@settings(max_examples=15, deadline=None)
def test_stretches_are_one_schedule(spark, sources, stretch):
    weights, blocks = ({f"s{i}": s[j] for i, s in enumerate(sources)} for j in (0, 1))
    blocks["s0"] += 1
    got = mixing.deadlines(spark, weights, blocks, stretch).collect()
    assert sorted((r.mix_slot, r.key, r.mix_block) for r in got) == [(t, k, b) for k, b, t in slots_by_force(weights, blocks)]


@pytest.mark.parametrize("weights", [{"a": 400_000_000, "b": 19_000_000, **{f"c{i:02d}": 26_000_000 + 500_000 * (i % 5) for i in range(22)}}, {"a": 7, "b": 1}, {"only": 3}])
def test_less_than_a_block_off_exact_weights(spark, weights):
    whole = sum(weights.values())
    blocks = {k: 4000 * w // whole for k, w in weights.items()}
    rows = sorted((r.mix_slot, r.key) for r in mixing.deadlines(spark, weights, blocks, 64).collect())
    last, seen = defaultdict(int), Counter()
    for t, k in rows:
        last[k] = t
    for t, k in rows:
        if t <= min(last.values()):
            assert abs(seen[k] * whole - t * weights[k]) < whole and abs((seen[k] + 1) * whole - (t + 1) * weights[k]) < whole
            seen[k] += 1
    assert len(rows) == sum(blocks.values()) == len({t for t, _ in rows})


def test_pfair_over_documents(spark):
    counts = {f"s{i:02d}": 40 if i < 20 else 333 for i in range(30)}
    rows = [(i * 1000 + k, s) for i, (s, n) in enumerate(sorted(counts.items())) for k in range(n)]
    got = [(r.mix_slot, r.source) for r in mixing.pfair(spark.createDataFrame(rows, "doc_id long, source string"), block=1).collect()]
    assert len(got) == len(rows) == len({t for t, _ in got})
    assert furthest(got, counts) < 1


def test_pfair_hard_cases(spark):
    got = mixing.pfair(hard(spark), block=2).collect()
    assert sorted(repr(r[:5]) for r in got) == sorted(repr(h) for h in HARD)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(got)
    assert mixing.pfair(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.pfair(hard(spark).withColumnRenamed("pos", "mix_slot"))
    with pytest.raises(OverflowError):
        mixing.deadlines(spark, {"a": 1 << 60, "b": 1}, {"a": 5, "b": 0})
