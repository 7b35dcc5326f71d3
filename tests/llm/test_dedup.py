import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylight.llm import chunkdedup, exactdedup, graph, linededup, simhash

from .util import HARD, SCHEMA, empty, hard

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.lists(st.sampled_from(["a", "B", "É", "word", "x y", " "]), max_size=12), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_fingerprint(words, size):
    text = " \n".join(words)
    assert simhash.fingerprint(text, size) == plain_fingerprint(text, size)


def groups_by_force(values, radius=3):
    boss = {v: v for v in values}

    def top(v):
        while boss[v] != v:
            v = boss[v]
        return v

    vs = sorted(values)
    arr = np.array(vs, dtype=np.uint64)
    for i, v in enumerate(vs):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = top(v), top(vs[j])
            boss[max(a, b)] = min(a, b)
    return {v: top(v) for v in vs}


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 2**64 - 1))
@settings(max_examples=50, deadline=None)
def test_bk_tree(values, probe):
    tree = simhash.BKTree()
    for v in dict.fromkeys(values):
        tree.add(v)
    near = [probe ^ 1, probe ^ 0b111, probe ^ (1 << 63)]
    for v in near:
        if v not in tree.values:
            tree.add(v)
    assert {tree.values[i] for i in tree.within(probe, 3)} == {v for v in tree.values if (v ^ probe).bit_count() <= 3}


@pytest.mark.parametrize("shard", [4096, 7])
def test_links_against_brute_force(spark, shard):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    values = set(map(int, rng.integers(0, 2**63, 300, dtype=np.uint64)))
    for c in map(int, centres):
        for _ in range(20):
            v = c
            for b in rng.integers(0, 64, 4):
                v ^= 1 << int(b)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), shard=shard)
    roots = {r.node % 2**64: r.root % 2**64 for r in graph.components(links)[0].collect()}
    want = groups_by_force(values)
    got = defaultdict(set)
    for v in values:
        got[roots.get(v, v)].add(v)
    plain = defaultdict(set)
    for v in values:
        plain[want[v]].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, plain.values()))


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=4, deadline=None)
def test_components(spark, pairs):
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs or [(1, 1)], "a long, b long"))[0].collect()}
    boss = list(range(31))

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        boss[max(x, y)] = min(x, y)
    assert all(got.get(v, v) == top(v) for v in range(31))


def simhash_by_force(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    roots = groups_by_force({f for _, f in fps})
    least = {}
    for d, f in fps:
        if d is not None:
            least[roots[f]] = min(least.get(roots[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(roots[f])) for d, f in fps), key=str)


def test_simhash_hard_cases(spark):
    got = simhash.simhash_groups(hard(spark)).collect()
    assert sorted(map(tuple, got), key=str) == simhash_by_force([(h[0], h[1]) for h in HARD])
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_simhash_query(spark):
    from quaylight.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.limit(40).withColumns({"doc_id": F.col("doc_id") + 100000, "text": F.concat("text", F.lit(" tail"))})
    both = docs.unionByName(extra)
    got = simhash.simhash_groups(both).collect()
    assert sorted(map(tuple, got), key=str) == simhash_by_force([(r.doc_id, r.text) for r in both.collect()])
    assert QUERIES["op2_simhash_near_dedup"](spark, DATA).count() == docs.count()


def test_one_of_each(spark):
    rows = [(3, "a b c d e f g h"), (1, "A b c d e f g h"), (2, "quite another text with other words"), (None, "a b c d e f g h")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}


# Exact copies


def exact_by_force(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for t, ds in groups.items():
        keep = min((d for d in ds if d is not None), default=None)
        for i, d in enumerate(sorted(ds, key=lambda d: (d is None, d))):
            out.append((d, keep, len(ds), i == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_hard_cases(spark, tmp_path, digest):
    path = str(tmp_path / "documents.parquet")
    hard(spark).repartition(3).write.parquet(path)
    got = [tuple(r) for r in exactdedup.exact_duplicates(spark, path, digest, files_per_batch=1).collect()]
    want = exact_by_force([(h[0], h[1]) for h in HARD])
    assert sorted((g[:4] for g in got), key=str) == sorted((w[:4] for w in want), key=str)
    if digest is exactdedup.sha256:
        assert sorted(got, key=str) == want


def test_exact_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    empty(spark).write.parquet(path)
    assert exactdedup.exact_duplicates(spark, path).count() == 0


# Lines


def lines_by_force(rows, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(strip))
    holders = defaultdict(set)
    for d, t in rows:
        for s in (t or "").split("\n"):
            if d is not None and len(key(s)) >= min_chars:
                holders[key(s)].add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [s for s in ls if d is None or len(holders[key(s)]) < min_docs or max(holders[key(s)]) == d]
        out.append((d, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_hard_cases(spark):
    more = [(100 + i, "\n".join(["A common line of over twenty characters."] * (i % 3) + [f"own line {i}"] + ["\t A COMMON line of over twenty characters."]), "en", "a", 1) for i in range(30)]
    rows = [*HARD, *more]
    docs = hard(spark).unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    assert sorted(map(tuple, linededup.line_report(docs).collect()), key=str) == lines_by_force([(r[0], r[1]) for r in rows])
    assert linededup.line_report(empty(spark)).count() == 0


def test_bitmaps_give_the_text_back(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in linededup.dedup_lines(docs).where("n_dropped > 0").collect():
        ls = r.text.split("\n")
        assert "\n".join(s for run in r.keep_runs for s in ls[run["start"] : run["end"]]) == r.kept_text


# Substrings


def test_gear_against_its_definition():
    data = np.frombuffer("Gear rolls over bytes – é".encode() * 3, dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(chunkdedup._GEAR[b])) & 0xFFFF
        want.append(h)
    assert chunkdedup.gear(data).tolist() == want


@given(st.binary(min_size=1, max_size=3000), st.binary(max_size=40), st.integers(0, 3000))
@settings(max_examples=60, deadline=None)
def test_cuts_cover_and_resist_shifts(data, inserted, at):
    s = chunkdedup.Settings(chance=0.1, shortest=4, longest=64)
    a = np.frombuffer(data, dtype=np.uint8)
    ends = chunkdedup.cuts(a, s).tolist()
    starts = [0, *ends[:-1]]
    assert ends[-1] == len(a) and all(0 < e - b <= s.longest for b, e in zip(starts, ends))
    at = min(at, len(data))
    moved = data[:at] + inserted + data[at:]
    other = chunkdedup.cuts(np.frombuffer(moved, dtype=np.uint8), s).tolist()
    # Behind the insertion, cuts that depend on nothing before it are the same, moved on.
    ours = {e + len(inserted) for e in ends if e > at + 16 + s.shortest + s.longest}
    theirs = {e for e in other if e > at + len(inserted) + 16 + s.shortest + s.longest}
    first = min(ours & theirs, default=None)
    if first is not None:
        assert {e for e in ours if e >= first} == {e for e in theirs if e >= first}


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rng = np.random.default_rng(5)
    lexicon = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(5000)]
    say = lambda n: [lexicon[i] for i in rng.integers(0, len(lexicon), n)]
    rows, planted = [], set()
    for k in range(100):
        passage = say(int(rng.integers(52, 70)))
        for j in range(2):
            w, at = say(200), int(rng.integers(0, 200))
            rows.append((10 * k + j, " ".join(w[:at] + passage + w[at:])))
            planted.add(10 * k + j)
        rows.append((10 * k + 5, " ".join(say(250)) + "\nLicensed under the Apache License, Version 2.0."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = chunkdedup.repeated_runs(docs).collect()
    found = {r.doc_id for r in runs}
    assert found <= planted and len(found) >= 0.97 * len(planted)
    texts = dict(rows)
    shorter = {r.doc_id: r.text for r in chunkdedup.without_repeats(docs).collect()}
    for d, t in texts.items():
        cut = sum(r.n_removed for r in runs if r.doc_id == d and r.n_removed == r.length)
        assert len(shorter[d].encode()) == len(t.encode()) - cut


def test_substring_hard_cases(spark):
    s = chunkdedup.Settings(run=20)
    runs = chunkdedup.repeated_runs(hard(spark), s).collect()
    assert {r.doc_id for r in runs} <= {1, 2, 3, 7}
    assert chunkdedup.repeated_runs(empty(spark)).count() == 0
    assert chunkdedup.without_repeats(hard(spark), s).count() == len(HARD)


def runs_by_force(rows, s):
    """Runs from chunks counted in plain dictionaries."""
    holders, cut = defaultdict(set), []
    for d, t in rows:
        raw = t.encode()
        if raw:
            ends = chunkdedup.cuts(np.frombuffer(raw, dtype=np.uint8), s).tolist()
            parts = [(a, raw[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            cut.append((d, parts))
            for _, p in parts:
                holders[p].add(d)
    out = []
    for d, parts in cut:
        run = []
        for a, p in [*parts, (None, b"")]:
            if a is not None and len(holders[p]) > 1:
                run.append((a, p))
            elif run:
                n = sum(len(p) for _, p in run)
                if n >= s.run:
                    firsts = [min(holders[p]) for _, p in run]
                    out.append((d, run[0][0], n, len(run), min(firsts), sum(len(p) for (_, p), f in zip(run, firsts) if f != d)))
                run = []
    return sorted(out)


def test_substring_query(spark):
    from quaylight.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op3_substring_dedup"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == runs_by_force([(r.doc_id, r.text) for r in docs.collect()], chunkdedup.Settings())
