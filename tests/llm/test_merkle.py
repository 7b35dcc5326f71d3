import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylight.llm import merkle

from .util import HARD, empty, hard


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_tree(leaves, arity=2):
    """The root, and for each leaf its path: (digests before it, digests after it) from the leaf to the root."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for leaf, i in enumerate(at):
            run, j = runs[i // arity], i % arity
            paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
        at, level = [i // arity for i in at], [h("".join(r)) for r in runs]
    return level[0], paths


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_report(rows, arity=2):
    """rows (doc_id, text, lang, source, n_chars) → sorted result rows."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        leaf = plain_leaf((d, source, lang, n, text))
        tampered = plain_leaf((d, source, lang, n + 1 if n is not None else None, text)) if hit else leaf
        groups[lang].append(((d is not None, d or 0), leaf, d, tampered))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g])], arity) for g in names}
    root, upper = plain_tree([trees[g][0] for g in names], arity)
    out = []
    for g, above in zip(names, upper):
        for (_, leaf, d, tampered), path in zip(sorted(groups[g]), trees[g][1]):
            own = tampered
            for left, right in path + above:
                own = h(left + own + right)
            out.append((d, leaf, trees[g][0], root, h("".join(a + b for a, b in path + above)), own, own == root))
    return sorted(out, key=repr)


@given(st.integers(1, 300), st.integers(2, 5))
@settings(max_examples=60, deadline=None)
def test_sweeps_against_plain_levels(n, arity):
    leaves = [h(str(i)) for i in range(n)]
    root, paths = plain_tree(leaves, arity)
    nodes = merkle.fold(leaves, merkle._height(n, arity), arity)
    assert nodes[-1] == [root]
    for got, want in zip(merkle.unfold(nodes, ("x", "y", None), arity), paths):
        steps = []
        while got:
            steps.append(got[:2])
            got = got[2]
        assert steps == [*want, ("x", "y")]


def report(df):
    return sorted(map(tuple, merkle.manifest_report(df).collect()), key=repr)


def test_hard_rows(spark):
    got = report(hard(spark))
    assert got == plain_report(HARD)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_empty_and_single(spark):
    assert report(empty(spark)) == []
    for row in [(14, "x", "en", None, 3), (None, None, None, None, None), (7, None, None, "s", None)]:
        one = [row]
        (got,) = report(spark.createDataFrame(one, empty(spark).schema))
        assert [got] == plain_report(one) and got[1] == got[2] == got[3] and got[4] == h("")


def test_repeated_rows_and_many_blocks(spark):
    """Over several blocks, with rows without a doc_id that are all the same, and groups of 1, 256, 257 and many."""
    rows = [(i, f"text {i}", "en", "a", i) for i in range(1500)] + [(None, "same", "en", "a", 1)] * 700
    rows += [(5000 + i, None, "é", None, i) for i in range(256)] + [(6000 + i, "", "z", "b", None) for i in range(257)] + [(9000, "lone", None, "b", 2)]
    assert report(spark.createDataFrame(rows, empty(spark).schema).repartition(7)) == plain_report(rows)


def test_many_groups(spark):
    rows = [(i, "t", f"l{i % 700}", "a", i) for i in range(1400)]
    assert report(spark.createDataFrame(rows, empty(spark).schema)) == plain_report(rows)


@pytest.mark.parametrize("arity", [3, 16, 256])
def test_other_arities(spark, arity):
    rows = [(i, f"text {i}", f"l{i % 3}", "a", i) for i in range(1000)]
    docs = spark.createDataFrame(rows, empty(spark).schema).withColumn("leaf", merkle.leaf_digest(merkle.LEAF, empty(spark).schema))
    found = merkle.manifest(docs, "lang", "doc_id", arity=arity)
    got = found.select("doc_id", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.folded(F.col("leaf"), F.col("proof")))
    want = {(r[0], r[2], r[3], r[4]) for r in plain_report(rows, arity)}
    assert {tuple(r)[:4] for r in got.collect()} == want and got.where("root <> `" + got.columns[-1] + "`").isEmpty()


def test_names(spark):
    one = empty(spark).withColumn("leaf", F.lit("x"))
    with pytest.raises(ValueError, match="proof"):
        merkle.manifest(one.withColumn("Proof", F.lit(1)), "lang", "doc_id")
    with pytest.raises(ValueError, match="arity"):
        merkle.manifest(one, "lang", "doc_id", arity=1)
    with pytest.raises(TypeError, match="n_chars"):
        merkle.leaf_digest(["n_chars"], one.select(F.lit(1.5).alias("n_chars")).schema)
    clash = one.unionByName(spark.createDataFrame([(1, "t", "en", "s", 1, "d")], one.schema)).withColumns({c: F.lit(c) for c in ("g", "rank", "n", "row", "digest", "head", "block", "top", "at", "part")})
    (got,) = merkle.manifest(clash, "lang", "doc_id").collect()
    assert got.root == got.subroot == "d" and got.proof == [] and got.rank == "rank"
