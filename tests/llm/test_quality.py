import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylight.llm import quality
from quaylight.llm.queries import QUERIES

from .util import HARD, empty, hard

NAMED = dict(zip(quality.MEASURES, range(len(quality.MEASURES))))


def test_measures_by_hand():
    got = lambda t, m: quality.measures(t)[NAMED[m]]
    clean = "This is a plain sentence of some words. It ends here, and one more follows it."
    for name, junk in {
        "upper": clean.upper(), "symbols": clean.replace(" ", "%%% "), "digits": "123 456 789 " * 5, "exclamations": clean.replace(" ", "!! "),
        "wordless": clean.replace(" ", " | "), "repeated_word": "so " * 40, "repeated_run": (clean + " ") * 5, "repeated_line": "a b\nc d\n" * 9, "commonest": "a b a c a d a e a f",
    }.items():
        assert got(junk, name) > got(clean, name) + 0.02, name
    assert got("so " * 40, "variety") < got(clean, "variety")
    usual = quality.measures("")
    assert quality.measures(" \n\t") == usual and len(usual) == len(quality.MEASURES)
    assert usual[NAMED["capitalised"]] == 2 / 12 and usual[NAMED["variety"]] == 1.0


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_measures_of_any_text(text):
    assert all(map(math.isfinite, quality.measures(text)))


@given(st.lists(st.integers(0, 1), max_size=60), st.integers(1, 5))
def test_pairs(labels, opponents):
    y = np.array(labels, dtype=int)
    better, worse = quality.pairs(y, opponents)
    assert (y[better] == 1).all() and (y[worse] == 0).all()
    few = min(labels.count(0), labels.count(1))
    assert len(better) == few * opponents
    if few:
        often = [np.bincount(x, minlength=len(y))[y == k] for x, k in ((better, 1), (worse, 0))]
        assert all(o.max() - o.min() <= 1 for o in often)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    d, w = rng.normal(size=(40, 5)), rng.normal(size=5)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 0.01 / 2 * w @ w
    step = [(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(5) * 1e-6]
    assert quality.loss_gradient(d, w, 0.01) == pytest.approx(step, abs=1e-6)


def test_cut_against_every_edge(spark):
    rng = np.random.default_rng(9)
    u = [float(x) for x in np.concatenate([rng.normal(0, 1, 300), rng.normal(2, 1, 700)])]
    y = [int(i >= 300) if i % 3 else None for i in range(1000)]
    found = spark.createDataFrame(list(enumerate(u)), "doc_id long, worth double")
    got = quality.cut(found, spark.createDataFrame([(i, q) for i, q in enumerate(y) if q is not None], "doc_id long, quality int"))
    apart = lambda t: sum(x < t for x, q in zip(u, y) if q == 0) / y.count(0) - sum(x < t for x, q in zip(u, y) if q == 1) / y.count(1)
    assert apart(got.worth) == pytest.approx(max(apart(t) for t in u), abs=0.005)
    assert got.quantile == pytest.approx(sum(x < got.worth for x in u) / 1000, abs=1e-9)


def test_query_against_a_slow_version(spark):
    """All of fitting and scoring again, pair by pair."""
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    rows = sorted((q, quality.measures(docs[i])) for i, q in labels)
    rows = [rows[i] for i in np.random.default_rng(len(rows)).permutation(len(rows))]
    raw = np.array([m for _, m in rows])
    centre, scale = raw.mean(axis=0), raw.std(axis=0)
    scale[scale <= 1e-9] = 1
    z = [[min(max((x - c) / s, -6), 6) for x, c, s in zip(m, centre, scale)] for _, m in rows]
    good, bad = [i for i, r in enumerate(rows) if r[0] == 1], [i for i, r in enumerate(rows) if r[0] == 0]
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    met = [(f, many[(k * 24 + j) % len(many)]) for k, f in enumerate(few) for j in range(24)]
    diff = np.array([[a - b for a, b in zip(z[many_], z[few_])] if few is bad else [a - b for a, b in zip(z[few_], z[many_])] for few_, many_ in met])
    w, m, v = np.zeros(15), np.zeros(15), np.zeros(15)
    for step in range(1, 401):
        g = 1e-4 * w - sum(x / (1 + math.exp(x @ w)) for x in diff) / len(diff)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    worth = {i: float(np.clip((np.array(quality.measures(t)) - centre) / scale, -6, 6) @ w) for i, t in docs.items()}
    got = QUERIES["op11_quality_classifier"](spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.worth == pytest.approx(worth[r.doc_id], abs=1e-5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    low = max(r.worth for r in got if not r.predicted)
    high = min(r.worth for r in got if r.predicted)
    apart = lambda t: sum(worth[i] < t for i, q in labels if q == 0) / len(bad) - sum(worth[i] < t for i, q in labels if q == 1) / len(good)
    assert low < high and apart((low + high) / 2) == pytest.approx(max(map(apart, worth.values())), abs=0.02)


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op11_quality_classifier"](spark, d).cache()
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "predicted", "score").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(r.predicted for r in bad) <= 0.05 * len(bad)
    assert sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad) >= 0.995 * len(good) * len(bad)
    assert got.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.3)").isEmpty()


def test_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (999, 1), (7, 1), (7, 0), (11, 5)], "doc_id long, quality int")
    clash = hard(spark).withColumns({c: F.lit("clash") for c in ("worth", "quality", "predicted", "held_out", "measures", "label", "bin")})
    got = quality.quality_report(clash, labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.score for r in got}
    assert of[4] == of[5] == of[6] and not next(r for r in got if r.doc_id is None).held_out
    assert quality.quality_report(empty(spark), labels).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1")):
        one = quality.quality_report(hard(spark), some).collect()
        assert len(one) == len(HARD) and len({r.score for r in one}) == 1 and {r.predicted for r in one} == {1}


def test_sees_only_what_it_may(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lied = labels.withColumn("quality", F.when(quality.held_out_fold(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    a, b = (sorted(map(tuple, quality.quality_report(x, y).collect())) for x, y in ((docs, labels), (other, lied)))
    assert a == b
