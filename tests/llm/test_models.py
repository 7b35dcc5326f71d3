import math
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylight.llm import langid, toxicity

from .util import HARD, empty, hard

DATA = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
_MODEL = langid.Model(["x", "y"], {"a": (0.2, 0.1), "ab": (0.1, 0.3), "b": (0.3, 0.05), "aba": (0.01, 0.2)}, (math.log(0.5), math.log(0.5)), 1e-3, 3)


def all_segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in all_segmentations(word[k:]):
            yield [word[:k], *rest]


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=8), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_forward_sums_over_all_segmentations(words):
    got = langid.Scorer(_MODEL).forward(words)
    for w, row in zip(words, got):
        for k in range(2):
            p = lambda s: _MODEL.pieces[s][k] if s in _MODEL.pieces else (1e-3 if len(s) == 1 else 0.0)  # noqa: B023, E731
            assert row[k] == pytest.approx(math.log(sum(math.prod(map(p, seg)) for seg in all_segmentations(w))))


def test_long_words_do_not_underflow():
    got = langid.Scorer(_MODEL).forward(["c" * 2000, "ab" * 1500])
    assert got[0][0] == pytest.approx(2000 * math.log(1e-3)) and (got > -1e5).all()


def test_expected_counts_against_enumeration():
    prob = {"a": 0.2, "ab": 0.1, "b": 0.3, "aba": 0.01}
    got = langid._expect(Counter({"abab": 2}), prob, 3, 1e-3)
    want, total = Counter(), 0.0
    for seg in all_segmentations("abab"):
        p = math.prod(prob.get(s, 1e-3 if len(s) == 1 else 0.0) for s in seg)
        total += p
        for s in seg:
            want[s] += p
    assert {k: pytest.approx(v) for k, v in got.items()} == {k: 2 * v / total for k, v in want.items() if v}


def test_language_held_out_accuracy(spark):
    from quaylight.llm.queries import QUERIES

    got = QUERIES["op6_language_id"](spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    assert got.count() == truth.count()
    both = got.where("held_out").join(truth, "doc_id")
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()
    assert got.where("score < 0 or score > 1").isEmpty()
    assert got.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) != F.col("held_out")).isEmpty()


def test_language_hard_cases(spark):
    got = langid.language_report(hard(spark), PIECES).collect()
    assert len(got) == len(HARD)
    silent = {h[0] for h in HARD if not any(c.isalpha() for c in h[1] or "")}
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in silent) and (r.lang_pred != "und" or r.score == 0.0)
    assert langid.language_report(empty(spark), PIECES).count() == 0
    unlabelled = hard(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_report(unlabelled, PIECES).collect()} == {"und"}


def test_language_ignores_what_it_may_not_see(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fold = langid.held_out_fold()
    lied = docs.withColumn("lang", F.when(fold, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.language_report(d, PIECES).collect())) for d in (docs, lied))
    assert a == b


def test_toxicity_held_out(spark):
    from quaylight.llm.queries import QUERIES

    d = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, d).cache()
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = got.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert got.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.7)").isEmpty()


def test_toxic_sentences_are_located(spark):
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        rows.append((i, f"Fine words stand here {i % 9}. " + ("You vile fool! " if bad else "You dear friend! ") + "More fine words."))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for r in toxicity.toxicity_report(docs, labels).join(docs, "doc_id").join(labels, "doc_id").collect():
        assert r.predicted == r.toxic
        if r.toxic:
            assert "vile fool" in r.text[r.worst[0]["start"] : r.worst[0]["end"]]


def test_toxicity_hard_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (999, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(hard(spark), labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (4, 5, 6))
    assert toxicity.toxicity_report(empty(spark), labels).count() == 0
    assert toxicity.toxicity_report(hard(spark), labels.limit(0)).count() == len(HARD)


def test_noisy_or(spark):
    model = toxicity.Model({"bad": 3.0, "awful": 2.0}, -2.0)
    docs = spark.createDataFrame([(1, "Bad day. Good day. An awful bad one!")], "doc_id long, text string")
    p = [1 / (1 + math.exp(-z)) for z in (1.0, -2.0, 3.0)]
    (r,) = toxicity.score(docs, model).collect()
    assert r.score == pytest.approx(1 - math.prod(1 - x for x in p))
    assert [w["start"] for w in r.worst] == [18, 0]

