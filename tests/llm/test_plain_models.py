"""Trained queries held against slow versions that train and score with plain loops."""

import math
import re
import zlib
from collections import Counter

import pytest

from quaylight.llm import topk, toxicity
from quaylight.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def told(text):
    """The word sets of a text's sentences."""
    parts = (set(re.findall(r"[^\W_]+", part.lower())) for part in re.split(r"[.!?\n]+", text))
    return [words for words in parts if words]


def log_clean(z):
    return -(max(z, 0.0) + math.log1p(math.exp(-abs(z))))


def likely_words(known, least, evidence):
    n, toxic = len(known), sum(y for _, y in known)
    held, bad = Counter(), Counter()
    for text, y in known:
        for word in set(re.findall(r"[^\W_]+", text.lower())):
            held[word] += 1
            bad[word] += y
    found = []
    for word, m in held.items():
        k = bad[word]
        table = [(k, toxic * m), (m - k, (n - toxic) * m), (toxic - k, toxic * (n - m)), (n - toxic - m + k, (n - toxic) * (n - m))]
        ratio = sum(seen * math.log(seen * n / due) for seen, due in table if seen)
        if m >= least and k * n > m * toxic and ratio >= evidence:
            found.append(word)
    return sorted(found)


def toxic_by_force(texts, labels):
    s = toxicity.Settings()
    known = [(texts[d] or "", y) for d, y in labels if y is not None and d in texts and zlib.crc32(str(d).encode()) % 3 != 1]
    words = likely_words(known, s.min_docs, s.evidence)
    assert len(known) <= s.max_fit and 0 < len(words) <= s.vocabulary
    vocabulary = set(words)
    bags = [([sorted(b & vocabulary) for b in told(t)], y) for t, y in known]
    weight, bias = dict.fromkeys(words, 0.0), -6.0
    mean, square = Counter(), Counter()
    for step in range(1, s.rounds + 1):
        slope, flat = {w: s.shrink * c for w, c in weight.items()}, 0.0
        for sents, y in bags:
            zs = [bias + sum(weight[w] for w in b) for b in sents]
            clean = sum(map(log_clean, zs))
            pull = (math.exp(clean) / max(-math.expm1(clean), 1e-9) if y else -1.0) / len(bags)
            for b, z in zip(sents, zs):
                move = -pull * math.exp(log_clean(-z))
                flat += move
                for w in b:
                    slope[w] += move
        for name, g in [*slope.items(), (None, flat)]:
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.999 * square[name] + 0.001 * g * g
            move = s.rate * (mean[name] / (1 - 0.9**step)) / (math.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
            if name is None:
                bias -= move
            else:
                weight[name] -= move
    return {d: -math.expm1(sum(log_clean(bias + sum(weight.get(w, 0.0) for w in b)) for b in told(t or ""))) for d, t in texts.items()}


def test_toxicity_query_against_plain_training(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic").collect()]
    want = toxic_by_force(texts, labels)
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    for d, r in got.items():
        assert r.score == pytest.approx(want[d], abs=1e-3)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.7)


def test_a_component_that_overflows_is_no_silent_loss(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e306, 1.0]), (2, [3.0, 1.0]), (3, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a double"):
        topk.top_k(df, df.where("vec_id = 0"), k=3).count()
    with pytest.raises(Exception, match="beyond a double"):
        topk.top_k(df.where("vec_id <> 1"), df.where("vec_id = 1"), k=3).count()
    got = topk.top_k(df.where("vec_id <> 1"), df.where("vec_id = 0"), k=3).collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 5 * 1024 * 1024)]
