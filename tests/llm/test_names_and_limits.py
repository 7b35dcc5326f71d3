"""Clashing names, letters, gradients, large buckets, any limit: what the operators say about them."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quaylight.llm import chunkdedup, langid, linededup, mixing, shared, simhash, tokencounts, toxicity
from quaylight.llm.queries import QUERIES

from .test_dedup import groups_by_force, lines_by_force, plain_fingerprint, simhash_by_force
from .test_packing_tokens import check_packing, ids
from .util import HARD, hard

DATA = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("_doc", "_row", "_dropped", "_id", "_spans", "row", "key", "id", "tie", "number", "spans", "dropped", "row_hash", "h2", "way", "first", "lines", "a b", "x.y")


def clashing(spark):
    df = spark.createDataFrame([h for h in HARD], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in NAMES})


@pytest.mark.parametrize(
    "operator,adds",
    [
        (linededup.dedup_lines, linededup.ADDS),
        (lambda d: chunkdedup.without_repeats(d, chunkdedup.Settings(run=20)), ()),
        (mixing.schedule, mixing.ADDS),
        (mixing.spread, mixing.ADDS[:3]),
        (simhash.one_of_each, ()),
        (lambda d: langid.predict_rows(d, None), ("lang_pred", "score")),
    ],
)
def test_columns_of_any_name_come_back(spark, operator, adds):
    docs = clashing(spark)
    got = operator(docs)
    assert got.columns == [*docs.columns, *adds]
    assert got.where(" or ".join(f"`{c}` <> 'clash' or `{c}` is null" for c in NAMES)).isEmpty() and got.count() > 0
    for c in adds:
        with pytest.raises(ValueError, match=c):
            operator(docs.withColumn(c, F.lit(1)))


def test_only_letters_make_words(spark):
    assert langid.words("½ ² Ⅷ ٣ _ 7x½y Straße Ⅷé") == ["x", "y", "straße", "é"]
    assert langid.words("a" * 2500 + " b") == ["a" * 1000, "a" * 1000, "a" * 500, "b"]
    rows = [(i, t, "en") for i, t in enumerate(("½ ²", "Ⅷ", "٣ 12", "some plain words", "x½"))]
    got = {r.doc_id: r for r in langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "en"]


def test_long_words_teach():
    word = "ab" * 300
    got = langid._expect(Counter({word: 1}), {"ab": 0.5, "a": 1e-9}, 3, 1e-9)
    assert got["ab"] == pytest.approx(300, rel=1e-6)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(3)

    class Row:
        def __init__(self, toxic):
            self.toxic, self.empty = toxic, int(rng.integers(0, 3))
            self.bags = [sorted(set(map(int, rng.integers(0, 6, rng.integers(1, 4))))) for _ in range(rng.integers(0, 4))]

    rows = [Row(int(i % 3 == 0)) for i in range(30)]
    rows[0].bags = rows[0].bags or [[1]]
    bags = toxicity.Bags.of(rows)

    def loss(x):
        w, b, total = x[:-1], x[-1], 0.0
        for r in rows:
            clean = 1.0
            for s in r.bags:
                clean *= 1 - 1 / (1 + math.exp(-(b + sum(w[i] for i in s))))
            clean *= (1 - 1 / (1 + math.exp(-b))) ** r.empty
            total -= math.log(max(1 - clean, 1e-300)) if r.toxic else math.log(clean)
        return total / len(rows) + 0.05 * sum(w * w)

    rows = [r for r in rows if r.bags or r.empty or not r.toxic]
    bags = toxicity.Bags.of(rows)
    x = rng.normal(size=7)
    got = toxicity.loss_gradient(bags, x[:-1], float(x[-1]), 0.1)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(x + step) - loss(x - step)) / 2e-6, rel=1e-4, abs=1e-7)


def test_a_bucket_of_fifty_thousand_falls_apart(spark):
    """Fingerprints that share two blocks of bits, as of one family of texts: cells stay in proportion, no link is lost."""
    rng = np.random.default_rng(4)
    low = rng.integers(0, 1 << 38, 50_000, dtype=np.uint64)
    near = low[:500] ^ (np.uint64(1) << rng.integers(0, 38, 500).astype(np.uint64))
    values = sorted({int(v) for v in np.concatenate([low, near])})
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(8)
    rows = simhash.bucket_cells(df).count()
    assert rows < 60 * len(values)  # without the parts, 10 files times 13 shards
    links = simhash.near_links(df).collect()
    linked = {v for r in links for v in (r.a, r.b)}
    arr = np.array(values, dtype=np.uint64)
    some = values[:: len(values) // 300]
    for v in [*map(int, near[:100]), *some]:
        close = np.flatnonzero(np.bitwise_count(arr ^ np.uint64(v)) <= 3)
        assert (len(close) > 1) == (v in linked)
    assert all((r.a ^ r.b).bit_count() <= 3 or r.a != r.b for r in links)


def test_any_context_limit(spark):
    hist = tokencounts.length_histogram(hard(spark), public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for h in HARD:
        lengths.setdefault(h[3], []).append(len(ids(h[1])))
    got = tokencounts.at_limits(hist, [0, 5, 17, 10**6]).collect()
    assert len(got) == 4 * len(lengths)
    for r in got:
        own = lengths[r.source]
        assert (r.docs_over, r.truncated_total) == (sum(x > r.context_limit for x in own), sum(min(x, r.context_limit) for x in own))


def test_bitmap_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op7_line_dedup"](spark, DATA).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == lines_by_force(list(docs.items()))
    for r in got:
        ls, runs = (docs[r.doc_id] or "").split("\n"), [tuple(map(int, x.split("-"))) for x in r.keep_runs.split(",") if x]
        assert hashlib.sha256("\n".join(s for a, b in runs for s in ls[a:b]).encode()).hexdigest() == r.kept_sha256


def test_packing_and_simhash_queries_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_packing(docs, QUERIES["op1_best_fit_packing"](spark, DATA).collect(), 2048)
    got = QUERIES["op2_simhash_near_dedup"](spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == simhash_by_force(docs)
    assert groups_by_force({plain_fingerprint(docs[0][1])})


def test_scratch_deletes_what_was_made_inside(spark):
    with shared.scratch(spark):
        _, path = shared.materialize(spark.range(3), "inside")
        assert shared.exists(spark, path)
    assert not shared.exists(spark, path)
