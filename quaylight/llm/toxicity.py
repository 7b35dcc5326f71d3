"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is a logistic function of its words; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents are labelled; the gradient of their likelihood is shared out over the sentences
that may have caused it, so the model also tells where the offending sentences are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scratch
from .tokens import release, slices

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
#: A sentence offends if its own probability is at least this.
OFFENDING = 0.5


@dataclass(frozen=True)
class Settings:
    """``max_fit`` labels at most are fitted, with their whole documents (a hash of doc_id picks them, the same at every run);
    the vocabulary holds the ``vocabulary`` words that speak for the label best, of those in at least ``min_docs``
    labelled documents and with a log-likelihood ratio of ``evidence`` or more. Both bound what reaches the driver."""

    max_fit: int = 8000
    vocabulary: int = 2048
    min_docs: int = 4
    evidence: float = 10.0
    rounds: int = 250
    rate: float = 0.3
    shrink: float = 1e-5


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each sentence that has a word."""
    for m in _SENTENCE.finditer(text):
        if words := _WORD.findall(m[0].lower()):
            yield m.start(), m.end(), words


def _word_sets():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = iter(batch.column(0).to_pylist())
            for part in slices(x.as_py() for x in batch.column(1)):
                rows = [(w, y) for t in part for y in [next(labels)] for w in set(_WORD.findall(t.lower()))]
                frame = pd.DataFrame(rows, columns=["word", "toxic"]).groupby("word", as_index=False).agg(n=("toxic", "size"), n_toxic=("toxic", "sum"))
                yield pa.RecordBatch.from_pandas(frame.astype({"n": "int64", "n_toxic": "int64"}), preserve_index=False)

    return run


def choose_words(labelled: DataFrame, settings: Settings) -> list[str]:
    """The words that come more often in toxic than in other labelled documents, by the log-likelihood ratio of presence."""
    totals = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, pos = float(totals[0]), float(totals[1])
    if not 0 < pos < n:
        return []
    counts = labelled.select("toxic", "text").mapInArrow(_word_sets(), "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("k"))
    a, b, c, d = F.col("k"), F.col("n") - F.col("k"), F.lit(pos) - F.col("k"), F.lit(n - pos) - (F.col("n") - F.col("k"))
    cells = ((a, F.lit(pos) * F.col("n") / n), (b, F.lit(n - pos) * F.col("n") / n), (c, F.lit(pos) * (n - F.col("n")) / n), (d, F.lit(n - pos) * (n - F.col("n")) / n))
    ratio = sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    more = (F.col("k") * n > F.col("n") * pos) & (ratio >= settings.evidence)
    best = counts.where((F.col("n") >= settings.min_docs) & more).orderBy(ratio.desc(), "word").limit(settings.vocabulary).select("word")
    return [r.word for r in best.collect()]


def _bags(words: list[str]):
    """The vocabulary words of each sentence as (document, sentence, word) numbers; sentences without any are counted."""
    number = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = iter(batch.column(0).to_pylist())
            for part in slices(x.as_py() for x in batch.column(1)):
                found = [[sorted({number[w] for w in ws if w in number}) for _, _, ws in sentences(t)] for t in part]
                ys = [next(labels) for _ in part]
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([[s for s in f if s] for f in found], pa.list_(pa.list_(pa.int32()))), pa.array([sum(not s for s in f) for f in found], pa.int64())], names=["toxic", "bags", "empty"])

    return run


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on (text, toxic) rows; rows with a null text count as empty, rows with a null label are left out. Of words
    whose evidence is equal the first by name are chosen; repeated rows count as often as they come."""
    with scratch(labelled.sparkSession):
        known, _ = materialize(labelled.where("toxic is not null").select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")), "toxic-fit")
        words = choose_words(known, settings)
        if not words:
            share = float(known.agg(F.avg("toxic")).first()[0] or 0.0)
            p = min(max(share, 1e-3), 1 - 1e-3)
            return Model({}, float(np.log(p / (1 - p))))
        rows = known.select("toxic", "text").mapInArrow(_bags(words), "toxic int, bags array<array<int>>, empty long").collect()
    return Model(*_descend(rows, words, settings))


@dataclass(frozen=True)
class Bags:
    """Sentences with vocabulary words, numbered: their documents, and (sentence, word) pairs; for each document its
    label and how many sentences without such words it has."""

    doc_of: np.ndarray
    sent_of: np.ndarray
    word_of: np.ndarray
    target: np.ndarray
    empty: np.ndarray

    @staticmethod
    def of(rows: list) -> "Bags":
        doc, sent, word = [], [], []
        for i, r in enumerate(rows):
            for s in r.bags:
                sent += [len(doc)] * len(s)
                word += s
                doc.append(i)
        numbers = (np.array(x, dtype=np.int64) for x in (doc, sent, word))
        return Bags(*numbers, np.array([r.toxic for r in rows], dtype=float), np.array([r.empty for r in rows], dtype=float))


def loss_gradient(bags: Bags, w: np.ndarray, b: float, shrink: float) -> np.ndarray:
    """The gradient, by w and then b, of: mean negative log likelihood of the documents' labels under the noisy-or of
    their sentences, plus shrink / 2 times the squares of w."""
    n = len(bags.target)
    z = b + np.bincount(bags.sent_of, w[bags.word_of], minlength=len(bags.doc_of))
    log_clean = np.bincount(bags.doc_of, -np.logaddexp(0.0, z), minlength=n) - bags.empty * np.logaddexp(0.0, b)
    # d(-log likelihood)/d(log_clean): for other documents -1; for toxic ones exp(lc) / (1 - exp(lc)).
    odds = np.exp(log_clean) / np.maximum(-np.expm1(log_clean), 1e-9)
    pull = np.where(bags.target > 0, odds, -1.0) / n
    dz = -pull[bags.doc_of] * np.exp(-np.logaddexp(0.0, -z))
    by_word = np.bincount(bags.word_of, dz[bags.sent_of], minlength=len(w)) + shrink * w
    return np.append(by_word, dz.sum() - (pull * bags.empty).sum() / (1 + np.exp(-b)))


def _descend(rows: list, words: list[str], settings: Settings) -> tuple[dict[str, float], float]:
    """Maximise the likelihood of the documents by Adam over all of them."""
    bags = Bags.of(rows)
    w, b = np.zeros(len(words)), -6.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, settings.rounds + 1):
        g = loss_gradient(bags, w, b, settings.shrink)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], float(b - move[-1])
    return {x: float(c) for x, c in zip(words, w) if abs(c) > 1e-6}, b


def score(docs: DataFrame, model: Model, keep: int = 3) -> DataFrame:
    """doc_id, score, the ``keep`` worst sentences (start and end in the text, probability), worst first, and all
    sentences whose own probability is ``OFFENDING`` or more, however many, in the order of the text.

    A document may be toxic by many sentences of which none offends by itself; then only ``worst`` names some.

    ``docs`` needs doc_id and text. Whole texts are read, very long ones in the memory of their sentences; equal
    probabilities rank by place. A null or empty text, or one without words, has no
    sentence and the score 0. Repeated rows are scored each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        get, bias = model.weights.get, model.bias
        base = -float(np.logaddexp(0.0, bias))
        for batch in batches:
            scores, spans, offending = [], [], []
            for part in slices(x.as_py() for x in batch.column(1)):
                for t in part:
                    total, known = 0.0, []
                    for start, end, ws in sentences(t):
                        hit = [c for x in set(ws) if (c := get(x)) is not None]
                        if hit:
                            lc = -float(np.logaddexp(0.0, bias + sum(hit)))
                            known.append((lc, start, end))
                        else:
                            lc = base
                        total += lc
                    scores.append(abs(float(np.expm1(total))))
                    spans.append([{"start": s, "end": e, "p": float(-np.expm1(lc))} for lc, s, e in sorted(known)[:keep]])
                    offending.append([x for lc, s, e in known if (x := {"start": s, "end": e, "p": float(-np.expm1(lc))})["p"] >= OFFENDING])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind), pa.array(offending, kind)], names=["doc_id", "score", "worst", "offending"])

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(run, "doc_id long, score double, worst array<struct<start:int,end:int,p:double>>, offending array<struct<start:int,end:int,p:double>>")


def toxicity_report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """Train on the labelled documents that are not held out and score every document.

    Returns doc_id, held_out, score, predicted, worst, offending. Labels whose toxic is null or that name no document are
    not used; a document with several labels is fitted once for each. A null doc_id is not held out and never
    labelled. An empty table gives no rows; without both kinds of label every text is scored by the share alone.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    train = labels.select("doc_id", "toxic").where(~fold & F.col("toxic").isNotNull())
    picked = train.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(settings.max_fit)
    # At most max_fit labels, so they go to the documents and no text is shuffled.
    model = fit(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), settings)
    done = score(docs, model)
    return done.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst", "offending")
