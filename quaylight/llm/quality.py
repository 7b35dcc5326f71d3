"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is a weighted sum of measures of its whole text. Labels give preference pairs: a document of label 1 is
preferred to one of label 0, with the probability that a logistic function of the difference of their worths gives. The
weights maximise the likelihood of such pairs, so they see differences of measures only and no absolute level. The
level comes afterwards from all documents: their worths are counted in fine bins, and the quantile of all worths that
keeps the labels apart best becomes the threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scratch
from .tokens import release, slices

#: Words of a window whose distinct words are counted.
WINDOW = 64
#: Bins in which all documents' worths are counted, evenly from the least to the greatest.
BINS = 1 << 16
#: Some plain words: what is counted of each text besides its own.
USUAL = {"letters": 60, "upper": 2, "marks": 2, "words": 12, "capitalised": 2, "ended": 1}
MEASURES = (
    "upper", "symbols", "digits", "marks", "exclamations", "capitalised", "ended", "wordless",
    "repeated_word", "repeated_run", "repeated_line", "commonest", "variety", "word_length", "words",
)


@dataclass(frozen=True)
class Settings:
    """At most ``max_fit`` labelled documents are fitted (a hash of doc_id picks them, the same at every run), whole; each of the
    rarer label meets ``opponents`` of the other, dealt out in turn."""

    max_fit: int = 8000
    opponents: int = 24
    rounds: int = 400
    rate: float = 0.1
    shrink: float = 1e-4


@dataclass(frozen=True)
class Model:
    """Worth = sum of weights times measures, each less its centre over its scale and held within ``reach``."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    reach: float = 6.0

    def worth(self, measures: np.ndarray) -> np.ndarray:
        z = (measures - np.array(self.centre)) / np.array(self.scale)
        return np.clip(z, -self.reach, self.reach) @ np.array(self.weights)


_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _MARK = range(6)


@cache
def _classes() -> np.ndarray:
    """The class of each character."""
    found = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            found[c] = _UPPER if x.isupper() else _LOWER
        elif x.isspace():
            found[c] = _SPACE
        elif x.isdigit():
            found[c] = _DIGIT
        elif x in ".,;:!?'\"()-":
            found[c] = _MARK
    return found


def measures(text: str) -> list[float]:
    """The measures of a whole text, in the order of MEASURES, most of them shares."""
    words = text.split()
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4") if words else np.zeros(0, dtype="<u4")
    n = np.bincount(_classes()[code], minlength=6)
    shown, letters, w = int(n.sum() - n[_SPACE]), int(n[_LOWER] + n[_UPPER]), len(words)
    counts = Counter(words)
    capital = ended = bare = 0
    for word, c in counts.items():
        if word[0].isupper():
            capital += c
        if word[-1] in ".!?":
            ended += c
        if not any(map(str.isalnum, word)):
            bare += c
    lines = [line for line in text.split("\n") if line]
    runs = len(set(zip(words, words[1:], words[2:])))
    variety = sum(len(set(words[i : i + WINDOW])) for i in range(0, w, WINDOW))
    # A text counts as if USUAL had been said before it, so that a few words are no evidence.
    return [
        (int(n[_UPPER]) + USUAL["upper"]) / (letters + USUAL["letters"]),
        int(n[_OTHER]) / (shown + USUAL["letters"]),
        int(n[_DIGIT]) / (shown + USUAL["letters"]),
        (int(n[_MARK]) + USUAL["marks"]) / (shown + USUAL["letters"]),
        text.count("!") / (w + USUAL["words"]),
        (capital + USUAL["capitalised"]) / (w + USUAL["words"]),
        (ended + USUAL["ended"]) / (w + USUAL["words"]),
        bare / (w + USUAL["words"]),
        sum(map(eq, words, words[1:])) / (w + USUAL["words"]),
        (w - 2 - runs if w > 2 else 0) / (w + USUAL["words"]),
        (len(lines) - len(set(lines))) / (len(lines) + 2),
        max(counts.values(), default=0) / (w + USUAL["words"]),
        (variety + USUAL["words"]) / (w + USUAL["words"]),
        math.log1p((shown + USUAL["letters"]) / (w + USUAL["words"])),
        math.log1p(w),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        found = [measures(t) for part in slices(x.as_py() for x in batch.column(1)) for t in part]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["label", "measures"])


def pairs(labels: np.ndarray, opponents: int) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other) rows: each row of the rarer label with ``opponents`` of the other, which are dealt out in turn, so
    that all of them take part about equally often."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    if not len(few):
        return few, few
    mine = np.repeat(few, opponents)
    theirs = many[np.arange(len(mine)) % len(many)]
    return (theirs, mine) if few is bad else (mine, theirs)


def loss_gradient(differences: np.ndarray, weights: np.ndarray, shrink: float) -> np.ndarray:
    """The gradient of the mean of log(1 + exp(-w d)) over pairs' differences d, plus shrink / 2 times the squares of w."""
    lost = np.exp(-np.logaddexp(0.0, differences @ weights))
    return shrink * weights - lost @ differences / len(differences)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from (text, quality) rows, a bounded number; null texts count as empty, rows with a null label are left out, and
    labels but 0 and 1 make no pairs. None if there is no pair. Repeated rows count as often as they come."""
    known = labelled.where("quality in (0, 1)").select(F.col("quality").cast("int"), "text")
    rows = sorted(known.mapInArrow(_measured, "label int, measures array<double>").collect())
    if len({r.label for r in rows}) < 2:
        return None
    raw, labels = np.array([r.measures for r in rows]), np.array([r.label for r in rows])
    # In an order of their own, so that opponents are not dealt by measures.
    mixed = np.random.default_rng(len(rows)).permutation(len(rows))
    raw, labels = raw[mixed], labels[mixed]
    scale = raw.std(axis=0)
    model = Model(tuple(map(float, raw.mean(axis=0))), tuple(map(float, np.where(scale > 1e-9, scale, 1.0))), tuple(np.eye(len(MEASURES))[0].tolist()))
    z = np.clip((raw - np.array(model.centre)) / np.array(model.scale), -model.reach, model.reach)
    better, worse = pairs(labels, settings.opponents)
    d = z[better] - z[worse]
    w = np.zeros(len(MEASURES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, settings.rounds + 1):
        g = loss_gradient(d, w, settings.shrink)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(model.centre, model.scale, tuple(map(float, w)), model.reach)


def worths(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and worth of each row's whole text, very long ones in the memory of their words; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [measures(t) for part in slices(x.as_py() for x in batch.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.worth(np.array(found)) if found else [], pa.float64())], names=["doc_id", "worth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, worth double")


@dataclass(frozen=True)
class Cut:
    """The threshold, and the share of all documents below it."""

    worth: float
    quantile: float


def cut(found: DataFrame, labels: DataFrame) -> Cut | None:
    """Of the quantiles of all documents' worths the one that keeps the labels apart best: the share of label 1 at or
    above it less that of label 0 is greatest; of a stretch without labels its middle. ``found``: doc_id, worth; ``labels``:
    doc_id, quality. Bins are counted, so the threshold is exact to 1/BINS of the worths' range, and BINS rows for each
    label come to the driver. None without both labels."""
    low, high, n = found.agg(F.min("worth"), F.max("worth"), F.count("*")).first()
    if not n:
        return None
    high = max(high, low + 1e-9)
    at = F.least(F.floor((F.col("worth") - low) / ((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
    labelled = found.join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    counted = labelled.groupBy(at.alias("bin"), "quality").agg(F.count("*").alias("n")).unionByName(found.groupBy(at.alias("bin"), F.lit(2).alias("quality")).agg(F.count("*").alias("n")))
    counts = np.zeros((3, BINS + 1))
    for r in counted.collect():
        counts[r.quality, r.bin + 1] = r.n
    below = counts.cumsum(axis=1)  # [label, edge]: rows under the edge
    if not below[0, -1] or not below[1, -1]:
        return None
    apart = below[0] / below[0, -1] - below[1] / below[1, -1]
    best = np.flatnonzero(apart >= apart.max() - 1e-12)
    run = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    edge = int(run[len(run) // 2])
    return Cut(low + edge * (high - low) / BINS, float(below[2, edge] / n))


def held_out_fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """Learn from the labels that are not held out and score every document.

    Returns doc_id, held_out, score, predicted, worth. A score is a logistic function of the worth that is ``threshold`` at
    the quantile found. Labels whose quality is neither 0 nor 1 or that name no document are not used; a document with
    several labels counts once for each. A null doc_id is not held out and never labelled; a null or empty text, or one of
    blanks, has the measures of USUAL and is scored like any. Equal texts have equal scores; repeated rows are scored each. An
    empty table gives no rows. Without both labels every document has the score of their share. Columns besides doc_id,
    text and quality are not read.
    """
    train = labels.select("doc_id", "quality").where(~held_out_fold() & F.col("quality").isin(0, 1))
    # At most max_fit labels, so they go to the documents and no text is shuffled.
    picked = train.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(settings.max_fit)
    with scratch(docs.sparkSession):
        known, _ = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "quality"), "quality-fit")
        model = fit(known, settings)
    at = None
    if model:
        found, _ = materialize(worths(docs, model), "worths")
        at = cut(found, train)
    else:
        found = docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("worth"))
    if at is None:
        share = train.agg(F.avg("quality")).first()[0]
        score = F.lit(min(max(float(threshold if share is None else share), 1e-3), 1 - 1e-3))
    else:
        score = 1 / (1 + F.exp(F.lit(at.worth - math.log(threshold / (1 - threshold))) - F.col("worth")))
    scored = found.withColumn("score", score)
    return scored.select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worth")
