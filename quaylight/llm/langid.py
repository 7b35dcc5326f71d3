"""Language ID by unigram pieces, marginalised over segmentations.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. Probabilities
are trained by expectation maximisation over the same segmentations.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import refuse
from .tokens import kept, release, slices

_LETTERS = re.compile(r"[^\W\d_]+")


def _number(c: str) -> bool:
    """Numbers that are no digits (½, ², Ⅷ) are word characters to ``re``, but no letters."""
    return c.isalnum() and not c.isalpha() and not c.isdecimal()


#: Runs of characters that may be such: those of Latin-1, and all from the first one beyond.
_ODD = re.compile("[" + "".join(filter(_number, map(chr, range(256)))) + next(filter(_number, map(chr, range(256, sys.maxunicode)))) + "-\U0010ffff]+")
#: A run of more letters counts as several words of at most so many.
_LONGEST = 1000
_TINY = 1e-250
#: Letters up to which doubles hold the probability of a word.
_SHORT = 40
#: Words that one Python worker remembers at most; beyond it, it starts afresh.
_MEMORY = 400_000


@dataclass(frozen=True)
class Settings:
    """At most ``per_language`` documents of each language are fitted (a hash of doc_id picks them, the same at every
    run), whole. A letter that no piece covers is a piece of its own with a share of ``unknown``."""

    per_language: int = 300
    rounds: int = 3
    max_piece: int = 12
    smooth: float = 0.1
    unknown: float = 1e-7


@dataclass(frozen=True)
class Model:
    """``pieces``: text → probability in each language. ``priors``: log shares of the languages."""

    languages: list[str]
    pieces: dict[str, tuple[float, ...]]
    priors: tuple[float, ...]
    unknown: float
    max_piece: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def public_pieces(path: str, max_piece: int) -> set[str]:
    """The lower-cased pieces of letters of a SentencePiece vocabulary, without word marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()))
    return {p for p in found if 0 < len(p) <= max_piece and p.isalpha()}


def words(text: str) -> list[str]:
    """The lower-cased runs of letters."""
    low = text.lower()
    if not low.isascii():
        low = _ODD.sub(lambda m: m[0] if m[0].isalpha() else "".join(" " if _number(c) else c for c in m[0]), low)
    found = _LETTERS.findall(low)
    if len(low) > _LONGEST and any(len(w) > _LONGEST for w in found):
        return [w[i : i + _LONGEST] for w in found for i in range(0, len(w), _LONGEST)]
    return found


class Scorer:
    """Log probability of words in each language; words are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._number = {p: i for i, p in enumerate(model.pieces)}
        n, k = len(self._number), len(model.languages)
        # Two rows more: what is no piece, and a letter that no piece covers.
        self._prob = np.array([*model.pieces.values(), (0.0,) * k, (model.unknown,) * k]).reshape(n + 2, k)
        self._row: dict[str, int] = {}
        self._table = np.zeros((1024, k))

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word | language) summed over all segmentations; a row for each word."""
        out = np.empty((len(words), len(self.model.languages)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for n, at in by_length.items():
            out[at] = self._same_length([words[i] for i in at], n)
        return out

    def _same_length(self, words: list[str], n: int) -> np.ndarray:
        get, none, longest = self._number.get, len(self._number), self.model.max_piece
        shape = (len(words), len(self.model.languages))
        log, sums = np.zeros(shape), {0: np.ones(shape)}
        for end in range(1, n + 1):
            here = np.zeros(shape)
            for start in range(max(0, end - longest), end):
                missing = none + 1 if end - start == 1 else none
                piece = np.fromiter((get(w[start:end], missing) for w in words), dtype=np.int64, count=len(words))
                hit = np.flatnonzero(piece != none)
                if len(hit):
                    here[hit] += sums[start][hit] * self._prob[piece[hit]]
            sums[end] = here
            sums.pop(end - longest, None)
            if here.min() < _TINY:  # long words: carry a factor of what can still be read
                up = np.where(here < _TINY, 1.0 / here, 1.0)
                log -= np.log(up)
                for row in sums.values():
                    row *= up
        return log + np.log(sums[n])

    def texts(self, texts: list[str]) -> list[np.ndarray | None]:
        """Unnormalised log posterior of each language for each text; None if it has no letter."""
        found = [words(t) for t in texts]
        new = set().union(*found)
        fresh = new.difference(self._row)
        if len(self._row) + len(fresh) > _MEMORY:
            self._row, fresh = {}, new
        while len(self._row) + len(fresh) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        if fresh:
            fresh = list(fresh)
            at = range(len(self._row), len(self._row) + len(fresh))
            self._table[at.start : at.stop] = self.forward(fresh)
            self._row.update(zip(fresh, at))
        get, priors = self._row.__getitem__, np.array(self.model.priors)
        return [priors + self._table[np.fromiter(map(get, f), dtype=np.int64, count=len(f))].sum(axis=0) if f else None for f in found]


def _expect(counts: Counter, prob: dict[str, float], longest: int, unknown: float) -> dict[str, float]:
    """Expected piece counts over all segmentations of the counted words, by forward and backward sums."""
    out: dict[str, float] = defaultdict(float)
    for word, c in counts.items():
        n = len(word)
        number = float if n <= _SHORT else Decimal  # products over long words leave the range of doubles
        arcs = [(s, e, word[s:e], number(p)) for e in range(1, n + 1) for s in range(max(0, e - longest), e) if (p := prob.get(word[s:e])) or e - s == 1 and (p := unknown)]
        ahead, back = [number(1)] + [number(0)] * n, [number(0)] * n + [number(1)]
        for s, e, _, p in arcs:
            ahead[e] += ahead[s] * p
        for s, e, _, p in reversed(arcs):
            back[s] += p * back[e]
        if ahead[n] > 0:
            share = c / ahead[n]
            for s, e, piece, p in arcs:
                out[piece] += float(share * ahead[s] * p * back[e])
    return out


def train(counts: Counter, vocabulary: list[str], settings: Settings) -> list[float]:
    """The probability of each piece of the vocabulary in the language whose words these are."""
    prob = {p: 1.0 / len(vocabulary) for p in vocabulary}
    for _ in range(settings.rounds):
        got = _expect(counts, prob, settings.max_piece, settings.unknown)
        total = sum(got.values()) + settings.smooth * len(vocabulary)
        prob = {p: (got.get(p, 0.0) + settings.smooth) / total for p in vocabulary}
    return list(prob.values())


def _train_group(path: str, settings: Settings):
    """One language: its word counts in, one row with the probabilities of the sorted pieces out."""

    def run(table: pa.Table) -> pa.Table:
        release()
        counts = Counter(dict(sorted(zip(table["word"].to_pylist(), table["n"].to_pylist()))))
        learned = train(counts, sorted(public_pieces(path, settings.max_piece)), settings)
        return pa.table({"lang": table["lang"].slice(0, 1), "p": pa.array([learned], pa.list_(pa.float64()))})

    return run


def _count_words():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = iter(batch.column(0).to_pylist())
            seen: Counter = Counter()
            for part in slices(x.as_py() for x in batch.column(1)):
                for t in part:
                    lang = next(langs)
                    seen.update((lang, w) for w in words(t))
            cols = [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    return run


def fit(labelled: DataFrame, vocabulary: str, settings: Settings = Settings()) -> Model | None:
    """Train on (doc_id, text, lang) rows whose lang is not null; None without any. Rows that share a lang and doc_id are
    picked or left together; a null doc_id is never picked. Texts without letters teach nothing."""
    known = labelled.where("lang is not null")
    docs = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not docs:
        return None
    # A hash first thins each language to little over its bound, so that no task ranks more than that.
    share = F.create_map(*(F.lit(x) for k, n in sorted(docs.items()) for x in (k, min(1.0, (1.3 * settings.per_language + 20) / n))))[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.select("lang", "doc_id").where(drawn).withColumn("rank", rank).where(F.col("rank") <= settings.per_language).select("lang", "doc_id").distinct()
    texts = known.select("lang", "doc_id", "text").join(F.broadcast(picked), ["lang", "doc_id"])
    counted = texts.select("lang", "text").mapInArrow(_count_words(), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # A group is a language's bounded sample; languages are trained side by side, and only probabilities come here.
    learned = {r.lang: r.p for r in counted.groupBy("lang").applyInArrow(_train_group(vocabulary, settings), "lang string, p array<double>").collect()}
    if not learned:
        return None
    languages = sorted(learned)
    names = sorted(public_pieces(vocabulary, settings.max_piece))
    n = sum(docs[x] for x in languages)
    pieces = dict(zip(names, zip(*(learned[x] for x in languages))))
    return Model(languages, pieces, tuple(math.log(docs[x] / n) for x in languages), settings.unknown, settings.max_piece)


def scorer(model: Model) -> Scorer:
    """This Python worker's scorer of the model."""
    return kept(model.name, lambda: Scorer(model))


def predict_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of that language) added.

    ``docs`` needs text; the other columns are passed through, and one that is called lang_pred or score already is a
    ValueError. Whole texts are scored, very long ones in the memory of their words. A text that is null or has no letter
    is ``und`` with the score 0, as is every text without a model. Of languages that are equally likely the first by
    name counts. Repeated rows are scored each; an empty table gives no rows.
    """
    refuse(docs, ("lang_pred", "score"))
    at, names = docs.columns.index("text"), [*docs.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if model is None else scorer(model)
        for batch in batches:
            langs, scores = [], []
            for part in slices(x.as_py() for x in batch.column(at)):
                for total in own.texts(part) if own else [None] * len(part):
                    if total is None:
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        best = int(total.argmax())
                        langs.append(model.languages[best])
                        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, out)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score; columns of ``docs`` but doc_id and text are not read."""
    return predict_rows(docs.select(F.col("doc_id").cast("long"), "text"), model).select("doc_id", "lang_pred", "score")


def held_out_fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """Learn from the text and lang of documents that are not held out; predict every document.

    Returns doc_id, held_out, lang_pred, score. A null doc_id is not held out and may teach. An empty table gives
    no rows.
    """
    model = fit(docs.where(~held_out_fold()), vocabulary, settings)
    return predict(docs, model).select("doc_id", held_out_fold().alias("held_out"), "lang_pred", "score")
