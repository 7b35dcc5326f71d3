"""Token ids of whole texts by a public tokenizer, through a cache of words.

The tokenizer drops white space and never merges across it, so a text's ids are its words' ids one after
another. Each Python worker keeps the ids of the words it has met and asks the tokenizer only for new ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: A word of plain letters (lower-cased one by one, already composed) with or without closing marks (no
#: apostrophe, and no part of a special token): the tokenizer splits it into these two runs, and the last id
#: of each run ends a word.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&()*+/=@_~-]*)")
_BLOCK = 8192


def _units(texts: Iterable[str]) -> int:
    """How many texts of usual length these come to."""
    return sum(1 + len(t) // 24 for t in texts)


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes. ``max_words`` bounds the words remembered, ``max_runs`` the runs of
    letters, some 200 bytes each; longer ones count by their length, so both bound bytes. Beyond it, either starts
    afresh; the words of one call are held besides."""

    def __init__(self, path: str, max_words: int = 700_000, max_runs: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        vocab = self._tok.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._words: dict[str, bytes] = {"": b""}
        self._runs: dict[str, bytes] = {"": b""}
        self._max_words, self._max_runs = max_words, max_runs
        self._n_words = self._n_runs = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn_runs(self, runs: list[str]) -> None:
        for lo in range(0, len(runs), _BLOCK):
            block = runs[lo : lo + _BLOCK]
            ids = self._ids(" ".join(block))
            cuts = [0, *((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()]
            if len(cuts) != len(block) + 1:
                raise ValueError("the vocabulary has no word ends, or splits runs of letters")
            raw = ids.tobytes()
            self._runs.update({w: raw[a:b] for w, a, b in zip(block, cuts, cuts[1:])})

    def _learn(self, words: set[str]) -> None:
        split = {}
        for w in words:
            if w.isascii() and w.isalpha():
                split[w] = (w if w.islower() else w.lower(), "")  # the same string, so that it is held once
            elif m := _PLAIN.fullmatch(w):
                split[w] = (m[1].lower(), m[2])
        runs = {r for pair in split.values() for r in pair}
        fresh = runs.difference(self._runs)
        self._n_runs += _units(fresh)
        if self._n_runs > self._max_runs:
            self._runs = {"": b""}
            fresh = runs - {""}
            self._n_runs = _units(fresh)
        self._learn_runs(list(fresh))
        get = self._runs
        self._words.update({w: get[a] + get[b] for w, (a, b) in split.items()})
        if len(split) < len(words):
            self._words.update({w: self._ids(w).tobytes() for w in words.difference(split)})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set().union(*words)
        fresh = new.difference(self._words)
        self._n_words += _units(fresh)
        if self._n_words > self._max_words:
            self._words = {"": b""}
            fresh = new - {""}
            self._n_words = _units(fresh)
        if fresh:
            self._learn(fresh)
        get = self._words.__getitem__
        for w in words:
            yield b"".join(map(get, w))


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What this Python worker keeps from task to task: one thing at a time. Workers are reused, so it serves many
    tasks of an operator, and what operators before it remembered makes room."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Keep nothing; for operators that remember nothing themselves."""
    _KEPT.clear()


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the vocabulary file."""
    return kept(path, lambda: WordEncoder(path))


def slices(texts: Iterable[str | None], rows: int = 256, chars: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in runs bounded by rows and characters (one longer text is a run of its own); null is empty."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and (len(part) >= rows or size + len(t) > chars):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
