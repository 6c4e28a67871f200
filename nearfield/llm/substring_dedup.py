"""Substring dedup: words in a run of ``LENGTH`` words that starts in an earlier document go.

Suffix automata of reference shards: the word runs that ``repeats`` leaves open, each once, are the
reference. They are dealt into shards by gram; a shard's automaton holds its runs and, per state,
the smallest document id at which the state's strings occur. The runs of the documents stream
through the automaton of their shard for matching statistics: where the longest match reaches
``LENGTH`` words and a smaller id has it, the window goes, and windows that touch form the maximal
spans. The reference grows with the corpus, so shards travel by key instead of being broadcast
whole to every task.

Defined results: a null text has no words. A null id is after every id; texts without id are not
earlier than one another, nor are rows of one id. Words are compared by 64-bit hashes. ``clean``
drops documents of which no word is left. Extra columns are carried.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.hashing import words_of
from nearfield.llm.repeats import NO_ID, Batch, Member, Method, without_repeats

LENGTH = 13
GRAM = 4
SHARD_WORDS = 50_000


class Automaton:
    """Generalised suffix automaton of several sequences, with the smallest id per state."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.long, self.least = [-1], [0], [NO_ID]

    def _state(self, steps: dict[int, int], link: int, long: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.long.append(long)
        self.least.append(NO_ID)
        return len(self.steps) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for what ``p`` reaches by ``word`` when ``q`` also has longer strings."""
        if self.long[p] + 1 == self.long[q]:
            return q
        clone = self._state(dict(self.steps[q]), self.link[q], self.long[p] + 1)
        while p >= 0 and self.steps[p].get(word) == q:
            self.steps[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int], id_: int) -> None:
        last = 0
        for word in words:
            q = self.steps[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
            else:
                new = self._state({}, 0, self.long[last] + 1)
                p = last
                while p >= 0 and word not in self.steps[p]:
                    self.steps[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.steps[p][word], word)
                last = new
            self.least[last] = min(self.least[last], id_)

    def close(self) -> None:
        """Hand the smallest ids on to the states of shorter endings."""
        for s in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
            up = self.link[s]
            self.least[up] = min(self.least[up], self.least[s])

    def earlier(self, words: list[int], length: int, id_: int) -> np.ndarray:
        """For each window of ``words``, whether it occurs at an id before ``id_``."""
        found = np.zeros(max(len(words) - length + 1, 0), bool)
        steps, link, long = self.steps, self.link, self.long
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in steps[state]:
                state = link[state]
                matched = long[state]
            if word in steps[state]:
                state = steps[state][word]
                matched += 1
            if matched >= length:
                at = state
                while long[link[at]] >= length:
                    at = link[at]
                found[i - length + 1] = self.least[at] < id_
        return found


def _resolve(groups: list[list[Member]], length: int) -> Iterator[tuple[Member, np.ndarray]]:
    shard: list[tuple[Member, list[int]]] = []
    size = 0

    def matched() -> Iterator[tuple[Member, np.ndarray]]:
        automaton = Automaton()
        for m, words in shard:
            automaton.add(words, m.first)
        automaton.close()
        for m, words in shard:
            yield m, automaton.earlier(words, length, m.first)

    for group in groups:
        if len(group) > 1:
            shard += [(m, np.frombuffer(m.context, np.uint64).tolist()) for m in group]
            size += sum(len(words) for _, words in shard[-len(group) :])
            if size >= SHARD_WORDS:
                yield from matched()
                shard, size = [], 0
    yield from matched()


def _units(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, begins, _ = words_of(data)
    bounds = np.append(np.searchsorted(begins, starts), len(hashes))
    return hashes, bounds[:-1], bounds[1:]


def method(length: int = LENGTH, gram: int = GRAM) -> Method:
    return Method(length, gram, 8, _units, functools.partial(_resolve, length=length), True)


def _kept_words(b: Batch, gone: np.ndarray, k: int) -> tuple[int, int, bytes]:
    words = b.data[b.starts[k] : b.starts[k] + b.lengths[k]].split()
    out = gone[b.lows[k] : b.highs[k]]
    removed = int(out.sum())
    kept = [w for w, o in zip(words, out.tolist()) if not o] if removed else words
    return len(words), removed, b" ".join(kept)


def _digest(b: Batch, gone: np.ndarray, k: int) -> list:
    n, removed, kept = _kept_words(b, gone, k)
    return [n, removed, hashlib.sha256(kept).hexdigest()]


def _cleaned(b: Batch, gone: np.ndarray, k: int) -> list:
    return [_kept_words(b, gone, k)[2].decode()]


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256) of every document."""
    types = [pa.int64(), pa.int64(), pa.string()]
    return without_repeats(docs, method(length, gram), _digest, "n_words bigint, n_removed bigint, kept_sha256 string", types)


def clean(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with their kept words, joined by single spaces; ``n_chars`` follows the text."""
    kept = without_repeats(docs, method(length, gram), _cleaned, "kept string", [pa.string()])
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return kept.where("kept != ''").select(row.alias("row")).select("row.*")
