"""Vectorized hashes of words and of runs of words, over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_RNG = np.random.default_rng(7_919)
BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 5 & 0xFFFFFFFFFFFFFFFF | 1
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept and grown as needed."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        _POWERS[base] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of ``data``; words lie between bytes 9 to 13 and 32."""
    raw = np.frombuffer(data, np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    values = BYTE[raw[inside]] * powers(BASE, int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64)), starts, ends


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k, factor in enumerate(powers(BASE, n + 1)[1:]):
        total += hashes[k : k + size] * factor
    return mixed(total)


def joined(texts: Sequence[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts joined by spaces, at most ``limit`` bytes at a time: (first index, data, their starts).

    A longer text comes alone, so whatever cuts the data by ``limit`` cuts a text at the same places
    wherever it is met.
    """
    held: list[bytes] = []
    size = first = 0

    def data() -> tuple[int, bytes, np.ndarray]:
        lengths = np.array([len(t) + 1 for t in held], np.int64)
        return first, b" ".join(held), np.cumsum(lengths) - lengths

    for i, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield data()
            held, size, first = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield data()
