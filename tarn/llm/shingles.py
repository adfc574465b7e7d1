"""Hashes of words and of runs of words, for many texts at once in NumPy."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed together, as a rule, and the powers that are kept for it.
TOGETHER = 1 << 18
KEPT_POWERS = 1 << 19
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; up to ``KEPT_POWERS`` of them are kept for the next call."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    size = max(n, KEPT_POWERS)
    made = []
    for base in (BASE, INVERSE):
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if size <= KEPT_POWERS:
        _POWERS[:] = made
    return made


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-cased, parted by ASCII white space) of the texts in a row, and where each text's words begin: n + 1 places."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    edges = np.cumsum([0, *(len(p) + 1 for p in parts)])
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    word = ~SPACE[data]
    turns = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = turns[::2], turns[1::2]
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
        hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MULTIPLIER)
    return hashes, np.searchsorted(starts, edges)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of the whole text where it is shorter, none where it is empty."""
    if not len(words):
        return words
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1] * MULTIPLIER
        for k in range(1, n):
            out = mixed(out) + words[k : len(words) - n + 1 + k]
        return mixed(out + np.uint64(n))
