"""Hashes of words and word shingles of whole texts, with numpy inside a task."""

from __future__ import annotations

import numpy as np

_P, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
CHUNK = 1 << 16
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(2 * len(_powers), n + 1, 1 << 16)
        for name, base in (("_powers", _P), ("_inverses", _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words ``[^\\x20\\x09-\\x0D]+``."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word in order, A-Z lower-cased: sums of bytes times powers of an
    odd number, so that one pass of prefix sums gives every word's. Texts are taken in runs of
    words of about CHUNK bytes, so that powers are needed for a run (or the longest word) only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    bytes_ = _FOLD[np.frombuffer(data, np.uint8)]
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        first, n = starts[lo], int(ends[hi - 1] - starts[lo])
        _tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((bytes_[first : first + n].astype(np.uint64) + np.uint64(1)) * _powers[:n], out=sums[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mix((sums[e] - sums[s]) * _inverses[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words in order; of the whole sequence, if it is shorter."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * _P + words[i : n - k + 1 + i])
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted different shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text), width))
