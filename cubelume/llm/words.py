"""Words of many texts at once, as 64-bit hashes, in numpy.

A word is a run of ASCII letters and digits and of any characters beyond ASCII, in lower case.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_P = 0x100000001B3 * 2 + 1  # odd, so that it has an inverse modulo 2^64
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
_IN_WORD[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        both = []
        for p in (_P, pow(_P, -1, 1 << 64)):
            t = np.full(n, np.uint64(p & 0xFFFFFFFFFFFFFFFF))
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        _powers[:] = both
    return _powers[0], _powers[1]


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    inside = _IN_WORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    power, inverse = power_tables(len(b))
    sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])
    h = mix64((sums[end - 1] - sums[start - 1]) * inverse[start])
    last = np.cumsum([len(x) + 1 for x in data]) if data else np.zeros(0, np.int64)
    upto = np.searchsorted(start, last, "left")
    return h, np.diff(np.concatenate([[0], upto]))


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in each text, and their numbers; a text of 1 to k - 1 words has one, all of it."""
    ends = np.cumsum(counts)
    first = ends - counts
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    limit = np.repeat(ends, n)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        i = at + j
        ok = i < limit
        word = np.where(ok, h[np.minimum(i, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else np.zeros(0, np.uint64)
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(j + 1))
    return out, n
