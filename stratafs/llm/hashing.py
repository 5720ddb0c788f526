"""64-bit hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes whose words are hashed at once.
CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        tables = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            tables.append(np.cumprod(powers))
        _powers[:] = tables
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes alone."""
    out, a, at = [], np.frombuffer(data, np.uint8), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _power_tables(hi - lo + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a[lo:hi] + np.uint64(1)) * up[: hi - lo])))
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out.append(mixed((sums[e] - sums[s]) * down[s]))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words."""
    n = len(words) - size + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mixed(h)
