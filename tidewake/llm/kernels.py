"""numpy kernels over UTF-8 bytes: words and their 64-bit hashes, memory bounded by segments."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))
#: Entries up to which a table of powers is kept.
_KEPT = 1 << 22


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n at least. One table is kept, the largest so far."""
    global _POWERS
    if len(_POWERS[0]) > n:
        return _POWERS
    size = 1 << max(12, int(n).bit_length())
    both = []
    for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        out = np.full(size + 1, base, dtype=np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    if size <= _KEPT:
        _POWERS = tuple(both)
    return tuple(both)


def _segment(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_MIX[data] * up[: len(data)], out=total[1:])
    return starts, ends, finish((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the start, end and hash of each word; bytes are hashed a segment at a time."""
    low = _LOWER[data]
    n, at, parts = len(low), 0, []
    while at < n:
        to = min(at + SEGMENT, n)
        while to < n:  # to the next byte outside words
            gap = np.flatnonzero(~is_word[low[to : to + 65536]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + 65536, n)
        s, e, h = _segment(low[at:to], is_word[low[at:to]])
        parts.append((s + at, e + at, h))
        at = to
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return low, none, none, np.zeros(0, dtype=np.uint64)
    return (low, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * STEP + hashes[k : len(hashes) - n + 1 + k]
    return finish(out)


class HashSet:
    """Sorted 64-bit hashes behind a bit table, for membership of large arrays."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        bits = min(26, max(16, int(len(self.sorted)).bit_length() + 5))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.sorted & self.mask] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the members."""
        may = np.flatnonzero(self.table[hashes & self.mask])
        if not len(may) or not len(self.sorted):
            return may[:0]
        at = np.minimum(np.searchsorted(self.sorted, hashes[may]), len(self.sorted) - 1)
        return may[self.sorted[at] == hashes[may]]
