"""64-bit hashes of words and word shingles of whole batches of texts, by array operations on their UTF-8 bytes.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z unless fold is false. A word's hash is a
polynomial over random 64-bit values of its bytes, mixed at the end; all words of a batch come from one prefix sum.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 2**64)
_SHINGLE = _rng.integers(1, 2**64, 16, dtype=np.uint64, endpoint=False) | np.uint64(1)
_SHORT = _rng.integers(1, 2**64, 16, dtype=np.uint64, endpoint=False)
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte spans of all words, and for each text the place of its first word (one more at the end).

    space tells for each of the 256 bytes whether it separates words.
    """
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~space[data]
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:-1]
    cut = offsets[offsets < n]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n + 1, bool)
    after[:-1] = solid[1:]
    ends_at = offsets[1:][(offsets[1:] > 0)] - 1
    after[ends_at] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, bounds)."""
    starts, ends, bounds = spans(data, offsets)
    return hashes(data, starts, ends, fold), bounds


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, values: np.ndarray | None = None) -> np.ndarray:
    """values: 256 random numbers to use for the bytes instead of the usual ones, for another hash function (fold has no effect then)."""
    n = len(data)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values if values is not None else _FOLDED if fold else _BYTE)[data] * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def byte_values(seed: int) -> np.ndarray:
    """Random numbers of the 256 bytes, A-Z as a-z, for a hash function of its own."""
    out = np.random.Generator(np.random.PCG64([20240229, seed])).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
    out[65:91] = out[97:123]
    return out


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each followed by one space, and where each begins (one more at the end)."""
    size = ends - starts + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint8), at
    out = data[np.minimum(np.arange(at[-1]) + np.repeat(starts - at[:-1], size), len(data) - 1)]
    out[at[1:] - 1] = 0x20
    return out, at


def shingles(w: np.ndarray, bounds: np.ndarray, size: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all runs of size words within a text, in order and with repeats.

    With whole, a text of 1 to size - 1 words gives one hash of its whole sequence; else it gives none.
    """
    counts = np.diff(bounds)
    many = np.maximum(counts - size + 1, 0)
    if len(w) >= size:
        n = len(w) - size + 1
        h = w[:n] * _SHINGLE[0]
        for k in range(1, size):
            h = h + w[k : k + n] * _SHINGLE[k]
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    first = np.zeros(len(counts) + 1, np.int64)
    if not whole or not (short := np.flatnonzero((counts > 0) & (counts < size))).size:
        np.cumsum(many, out=first[1:])
        return h[np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], many)], first
    alone = []
    for i in short:
        x = w[bounds[i] : bounds[i + 1]]
        alone.append(np.append(x * _SHINGLE[: len(x)], _SHORT[len(x)]).sum(dtype=np.uint64))
    many[short] = 1
    np.cumsum(many, out=first[1:])
    take = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], many)
    take[first[:-1][short]] = 0
    out = h[take] if len(h) else np.zeros(first[-1], np.uint64)
    out[first[:-1][short]] = mix(np.array(alone, np.uint64))
    return out, first
