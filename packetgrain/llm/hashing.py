"""Hashes of many byte strings at once: one pass over a flat byte array."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD95
_KEPT = 4 << 20
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


# A random-looking 64-bit value for every byte.
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, 1 << 16)
    inverse = pow(_BASE, -1, 1 << 64)
    made = []
    for base in (_BASE, inverse):
        row = np.full(size, np.uint64(base))
        row[0] = 1
        made.append(np.multiply.accumulate(row))
    if size <= _KEPT:
        _powers[:] = made
    return made[0], made[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes; input of ``spans``."""
    up, _ = _table(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(VALUES[data] * up[: len(data)], out=out[1:])
    return out


def spans(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte run ``starts[i]:ends[i]``; equal runs hash equally wherever they stand."""
    _, down = _table(len(running))
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def grams(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    factor = mix(np.arange(1 + salt, k + 1 + salt, dtype=np.uint64) * _ODD) | np.uint64(1)
    n = len(words) - k + 1
    out = words[:n] * factor[0]
    for j in range(1, k):
        out += words[j : j + n] * factor[j]
    return mix(out)
