"""Word shingles of texts as 64-bit hashes, computed by numpy for many texts at once.

Words are runs of bytes other than space and tab to carriage return, after lower-casing A-Z. A text's set is its distinct
runs of ``k`` words; a text of fewer words is one shingle, a text without words has none. Words and shingles are known
by 64-bit hashes: two different shingles meet with a chance of 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
SLAB = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _letters() -> np.ndarray:
    """A random odd number for each byte, the same everywhere."""
    return mix(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    up = down = np.ones(1, _U)

    @classmethod
    def of(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < size:
            cls.up = np.cumprod(np.concatenate([[_U(1)], np.full(size, _BASE, _U)]))
            cls.down = np.cumprod(np.concatenate([[_U(1)], np.full(size, pow(_BASE, -1, 1 << 64), _U)]))
        return cls.up[:size], cls.down[:size]


def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


_SPACE = _space()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    raw = np.frombuffer(data, np.uint8)
    blank = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _Powers.of(len(raw))
    sums = np.concatenate([[_U(0)], np.cumsum(_letters()[raw] * up)])
    return mix((sums[ends] - sums[starts]) * down[starts] if len(starts) else np.zeros(0, _U)), starts


def _chains(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    out = np.full(n, k, _U)
    for j in range(k):
        out = mix(out * _U(_BASE) + words[j : j + n])
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; the texts are already lower-cased."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < SLAB):
            size += len(texts[stop]) + 1
            stop += 1
        slab = texts[at:stop]
        words, starts = word_hashes(b" ".join(slab))
        limits = np.cumsum([len(t) + 1 for t in slab])
        bounds = [0, *np.searchsorted(starts, limits).tolist()]
        runs = _chains(words, k) if len(words) >= k else np.zeros(0, _U)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(runs[a : b - k + 1]))
            else:
                out.append(_chains(words[a:b], b - a) if b > a else np.zeros(0, _U))
        at = stop
    return out
