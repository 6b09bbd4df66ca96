"""Words of a text as arrays of positions and 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import BLANKS, RangeHash, mixed

_BLANK = np.zeros(256, bool)
_BLANK[np.frombuffer(BLANKS, np.uint8)] = True
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_WORD = RangeHash(11)


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word."""
    a = np.frombuffer(text, np.uint8)
    blank = np.ones(len(a) + 2, bool)
    blank[1:-1] = _BLANK[a]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[0::2], edge[1::2]


def byte_values(text: bytes) -> np.ndarray:
    return _VALUES[np.frombuffer(text, np.uint8)]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and hash of each word."""
    start, end = spans(text)
    return start, end, _WORD.of(_WORD.prefix(byte_values(text)), start, end)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of the whole text if it
    has fewer words, and none if it has no word."""
    h = word_hashes(text)[2]
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mixed(out) + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out + np.uint64(n)))
