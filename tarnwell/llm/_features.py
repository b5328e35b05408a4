"""Hashed n-gram counts of whole texts, in numpy, piece by piece."""

from __future__ import annotations

import numpy as np

from ._common import lower_table

_FOLD = lower_table()


def _shape_table() -> np.ndarray:
    """Byte classes: letters of either case, digits, white space and non-ASCII collapse; punctuation stays itself."""
    shape = np.arange(256, dtype=np.uint8)
    shape[97:123], shape[65:91], shape[48:58] = ord("a"), ord("A"), ord("0")
    shape[[9, 10, 11, 12, 13]] = ord(" ")
    shape[128:] = ord("x")
    return shape


_SHAPE = _shape_table()


def hashed_ngrams(text: bytes, n: int, dims: int, table: np.ndarray = _FOLD, piece: int = 1 << 20) -> np.ndarray:
    """Counts of all byte n-grams of a whole text, hashed to `dims` (a power of two) places."""
    counts = np.zeros(dims, dtype=np.float64)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for at in range(0, max(1, len(text) - n + 1), piece):
        b = table[np.frombuffer(text[at : at + piece + n - 1], dtype=np.uint8)].astype(np.uint32)
        if len(b) < n:
            break
        code = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            code *= np.uint32(257)
            code += b[k : len(b) - n + 1 + k]
        counts += np.bincount((code * np.uint32(2654435761)) >> shift, minlength=dims)
    return counts


def shape_ngrams(text: bytes, n: int, dims: int) -> np.ndarray:
    return hashed_ngrams(text, n, dims, _SHAPE)


def root_share(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: the length of the result is 1, or 0 for no counts."""
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)
