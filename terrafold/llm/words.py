"""Words of many texts as flat arrays, for operators that score words in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd


def word_table(texts: Sequence[Sequence[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word in order, bounds): text i has codes[bounds[i]:bounds[i + 1]]."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=bounds[1:])
    flat = [w for t in texts for w in t]
    if not flat:
        return [], np.zeros(0, np.int64), bounds
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    return list(distinct), codes.astype(np.int64), bounds


def char_table(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of ``^word$`` one after the other, index of the word of each)."""
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return chars, np.repeat(np.arange(len(words)), lengths)


def mixed(*parts: np.ndarray, bits: int) -> np.ndarray:
    """One hash of ``bits`` bits from arrays of the same length."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h ^= p
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
