"""Hashes of all words of many texts at once, without an object per word."""

from __future__ import annotations

import numpy as np

_BASE = 0xA24BAED4963EE407 | 1
#: Bytes that part words: ASCII other than letters and digits.
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every word, in order: runs of ASCII letters and digits and of other characters, in lower case."""
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(t) + 1 for t in encoded], np.int64)
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8) if encoded else np.zeros(0, np.uint8)
    inside = ~_PARTS[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), _BASE, np.uint64))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    h = (sums[end] - sums[begin]) * back[begin]
    return mixed(h), np.searchsorted(np.cumsum(sizes), begin, "right")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words of one text, and the place of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mixed(h[at]), at
