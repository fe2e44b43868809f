"""Vectorised text primitives on whole Arrow batches: code points, word runs, rolling hashes."""

from __future__ import annotations

import numpy as np

#: Fixed odd multiplier of the rolling polynomial and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the next call."""
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 4096)
        for k, b in enumerate((BASE, BASE_INV)):
            row = np.full(m, b, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of mix(values[j]) * BASE**j over j < i."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values) * up, dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) that depend on their content alone."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def codepoints(text: str) -> np.ndarray:
    """Unicode code points; lone surrogates are kept as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """(codes, starts, ends, lower): the runs of a-z and 0-9 in the lower-cased text.

    Offsets are in code points of the lower-cased text, which is also returned.
    """
    lower = text.lower()
    codes = codepoints(lower)
    word = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    return codes, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), lower


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width``, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out
