"""Vectorised scanning of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
C1, C2, C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x *= C1
    x ^= x >> np.uint64(29)
    x *= C3
    x ^= x >> np.uint64(32)
    return x


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as little-endian integers; zeros follow the end."""
    buf = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 9,), "<u8", buf, 0, (1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every span's bytes, whatever its length."""
    v = words8(data)
    h = mix(lengths.astype(np.uint64) * C2 + np.uint64(seed + 1))
    h = mix(h ^ (v[starts] & MASK[np.minimum(lengths, 8)])) if len(starts) else h
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        h[more] = mix(h[more] ^ (v[starts[more] + at] & MASK[np.minimum(lengths[more] - at, 8)]))
        at += 8
        more = more[lengths[more] > at]
    return h


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a text's end: starts, lengths, and the first run of each text (n+1)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    cuts = off[(off > 0) & (off < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return spans(~SPACE[data], off)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def reduce_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges of off (n+1); an empty range gives 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]
