"""Vectorised hashing of bytes, words and windows over one byte buffer (numpy).

Polynomial hashes modulo 2**64 over random byte values, read off prefix sums, then
finalised by multiply-and-shift rounds. ``seed`` picks an independent hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(None)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(1000 + seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


@lru_cache(None)
def _base(seed: int) -> tuple[int, int]:
    m = int(np.random.default_rng(7000 + seed).integers(1 << 60, 1 << 62)) * 8 + 3
    m %= 1 << 64
    return m, pow(m, -1, 1 << 64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(seed: int, n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        b = U(_base(seed)[inverse])
        have = np.full(max(n, 1 << 16), b, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[(seed, inverse)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of ``values[start:end]`` (uint64 values) for many spans."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(seed, len(values), False), out=total[1:])
    return mix((total[end] - total[start]) * _powers(seed, len(values) + 1, True)[start])


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
    """Words of every row: (start, end, word_off), row i holding words word_off[i]:word_off[i+1]."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash per word, in slices of the buffer so that memory stays small."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        lo = start[at]
        to = max(at + 1, int(np.searchsorted(end, lo + (1 << 20), "right")))
        piece = _table(seed)[buf[lo:end[to - 1]]]
        out[at:to] = span_hash(piece, start[at:to] - lo, end[at:to] - lo, seed)
        at = to
    return out


def gram_hash(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of ``h[i:i+n]`` for every i (one per possible start; row borders are the caller's)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(seed, len(h), False), out=total[1:])
    total = total[n:] - total[:-n]
    total *= _powers(seed, len(h) + 1, True)[:len(total)]
    return mix(total)


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """min(h[i:i+n]) for every i."""
    if len(h) < n:
        return h[:0]
    have, out = 1, h
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def row_of(word_off: np.ndarray, n: int) -> np.ndarray:
    """The row that each of n words belongs to."""
    return np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))[:n]


def inside_row(word_off: np.ndarray, n: int, size: int) -> np.ndarray:
    """Starts i whose window [i, i + size) stays in one row, among n words."""
    end = np.repeat(word_off[1:], np.diff(word_off))
    return np.flatnonzero(np.arange(n) + size <= end)


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted set."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def part_of(h: np.ndarray, n_parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(n_parts) >> U(32)).astype(np.int64)


def crc_mod(ids, n: int) -> np.ndarray:
    """crc32 of each key as text, modulo n; a null key counts as the empty text."""
    from zlib import crc32
    return np.array([crc32(b"" if i is None else b"%d" % i) % n for i in ids], np.int64)
