"""Whole texts as UTF-8 bytes in numpy: lower-casing, runs, hashes.

An Arrow string column is one byte buffer plus offsets, so a batch of texts is
handled without a Python object per word. Batches are cut into slices of about
``SLICE`` bytes first, which bounds memory; a longer text forms its own slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
U = np.uint64
GOLD = 0x9E3779B97F4A7C15


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` per slice; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    a = col.cast(pa.large_string()).fill_null("")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(a)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``mask`` inside each text: ``(start, end, text index)``."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    heads = off[:-1][off[:-1] < len(mask)]
    first[heads] = mask[heads]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = mask[tails]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(GOLD)) | U(1)


BYTE = _byte_values()


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``[s, e)``; spans are disjoint and ascending."""
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    power = np.cumprod(np.full(int(n.max()), GOLD, np.uint64))
    x = BYTE[buf[within + np.repeat(s, n)]] * power[within]
    return mix(np.add.reduceat(x, np.cumsum(n) - n) + n.astype(np.uint64) * U(0xA0761D6478BD642F))


def window_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Unmixed rolling hash of every k-byte window, built by doubling."""
    cur, m, out, length = BYTE[buf], 1, None, 0
    need = k
    while need:
        if need & 1:
            if out is None:
                out, length = cur, m
            else:
                n = max(0, len(buf) - length - m + 1)
                out = out[:n] * U(pow(GOLD, m, 1 << 64)) + cur[length:length + n]
                length += m
        need >>= 1
        if need:
            n = max(0, len(cur) - m)
            cur = cur[:n] * U(pow(GOLD, m, 1 << 64)) + cur[m:m + n]
            m *= 2
    return out


PRIMES = (2147483647, 2147483629)


def prime_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """62-bit hash of each span from polynomials modulo two primes, with bases by
    ``seed``; spans are disjoint and ascending."""
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    value = buf[within + np.repeat(s, n)].astype(np.int64) + 1
    out = np.zeros(len(s), np.uint64)
    for i, p in enumerate(PRIMES):
        base = (1_000_003 + 7_919 * (2 * seed + i)) ** 3 % p
        power = np.ones(1, np.int64)
        while len(power) < n.max():
            power = np.concatenate([power, power * pow(base, len(power), p) % p])
        x = np.add.reduceat(value * power[within] % p, np.cumsum(n) - n) % p
        out = out << U(31) | x.astype(np.uint64)
    return out
