"""Vectorised text routines used inside Arrow batches: many documents are
laid end to end in one byte array, and words, shingles and window hashes come
from prefix sums over it. Memory follows ``BLOCK`` bytes of text, or the
longest single document."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x):
    """splitmix64 finaliser, element-wise."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int):
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Rolling:
    """Hashes of arbitrary byte ranges: sum of table[byte] * r**i modulo
    2**64, shifted back to position 0 with the inverse of r."""

    def __init__(self, seed: int, r: int):
        self.table, self.r, self.inv = _table(seed), r, pow(r, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n):
        if len(self.up) >= n:
            return
        with np.errstate(over="ignore"):
            out = []
            for base in (self.r, self.inv):
                p, step = np.ones(1, np.uint64), base
                while len(p) < n:
                    p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
                out.append(p)
        self.up, self.down = out

    def prefix(self, buf):
        self._grow(len(buf) + 1)
        p = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[buf] * self.up[:len(buf)], out=p[1:])
        return p

    def ranges(self, prefix, start, end):
        with np.errstate(over="ignore"):
            return (prefix[end] - prefix[start]) * self.down[start]


ROLL_A, ROLL_B = Rolling(11, 0x9E3779B97F4A7C15 | 1), Rolling(29, 0xC2B2AE3D27D4EB4F | 1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def blocks(texts, limit: int = BLOCK):
    """Index ranges of consecutive texts with about ``limit`` bytes in all."""
    i, n, size = 0, len(texts), 0
    for j in range(n):
        size += len(texts[j]) + 1
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < n:
        yield i, n


def lay(raw, gap: bytes = b"\n"):
    """Byte array of all texts with ``gap`` after each, and their starts."""
    lens = np.fromiter((len(x) + len(gap) for x in raw), np.int64, len(raw))
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    return np.frombuffer(gap.join([*raw, b""]), np.uint8), starts


def words(raw, lower: bool = True):
    """(hash, document index, start, end) of every word of the given UTF-8
    texts; positions refer to the array that ``lay`` makes."""
    buf, starts = lay(raw)
    if lower:
        buf = _LOW[buf]
    non = np.empty(len(buf) + 2, np.int8)
    non[0] = non[-1] = 0
    non[1:-1] = ~_SEP[buf]
    edge = np.diff(non)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(starts, s, "right") - 1
    p = ROLL_A.prefix(buf)
    with np.errstate(over="ignore"):
        h = mix(ROLL_A.ranges(p, s, e) + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, doc, s, e


def shingles(h, doc, n_docs: int, k: int):
    """Distinct k-word shingles of each document as (hash, document index),
    sorted by document and hash. A document with fewer than k words has its
    whole sequence as one shingle."""
    n = len(h)
    c = np.uint64(0xFF51AFD7ED558CCD)
    with np.errstate(over="ignore"):
        if n >= k:
            g = h[:n - k + 1].copy()
            for j in range(1, k):
                g = mix(g * c + h[j:n - k + 1 + j])
            ok = doc[:n - k + 1] == doc[k - 1:]
            g, d = g[ok], doc[:n - k + 1][ok]
        else:
            g, d = np.empty(0, np.uint64), np.empty(0, doc.dtype)
        count = np.bincount(doc, minlength=n_docs)
        first = np.searchsorted(doc, np.arange(n_docs))
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for x, i in enumerate(short):
                v = np.uint64(count[i])
                for w in h[first[i]:first[i] + count[i]]:
                    v = mix(v * c + w)
                extra[x] = v
            g, d = np.concatenate([g, extra]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[keep], d[keep]
