"""Vectorised word, word-hash and shingle extraction over Arrow string columns (bytes in, NumPy arrays out).

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a hash is a polynomial over a random byte
table modulo 2**64 followed by a finalizer. A document's words, and the windows over them, never reach into the next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.RandomState(20240229)
_TABLE = _rng.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _rng.randint(1, 2**63 - 1, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)  # glibc has it


def give_back() -> None:
    """Returns freed memory to the system, as a Python worker lives on between stages."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def _make_powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_kept_powers = lru_cache(maxsize=1)(_make_powers)


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for a chunk's places: kept for chunks of the usual size, made anew for the rare longer text, so that they don't stay."""
    return _kept_powers(bits) if bits <= 20 else _make_powers(bits)


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes, or of one longer row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    del column, data, offsets, raw, off
    give_back()


class Words:
    """start, end (bytes, end exclusive), doc (row of the chunk) and hash of each word; first: each doc's first word, and the end."""

    def __init__(self, data: np.ndarray, off: np.ndarray, trim: bool = False):
        self.data, self.off, docs = data, off, len(off) - 1
        space = _SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = off[(off > 0) & (off < len(data))]
        before[inner], after[inner - 1] = True, True
        self.start, self.end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.start, off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), self.counts)
        if trim:  # punctuation at the edges goes; a word of nothing else stays
            plain = np.concatenate([[0], np.flatnonzero(~_PUNCTUATION[data]) + 1])  # 1-based places of other bytes
            upto = np.concatenate([[0], np.cumsum(~_PUNCTUATION[data])])
            has = upto[self.end] > upto[self.start]
            first, last = plain[np.minimum(upto[self.start] + 1, len(plain) - 1)] - 1, plain[upto[self.end]]
            self.start, self.end = np.where(has, first, self.start), np.where(has, last, self.end)
        up, down = _powers(max(20, int(len(data)).bit_length()))
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWERED[data] * up[: len(data)], out=run[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + length * _STEP[63])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, doc) of every run of `size` words inside a document."""
        m = len(self.start) - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(m, np.uint64)
        for k in range(size):
            h += self.hash[k : k + m] * _STEP[k]
        keep = self.doc[:m] == self.doc[size - 1 :]
        return mix(h[keep]), self.doc[:m][keep]


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all documents as signed 64-bit values, with offsets by document; fewer words: the whole sequence."""
    docs = len(w.off) - 1
    h, d = w.windows(size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = w.counts[short] > k
            extra[has] += w.hash[w.first[short[has]] + k] * _STEP[k]
        h = np.concatenate([h, mix(extra + w.counts[short].astype(np.uint64) * _STEP[62])])
        d = np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h.view(np.int64), np.searchsorted(d, np.arange(docs + 1))


def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))
