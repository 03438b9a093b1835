"""Vectorised word handling over Arrow string batches.

Words are maximal runs of ASCII letters, digits, underscores and non-ASCII
characters other than Latin-1, general and CJK punctuation.  Lower-casing is
left to ``F.lower`` on the JVM side.  Nothing here loops over words in Python:
a batch is cut into slices of a few MB and every step is one numpy pass.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_INV_B = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ZERO, _ONE = np.uint64(0), np.uint64(1)
_powers: list[np.ndarray] = []

_IS_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _IS_WORD[_c] = True
_IS_WORD[128:] = True


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task, next to the executor's heap."""
    if _powers and len(_powers[0]) > 2 * SLICE_BYTES:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        p = np.full(m, _B, dtype=np.uint64)
        q = np.full(m, _INV_B, dtype=np.uint64)
        p[0] = q[0] = _ONE
        _powers[:] = [np.multiply.accumulate(p), np.multiply.accumulate(q)]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of a slice of documents.

    ``doc`` is the row in the slice of each word, ``first`` has for each row
    the index of its first word and, at the end, the number of words.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        p, q = powers(n + 1)
        c = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + _ONE) * p[:n], out=c[1:])
        return mix64((c[self.end] - c[self.start]) * q[self.start])

    def word(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its row offsets from 0; null is empty."""
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        col, width = col.cast(pa.string()), np.int32
    if len(col) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    o = np.frombuffer(off, dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def word_bytes(buf: np.ndarray) -> np.ndarray:
    w = _IS_WORD[buf]
    n = len(buf)
    for lead in np.flatnonzero(buf == 0xC2):
        if lead + 1 < n and buf[lead + 1] not in (0xAA, 0xB5, 0xBA):
            w[lead : lead + 2] = False
    for a, b in ((0xE2, 0x80), (0xE3, 0x80)):
        at = np.flatnonzero((buf[:-2] == a) & (buf[1:-1] == b)) if n > 2 else []
        for d in range(3):
            w[np.asarray(at, dtype=np.int64) + d] = False
    return w


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None) -> Words:
    n, docs = len(buf), len(offsets) - 1
    if not n:
        e = np.zeros(0, dtype=np.int64)
        return Words(buf, e, e, e, np.zeros(docs + 1, dtype=np.int64), offsets)
    w = word_bytes(buf) if is_word is None else is_word
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = w.copy()
    begins[1:] &= ~w[:-1] | cut[1:n]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(buf, start, end, np.repeat(np.arange(docs), np.diff(first)), first, offsets)


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``limit`` bytes, or one longer row, and at most 32768 rows."""
    _, off = raw(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + 32768, n)
        yield i, j
        i = j
    release()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ngram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and first word of each n-gram inside one document; a shorter document gives one gram of all its words."""
    h = w.hashes()
    if not len(h):
        return h, np.zeros(0, dtype=np.int64)
    size = w.counts[w.doc]
    at = np.arange(len(h)) - w.first[w.doc]
    keep = np.flatnonzero((at + n <= size) | ((size < n) & (at == 0)))
    g = np.zeros(len(keep), dtype=np.uint64)
    left = size[keep] - at[keep]
    for k in range(n):
        x = h[np.minimum(keep + k, len(h) - 1)]
        g = g * np.uint64(0xD6E8FEB86659FD93) + np.where(left > k, x, np.uint64(0x1234567))
    return mix64(g), keep


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of h[i:i+length] for every i where it fits."""
    if len(h) < length:
        return np.zeros(0, dtype=np.uint64)
    p, q = powers(len(h) + 1)
    c = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * p[: len(h)], out=c[1:])
    m = len(h) - length + 1
    return mix64((c[length:] - c[:m]) * q[:m])
