"""Vectorised word and byte views of a batch of texts.

A batch is one pyarrow string array.  All helpers work on its UTF-8 buffer with
numpy, so that a task never loops over words in Python.  Words follow the
package-wide definition ``[^\\x20\\x09-\\x0D]+``.

Hashes are 64-bit polynomial hashes over a fixed random byte table (arithmetic
modulo 2**64, odd base, so every prefix can be "shifted back" with the inverse
base) followed by a finaliser.  They depend on the bytes only, so every task of
every run gives the same value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute

_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: powers that a worker keeps; those of longer texts go with their task
KEPT = 1 << 21
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, up to ``KEPT`` of them kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= KEPT:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 data, int64 offsets of len+1); a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """H with H[i] = sum over j < i of T[data[j]] * BASE**j, modulo 2**64."""
    h = np.empty(len(data) + 1, dtype=np.uint64)
    h[0] = 0
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[data] * powers(BASE, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] (element-wise) from a prefix hash."""
    return mix((h[end] - h[start]) * powers(BASE_INV, len(h))[start])


class Words:
    """Words of a batch: byte spans, owner document and 64-bit hash of each."""

    __slots__ = ("data", "doc_offsets", "start", "end", "first", "hash")

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        self.data, self.doc_offsets = batch_bytes(texts)
        n = len(self.data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[self.data]
        edge = inside[1:] != inside[:-1]
        starts = edge[:n] & inside[1:-1]
        ends = np.zeros(n + 1, dtype=bool)
        ends[:] = edge & ~inside[1:]
        # a document border inside the buffer also ends a word and may start one
        inner = self.doc_offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        if len(inner):
            left, right = inside[inner], inside[inner + 1]
            ends[inner[left]] = True
            starts[inner[right]] = True
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends)
        #: index of the first word of each document, len+1 entries
        self.first = np.searchsorted(self.start, self.doc_offsets)
        self.hash = span_hash(prefix_hash(self.data, lower), self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document index) of every k-word window.

        A document of 1 to k-1 words gives its whole sequence as one shingle;
        one without words gives none.  The highest four bits of a window's hash tell the
        bytes of its words, longest windows first: long ones are seldom met by chance.
        """
        n = self.counts()
        doc = np.repeat(np.arange(len(n)), n)
        m = len(self.hash)
        if m == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = np.zeros(m, dtype=np.uint64)
        for i in range(min(k, m)):
            acc[: m - i] = (acc[: m - i] * np.uint64(0x100000001B3)) + mix(self.hash[i:] + np.uint64(i + 1))
        whole = np.repeat(self.first[1:], n) - np.arange(m) >= k
        out, owner = mix(acc[whole]), doc[whole]
        upto, at = np.append(0, np.cumsum(self.end - self.start)), np.flatnonzero(whole)
        grade = 15 - np.minimum((upto[at + k] - upto[at]) // 4, 15)
        out = (out >> np.uint64(4)) | (grade.astype(np.uint64) << np.uint64(60))
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for j, d in enumerate(short):
                x = int(n[d]) * 0x9E3779B97F4A7C15 & _MASK
                for w in self.hash[self.first[d] : self.first[d + 1]]:
                    x = (x * 0x100000001B3 + int(w)) & _MASK
                extra[j] = x
            out = np.concatenate([out, mix(extra)])
            owner = np.concatenate([owner, short])
        return out, owner


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch with about ``limit`` bytes of text, at least one row each."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
    begin, total = 0, 0
    for i, s in enumerate(size):
        if i > begin and total + s > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(s)
    if begin < batch.num_rows:
        yield batch.slice(begin)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Returns the process's unused memory to the system (by malloc too, where it can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(task: Task) -> Task:
    """The task, at whose end its Python worker, which stays with the executor, keeps no unused memory."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
