"""Whole texts as numpy byte arrays, for use inside Arrow batches. ASCII white space and case as the contracts have them."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space is x20 and x09-x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[bool, np.ndarray] = {}


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """Have a worker, which Spark keeps for later tasks, give freed memory back to the system at a task's end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # Arrow has an allocator of its own
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return wrapped


class Rows:
    """Gathers rows and hands them out in record batches of about a megabyte, whatever a row's size."""

    BYTES = 1 << 20

    def __init__(self, *fields: tuple[str, pa.DataType]):
        self.schema, self.rows, self.size = pa.schema(fields), [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + sum(100 * len(x) if isinstance(x, list) else len(x) for x in row if isinstance(x, (str, bytes, list)))
        if self.size >= self.BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def text_chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) for runs of whole texts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B**i (or its inverse) modulo 2**64 for i < n."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1024), _BASE_INVERSE if inverse else _BASE, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[inverse] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes; see span_hash."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of bytes[start:end], the same wherever these bytes stand.

    inverse: powers(len(prefix), True), which are worked out at each call for a buffer too long for them to be kept.
    """
    return (prefix[end] - prefix[start]) * (powers(len(prefix), True) if inverse is None else inverse)[start]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buf: np.ndarray, off: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more entry at the end)."""
    n = len(buf)
    space = blank[buf]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = space[:-1]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = space[1:]
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64(span_hash(prefix_hash(buf), starts, ends) + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i with n values left."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : k + m]
    return mix64(out)
