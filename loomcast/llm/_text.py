"""Vectorised text helpers shared by the Arrow-based operators.

A record batch of texts is read as one UTF-8 byte buffer plus row offsets, and words, word hashes and character
n-grams come out of whole-buffer numpy passes; no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes and rows of text that one numpy pass works on (a single longer text is still taken whole).
CHUNK_BYTES, CHUNK_ROWS = 1 << 19, 256
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that share one running sum; a long text is hashed in segments of so many bytes.
_SEGMENT = 1 << 19
_powers: dict[str, np.ndarray] = {}


def small(batches, column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``CHUNK_BYTES`` of text in a column and ``CHUNK_ROWS`` rows, without a copy.

    Spark bounds the batches it sends by bytes (spark.sql.execution.arrow.maxBytesPerBatch); what is made of one text or batch is bounded here.
    """
    for b in batches:
        for at, end, *_ in chunks(b.column(column)):
            yield b.slice(at, end - at)


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """Wraps an Arrow map so that its Python worker, which later tasks reuse, gives its memory back at a task's end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end, bytes, offsets) of at most about ``limit`` bytes and ``CHUNK_ROWS`` rows each."""
    raw, off = utf8(column)
    n, at = len(off) - 1, 0
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1), at + CHUNK_ROWS)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def byte_table(separator, lower: bool = True) -> np.ndarray:
    """A 256-entry table: 0 for bytes that part words, else the byte, A-Z lower-cased if asked for."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    for b in range(256):
        if separator(b):
            table[b] = 0
    return table


#: Words are runs of anything but ASCII white space; of letters, digits and non-ASCII characters.
SPACED = byte_table(lambda b: b == 0x20 or 9 <= b <= 13)
ALNUM = byte_table(lambda b: b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)


@dataclass
class Words:
    start: np.ndarray  #: byte positions
    end: np.ndarray
    bounds: np.ndarray  #: row i has words bounds[i]:bounds[i+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(mapped: np.ndarray, off: np.ndarray) -> Words:
    """Word spans of a mapped buffer; words never reach over a row's end."""
    n = len(mapped)
    inside = mapped != 0
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, off))


def _power() -> tuple[np.ndarray, np.ndarray]:
    """Powers up to ``_SEGMENT``, and inverse ones: a fixed table, however long a text is."""
    if not _powers:
        for name, p in (("up", _P), ("down", _P_INV)):
            steps = np.full(_SEGMENT + 1, p, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(mapped: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on their bytes alone, by differences of a prefix polynomial. Starts are in order."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = max(at + 1, int(np.searchsorted(start, low + _SEGMENT // 2)))
        most = int(end[at:stop].max()) - low
        if most > _SEGMENT:  # a span longer than half a segment: taken alone, the others before or after it
            long = at + int(np.argmax(end[at:stop] - low > _SEGMENT))
            if long > at:
                stop, most = long, int(end[at:long].max()) - low
            else:
                out[at] = _long_hash(mapped[low : end[at]])
                at += 1
                continue
        out[at:stop] = _hashes(mapped[low : low + most], start[at:stop] - low, end[at:stop] - low)
        at = stop
    return out


def _hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power()
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _long_hash(span: np.ndarray) -> np.uint64:
    """The same polynomial for one span over ``_SEGMENT`` bytes, segment by segment."""
    up, _ = _power()
    total = 0
    for k in range(0, len(span), _SEGMENT):
        part = span[k : k + _SEGMENT].astype(np.uint64) + np.uint64(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_P), k, 1 << 64)
    return mix(np.array([(total + len(span)) % (1 << 64)], np.uint64))[0]


def byte_ngrams(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n bytes that start at each position, n at most 8; the last n-1 positions are left out."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    out = np.zeros(m, np.uint32)
    for i in range(n):
        out *= np.uint32(257)
        out += raw[i : i + m]
    out *= np.uint32(0x9E3779B1)
    out ^= out >> np.uint32(15)
    return out


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], 0 for empty rows; equal rows have equal sums wherever they stand."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), bounds[:-1][full])
    return out
