"""Vectorised words of Arrow string columns: flat byte arrays with offsets, never one Python object per word.

Words are maximal runs of bytes other than space and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Text bytes handled at once inside a task.
PIECE = 3 << 20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` of about ``limit`` text bytes each (a longer text makes a slice of its own)."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that aren't ``blank``), and the first word's index of each row (plus the total)."""
    solid = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The given spans of ``data`` one after another, and their offsets; indexes are made for ``chunk`` items at a time."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    out = np.empty(offsets[-1], data.dtype)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1)
        out[offsets[a] : offsets[b]] = data[np.arange(offsets[a], offsets[b]) + np.repeat(starts[a:b] - offsets[a:b], lengths[a:b])]
        a = b
    return out, offsets


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each: bytes, start and end of each word in them."""
    lengths = ends - starts + 1
    if not len(lengths):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.append(data, np.uint8(0x20))
    out, offsets = gather(padded, starts, lengths)
    out[offsets[1:] - 1] = 0x20
    return out, offsets[:-1], offsets[1:] - 1


def binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A binary or string column of the given bytes and offsets."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = 0x9E3779B97F4A7C15
POWERS = np.ones(1, np.uint64)
INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global POWERS, INVERSES
    if len(POWERS) < n:
        def raised(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)
        POWERS, INVERSES = raised(ODD), raised(pow(ODD, -1, 1 << 64))
    return POWERS[:n], INVERSES[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each span by prefix sums: equal bytes give equal hashes. For routing and features, not for equality.

    Starts ascend and spans don't overlap; sums are made over about ``chunk`` bytes at a time.
    """
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + chunk, "right")))
        low, high = starts[a], ends[b - 1]
        powers, inverses = _powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=sums[1:], dtype=np.uint64)
        at, to = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mixed((sums[to] - sums[at]) * inverses[at] + (to - at).astype(np.uint64))
        a = b
    return out
