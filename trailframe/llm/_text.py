"""Columnar text primitives shared by the corpus operators.

All functions work on Arrow string columns seen as one byte buffer with row
offsets, so that a batch of documents is tokenised and hashed by a few numpy
passes instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20
#: Spans beyond this many bytes are hashed and compared whole instead of in rounds.
LONG = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[0x41:0x5B] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `size` bytes of text, or one longer row."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        yield from binary_slices(iter([batch]), i, size)


def binary_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `size` bytes of a binary column, or one longer row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()  # of the batches before


def pack(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A large_string or large_binary array over one byte buffer."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in `member`, not across rows: starts, ends, and offsets of each row's runs."""
    return mask_spans(member[data], offsets)


def mask_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes, not across rows: starts, ends, and offsets of each row's runs."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(inside)]
    first[edge] |= inside[edge]
    edge = edge[edge > 0] - 1
    last[edge] |= inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each span, eight bytes a round, by BLAKE2 beyond LONG bytes; fold: A-Z count as a-z.

    A hash only groups spans: what must be exact compares their bytes (`same_spans`, `word_codes`).
    """
    if fold:
        data = UPPER[data]
    view, size = lanes(data), ends - starts
    out = size.astype(np.uint64) * _STEP
    _blend(out, view[starts] & _FIRST[np.minimum(size, 8)])
    at = 8
    live = np.flatnonzero((size > at) & (size <= LONG))
    while len(live):
        left = size[live] - at
        part = out[live] + _STEP
        out[live] = _blend(part, view[starts[live] + at] & _FIRST[np.minimum(left, 8)])
        live = live[left > 8]
        at += 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _blend(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """One round of a hash, in place; a bijection of each part."""
    h ^= part
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span equal those of its counterpart."""
    one, two, size = lanes(data), lanes(other) if other is not data else None, ends - starts
    two = one if two is None else two
    out = (size == other_ends - other_starts) & (((one[starts] ^ two[other_starts]) & _FIRST[np.minimum(size, 8)]) == 0)
    live, at = np.flatnonzero(out & (size > 8)), 8
    while len(live) and at <= LONG:
        left = size[live] - at
        same = ((one[starts[live] + at] ^ two[other_starts[live] + at]) & _FIRST[np.minimum(left, 8)]) == 0
        out[live[~same]] = False
        live = live[same & (left > 8)]
        at += 8
    for i in live.tolist():
        out[i] = np.array_equal(data[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    return out


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal only for equal bytes, and the first span of each number."""
    if fold:
        data = UPPER[data]
    code, distinct = pd.factorize(span_hashes(data, starts, ends))
    first = np.zeros(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    odd = np.flatnonzero(~same_spans(data, starts, ends, data, starts[first[code]], ends[first[code]]))
    if len(odd):  # spans that share a hash with others
        known: dict[bytes, int] = {}
        for i in odd.tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            if raw not in known:
                known[raw] = len(first)
                first = np.append(first, i)
            code[i] = known[raw]
    return code.astype(np.int64), first


def ragged_take(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the given runs of a ragged array, in order."""
    length = offsets[index + 1] - offsets[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(length, out=out[1:])
    at = np.repeat(offsets[index] - out[:-1], length)
    at += np.arange(out[-1])
    return values[at], out
