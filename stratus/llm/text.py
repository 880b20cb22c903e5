"""Vectorised text helpers for tasks: Arrow batches to NumPy words and hashes.

A batch's string column is viewed as one byte buffer plus document offsets
(no Python string per document or word).  Words and n-grams are named by
64-bit content hashes, so equal words have equal names in every task of every
job; two different n-grams share a name with probability 2**-64.

Nulls count as empty texts.  Documents are never cut: :func:`chunks` packs
whole documents until a byte budget is reached, so memory is bounded by the
budget or the longest document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The multiplier of the rolling hash and its inverse mod 2**64.
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else _BASE_INV
        steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] = sum of values[t] * base**t for i <= t < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of values[start:end] from :func:`prefix_sums`."""
    raw = (prefix[end] - prefix[start]) * _power("down", len(prefix))[start]
    return mix(raw + (end - start).astype(np.uint64) * _ODD)


@dataclass
class Buffer:
    """Documents as one byte array; document i is data[offsets[i]:offsets[i + 1]]."""
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def lower_ascii(self) -> "Buffer":
        return Buffer(ASCII_LOWER[self.data], self.offsets)


def buffer_of(column: pa.Array) -> Buffer:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return Buffer(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Buffer(data[offsets[0]:offsets[-1]], offsets - offsets[0])


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text",
           max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Buffer]]:
    """(rows, their texts) in pieces of whole documents of about ``max_bytes``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf = buffer_of(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < buf.n:
            hi = int(np.searchsorted(buf.offsets, buf.offsets[lo] + max_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), buf.n)
            off = buf.offsets[lo:hi + 1]
            yield batch.slice(lo, hi - lo), Buffer(buf.data[off[0]:off[-1]], off - off[0])
            lo = hi


@dataclass
class Words:
    """Words of a chunk: byte spans, and each document's range of words."""
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray          # words of document i: first[i]:first[i + 1]

    @property
    def n(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def split_words(buf: Buffer, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of non-separator bytes; a run never crosses documents."""
    inside = ~separator[buf.data]
    begins, ends = inside.copy(), inside.copy()
    if len(inside):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = buf.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        begins[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, buf.offsets))


def word_hashes(buf: Buffer, words: Words) -> np.ndarray:
    return span_hash(prefix_sums(_BYTE_VALUE[buf.data]), words.start, words.end)


def byte_span_hashes(buf: Buffer, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(_BYTE_VALUE[buf.data]), start, end)


def bytes_hash(raw: bytes) -> int:
    """The hash that :func:`word_hashes` gives a word of these bytes."""
    data = np.frombuffer(raw, np.uint8)
    return int(span_hash(prefix_sums(_BYTE_VALUE[data]), np.zeros(1, np.int64), np.array([len(raw)]))[0])


def ngram_hashes(names: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start index) of each run of ``n`` consecutive words of one document."""
    start = ngram_starts(first, n)
    return span_hash(prefix_sums(names), start, start + n), start


def ngram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the words at which a run of ``n`` words of one document starts."""
    room = np.maximum(np.diff(first) - n + 1, 0)
    base = np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    return np.arange(room.sum()) + base


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's range (0 for empty ranges)."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over n positions of those within [s, s + length) of any start s."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + length, n), -1)
    return np.cumsum(mark[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit names as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def per_doc_sum_wrapping(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums mod 2**64 of unsigned values over ranges."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]
