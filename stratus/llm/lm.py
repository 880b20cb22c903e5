"""Language-model scoring with an Elias-Fano n-gram trie.

Model.  Interpolated absolute discounting over words and an end token:

    P(w | ctx) = a(ctx, w) + rest(ctx) * P(w | shorter ctx)

with a = (count - DISCOUNT) / count(ctx) for n-grams seen at least ``min_count``
times (1 keeps every n-gram; the registered query does), rest = what the kept a's of the context leave, and the exact add-half
unigram at the bottom.  a and rest are stored as one byte each (log10 in steps of
1 / STEPS).

Levels.  A level is a set of shard files in the shared folder; a context's hash
picks its shard, so the shards are balanced and as many as the corpus needs.  A
shard holds three monotone sequences in Elias-Fano form: its contexts, the range
of successors of each, and the successors, relative to their context's rank.  A
query finds its context, then the successor within that range only.  Node numbers
are positions (plus the shard's offset), so the next level's contexts are small
numbers too.  Files are memory-mapped; a task keeps nothing but what it touches.

Counting.  Tasks count the n-grams of their own documents, send them packed and
sorted per shard, and one task per shard merges and writes its file.  Order n is
counted after order n - 1 is written, and only n-grams whose two shorter parts
were kept are sent: none that could reach ``min_count`` is lost.

Scoring has no shuffle: each task looks its distinct n-grams up.

Defined results: null and empty texts are the end token alone; rows without an id
are scored but not learned from and not held out; repeated rows count as often as
they occur; an empty table gives no rows; without training rows every token has
the unigram probability of an empty corpus.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm import text as X
from stratus.session import scratch_path

ORDER = 3
#: Default of ``min_count``; the registered query passes 1.
MIN_COUNT = 2
DISCOUNT = 0.75
STEPS = 32
FOLDS = 5
HELD_OUT = 1
#: Training tokens per shard of a level; bounds a shard task's memory.
SHARD_TOKENS = 2_000_000
#: Counted n-grams that a task holds before it sends them.
FLUSH = 1_500_000
END = np.uint64(X.bytes_hash(b" end "))       # no word contains a space
_U64 = np.uint64


# Elias-Fano sequences ---------------------------------------------------------

def ef_build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A nondecreasing sequence of integers below ``universe`` as low bits, unary high bits and ranks."""
    n = len(values)
    values = np.asarray(values, _U64)
    low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    high = (values >> _U64(low)).astype(np.int64)
    packed = np.zeros(n * low // 64 + 2, _U64)
    if low:
        bits = values & _U64((1 << low) - 1)
        at = np.arange(n, dtype=np.int64) * low
        word, shift = at >> 6, (at & 63).astype(_U64)
        np.bitwise_or.at(packed, word, bits << shift)
        over = (shift > 64 - low)
        np.bitwise_or.at(packed, word[over] + 1, bits[over] >> (_U64(64) - shift[over]))
    size = n + ((max(universe, 1) - 1) >> low) + 2
    marks = np.zeros((size + 63) // 64 * 64, bool)
    marks[high + np.arange(n)] = True
    unary = np.packbits(marks, bitorder="little").view(_U64)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(unary), dtype=np.int64)))
    return {"low": packed, "unary": unary, "ones": ones.astype(np.uint32 if n < 1 << 32 else np.int64),
            "head": np.array([n, low], np.int64)}


def _select(unary: np.ndarray, before: np.ndarray, k: np.ndarray, zero: bool) -> np.ndarray:
    """Position of the k-th (from 0) one, or zero, of a bit sequence with counts before each word."""
    word = np.searchsorted(before, k, "right") - 1
    left = k - before[word].astype(np.int64)
    bits = unary[word]
    if zero:
        bits = ~bits
    at = np.zeros(len(k), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        part = np.bitwise_count(bits & _U64((1 << half) - 1)).astype(np.int64)
        skip = left >= part
        left = np.where(skip, left - part, left)
        bits = np.where(skip, bits >> _U64(half), bits)
        at += np.where(skip, half, 0)
    return word * 64 + at


class Monotone:
    """Reads an Elias-Fano sequence, any number of positions or values at a time."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.unary, self.ones = parts["low"], parts["unary"], parts["ones"]
        self.n, self.bits = (int(x) for x in parts["head"])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.most = int(self.zeros[-1]) - 1         # greatest high bits that a bucket ends for

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U64)
        out = self.low[word] >> shift
        over = shift > 0
        out[over] |= self.low[word[over] + 1] << (_U64(64) - shift[over])
        return out & _U64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = _select(self.unary, self.ones, i, False) - i
        return (high.astype(_U64) << _U64(self.bits)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of positions whose values have these high bits (each at most ``self.most``)."""
        at = np.zeros(len(high), np.int64)
        some = high > 0
        at[some] = _select(self.unary, self.zeros, high[some] - 1, True) + 1
        word, shift = at >> 6, (at & 63).astype(_U64)
        bits = self.unary[word] >> shift
        size = np.bitwise_count(bits & ~(bits + _U64(1))).astype(np.int64)     # ones up to the next zero
        first = at - high
        over = np.flatnonzero(size == 64 - (at & 63))                           # they may go on in the next word
        if len(over):
            size[over] = _select(self.unary, self.zeros, high[over], True) - at[over]
        return first, first + size

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Position of each value, or -1; within [lo, hi) if given."""
        x = np.asarray(x, _U64)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        high = (x >> _U64(self.bits)).astype(np.int64)
        live = np.flatnonzero(high <= self.most)
        first, last = self._bucket(high[live])
        if lo is not None:
            first, last = np.maximum(first, lo[live]), np.minimum(last, hi[live])
        on = first < last
        live, first, last = live[on], first[on], last[on]
        want = x[live] & _U64((1 << self.bits) - 1)
        while len(live):            # successor search: halve what is left of each range
            mid = (first + last) >> 1
            got = self._low(mid)
            hit = got == want
            out[live[hit]] = mid[hit]
            less = got < want
            first, last = np.where(less, mid + 1, first), np.where(less, last, mid)
            on = ~hit & (first < last)
            live, first, last, want = live[on], first[on], last[on], want[on]
        return out


# Files ------------------------------------------------------------------------

def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON with places, then the arrays.  Appears whole or not at all."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [at, len(a), a.dtype.str]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 1) % 8) + b"\n"
    fs, path = _filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as out:
        out.write(text)
        for a in arrays.values():
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 8))
    fs.move(part, path)


@lru_cache(maxsize=4096)
def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is fetched once per process."""
    fs, path = _filesystem(uri)
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        local = tempfile.NamedTemporaryFile(prefix="level-", delete=False)
        with fs.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                local.write(block)
        local.close()
        raw = np.memmap(local.name, np.uint8, "r")
        os.unlink(local.name)
    else:
        raw = np.memmap(path, np.uint8, "r")
    first = bytes(raw[:1 << 16]).index(b"\n") + 1
    return {name: raw[first + at:first + at + n * np.dtype(kind).itemsize].view(kind)
            for name, (at, n, kind) in json.loads(bytes(raw[:first])).items()}


@lru_cache(maxsize=16384)
def _sequence(uri: str, name: str) -> Monotone:
    arrays = map_arrays(uri)
    return Monotone({k: arrays[f"{name}.{k}"] for k in ("low", "unary", "ones", "head")})


def _put(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in parts.items()}


@dataclass(frozen=True)
class Level:
    """Where a level's shards are, and the first node number of each."""
    folder: str
    order: int
    offsets: np.ndarray       # shards + 1

    @property
    def shards(self) -> int:
        return len(self.offsets) - 1

    @property
    def nodes(self) -> int:
        return int(self.offsets[-1])

    def file(self, shard: int) -> str:
        return f"{self.folder}/{self.order}-{shard:06d}.ef"

    def array(self, shard: int, name: str) -> np.ndarray:
        return map_arrays(self.file(shard))[name]

    def sequence(self, shard: int, name: str) -> Monotone:
        return _sequence(self.file(shard), name)


def _route(context: np.ndarray, shards: int) -> np.ndarray:
    return (X.mix(context.astype(_U64)) % _U64(shards)).astype(np.int64)


def _word_shard(names: np.ndarray, shards: int) -> np.ndarray:
    """Words are split by value, so that a shard's words lie close together."""
    width = _U64((1 << 64) // shards + 1)
    return (names // width).astype(np.int64)


def _by_shard(shard: np.ndarray):
    if len(shard) and shard.max() < 1 << 16:
        shard = shard.astype(np.uint16)         # sorted by radix
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(shard[part[0]]), part


def find_words(level: Level, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, count) of word hashes; node -1 and count 0 if never seen in training."""
    node, count = np.full(len(names), -1, np.int64), np.zeros(len(names), np.int64)
    for shard, part in _by_shard(_word_shard(names, level.shards)):
        if level.offsets[shard] == level.offsets[shard + 1]:
            continue
        base = _U64(shard * ((1 << 64) // level.shards + 1))
        at = level.sequence(shard, "keys").find(names[part] - base)
        hit = at >= 0
        node[part[hit]] = at[hit] + level.offsets[shard]
        count[part[hit]] = _counts(level, shard, at[hit])
    return node, count


def _counts(level: Level, shard: int, at: np.ndarray) -> np.ndarray:
    sums = level.sequence(shard, "sums")
    return (sums.get(at + 1) - sums.get(at)).astype(np.int64)


def node_counts(level: Level, node: np.ndarray) -> np.ndarray:
    """Training counts of nodes of a level."""
    out = np.zeros(len(node), np.int64)
    for shard, part in _by_shard(np.searchsorted(level.offsets, node, "right") - 1):
        out[part] = _counts(level, shard, node[part] - level.offsets[shard])
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each run of equal neighbours, and the run of each position."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh], np.cumsum(fresh) - 1


def find_next(level: Level, words: int, context: np.ndarray, word: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, a, rest) of context-word pairs; unseen pairs: -1 and 0; unseen contexts: rest 1."""
    n = len(context)
    node, a, rest = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
    asked = np.flatnonzero(context >= 0)
    for shard, part in _by_shard(_route(context[asked], level.shards)):
        if level.offsets[shard] == level.offsets[shard + 1]:
            continue
        part = asked[part]
        own, run = _runs(context[part])         # pairs of one context lie together: it is looked up once
        rank = level.sequence(shard, "contexts").find(own)
        known = rank >= 0
        value, lo, hi = np.ones(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        value[known] = _VALUE[level.array(shard, "rest")[rank[known]]]
        ranges = level.sequence(shard, "ranges")
        lo[known], hi[known] = ranges.get(rank[known]), ranges.get(rank[known] + 1)
        rest[part] = value[run]
        seen = known[run] & (word[part] >= 0)
        part, run = part[seen], run[seen]
        at = level.sequence(shard, "next").find(rank[run] * words + word[part], lo[run], hi[run])
        hit = at >= 0
        node[part[hit]] = at[hit] + level.offsets[shard]
        a[part[hit]] = _VALUE[level.array(shard, "a")[at[hit]]]
    return node, a, rest


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 255).astype(np.uint8)


#: The number that each byte stands for.
_VALUE = 10.0 ** (-np.arange(256) / STEPS)


# Counting ---------------------------------------------------------------------

def _pack(columns: list[np.ndarray]) -> bytes:
    """Integer columns as compressed byte planes; the first, sorted, as differences."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = b"".join(np.ascontiguousarray(c.astype(_U64)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.Codec("zstd").decompress(blob[8:], n * 8 * columns)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
    out = [np.ascontiguousarray(p.T).view(_U64).ravel() for p in planes]
    out[0] = np.cumsum(out[0], dtype=_U64)
    return out


def _summed(keys: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(count):
        return keys, count
    width = int(keys[-1].max()) + 1
    if len(keys) == 1:
        order = np.argsort(keys[0])
    elif len(keys) == 2 and (int(keys[0].max()) + 1) * width < 1 << 63:
        order = np.argsort(keys[0].astype(_U64) * _U64(width) + keys[1].astype(_U64))
    else:
        order = np.lexsort(keys[::-1])
    keys, count = [k[order] for k in keys], count[order]
    fresh = np.ones(len(count), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(fresh)
    return [k[at] for k in keys], np.add.reduceat(count, at)


def _send(keys: list[np.ndarray], count: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    shards, blobs = [], []
    for s, part in _by_shard(shard):
        shards.append(s)
        blobs.append(_pack([*(k[part] for k in keys), count[part]]))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


class _Tally:
    """Counts of a task's n-grams; hands them out sorted when they are many."""

    def __init__(self, route):
        self.route, self.parts, self.size = route, [], 0

    def add(self, keys: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, count))
        self.size += len(count)
        if self.size > FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys = [np.concatenate(k) for k in zip(*(p[0] for p in self.parts))]
            keys, count = _summed(keys, np.concatenate([p[1] for p in self.parts]))
            yield _send(keys, count, self.route(keys[0]))
        self.parts, self.size = [], 0


def _tokens(buf: X.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): words of each document and its end token."""
    buf = buf.lower_ascii()
    words = X.split_words(buf)
    first = words.first + np.arange(buf.n + 1)
    out = np.full(first[-1], END, _U64)
    keep = np.ones(first[-1], bool)
    keep[first[1:] - 1] = False
    out[keep] = X.word_hashes(buf, words)
    return out, first


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(lambda names: _word_shard(names, shards))
        for _, buf in X.chunks(batches, max_bytes=4 << 20):
            names, count = np.unique(_tokens(buf)[0], return_counts=True)
            yield from tally.add([names], count)
        yield from tally.flush()
    return run


class _Lookup:
    """Nodes of the tokens of a buffer, order by order."""

    def __init__(self, levels: list[Level]):
        self.levels, self.words = levels, levels[0].nodes + 1
        self.start = levels[0].nodes          # the word before a document's first

    def words_of(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, inverse = np.unique(names, return_inverse=True)
        node, count = find_words(self.levels[0], names)
        return node[inverse], count[inverse]

    def follow(self, level: Level, context: np.ndarray, word: np.ndarray):
        """:func:`find_next` over the distinct pairs with a context only."""
        n = len(word)
        node, a, rest = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        asked = np.flatnonzero(context >= 0)
        keys, inverse = _distinct_pairs(context[asked], word[asked], self.words)
        node[asked], a[asked], rest[asked] = (x[inverse] for x in find_next(level, self.words, *keys))
        return node, a, rest


def _distinct_pairs(context: np.ndarray, word: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct pairs, those of one context together, and the pair of each position."""
    if not len(context):
        return [context, word], np.zeros(0, np.int64)
    if int(context.max()) < (1 << 62) // (words + 1):
        key, inverse = np.unique(context * (words + 1) + word + 1, return_inverse=True)
        return [key // (words + 1), key % (words + 1) - 1], inverse
    order = np.lexsort((word, context))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (context[order[1:]] != context[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return [context[order[fresh]], word[order[fresh]]], inverse


def _previous(values: np.ndarray, first: np.ndarray, at_start: int) -> np.ndarray:
    """The value one token earlier in the same document."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first[:-1]] = at_start
    return out


def _count_next(levels: list[Level], shards: int, min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(levels)
        tally = _Tally(lambda context: _route(context, shards))
        for _, buf in X.chunks(batches, max_bytes=4 << 20):
            names, first = _tokens(buf)
            word, count = look.words_of(names)
            usable = count >= min_count
            node = word
            for level in levels[1:]:          # nodes of the run that ends at each token
                node = look.follow(level, _previous(node, first, look.start if level is levels[1] else -1), word)[0]
                usable &= node >= 0           # the later part of the n-gram must have been kept
            context = _previous(node, first, look.start if len(levels) == 1 else -1)
            usable &= context >= 0            # and the earlier part
            if len(levels) == 1:
                usable &= _previous(count, first, min_count) >= min_count
            keys, n = _summed([context[usable].astype(_U64), word[usable].astype(_U64)],
                              np.ones(int(usable.sum()), np.int64))
            yield from tally.add(keys, n)
        yield from tally.flush()
    return run


def _write_words(level: Level):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [_unpack(b.as_py(), 2) for b in table.column("blob")]
        (names,), count = _summed([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]))
        width = (1 << 64) // level.shards + 1
        arrays = {**_put("keys", ef_build(names - _U64(shard * width), width)),
                  **_put("sums", ef_build(np.concatenate(([0], np.cumsum(count))), int(count.sum()) + 1))}
        write_arrays(level.file(shard), arrays)
        return pa.table({"shard": [shard], "nodes": [len(names)], "total": [int(count.sum())],
                         "bytes": [sum(a.nbytes for a in arrays.values())]})
    return run


def _write_next(level: Level, levels: list[Level], start_count: int, min_count: int):
    words = levels[0].nodes + 1

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [_unpack(b.as_py(), 3) for b in table.column("blob")]
        (context, word), count = _summed([np.concatenate([p[i] for p in parts]) for i in (0, 1)],
                                         np.concatenate([p[2] for p in parts]))
        kept = count >= min_count
        context, word, count = context[kept].astype(np.int64), word[kept].astype(np.int64), count[kept].astype(np.int64)
        own, first = np.unique(context, return_index=True)
        edge = np.append(first, len(context))
        of = np.full(len(own), start_count, np.int64)
        inner = own < levels[-1].nodes          # the only other context is the start of a document
        of[inner] = node_counts(levels[-1], own[inner])
        rank = np.repeat(np.arange(len(own)), np.diff(edge))
        a = (count - DISCOUNT) / np.maximum(of[rank], 1)
        rest = 1 - np.add.reduceat(a, first) if len(own) else np.zeros(0)
        arrays = {**_put("contexts", ef_build(own, levels[-1].nodes + 1)),
                  **_put("ranges", ef_build(edge, len(context) + 1)),
                  **_put("next", ef_build(rank * words + word, max(len(own), 1) * words)),
                  **_put("sums", ef_build(np.concatenate(([0], np.cumsum(count))), int(count.sum()) + 1)),
                  "a": _quantised(a), "rest": _quantised(np.maximum(rest, 1e-7))}
        write_arrays(level.file(shard), arrays)
        return pa.table({"shard": [shard], "nodes": [len(context)], "total": [int(count.sum())],
                         "bytes": [sum(x.nbytes for x in arrays.values())]})
    return run


@dataclass(frozen=True)
class Model:
    levels: tuple[Level, ...]
    tokens: int          # N: training tokens
    documents: int       # training documents

    @property
    def words(self) -> int:
        """V: distinct training tokens."""
        return self.levels[0].nodes


_FILES = "shard long, nodes long, total long, bytes long"


def _built(sent: DataFrame, write, level: Level) -> tuple[Level, int]:
    """Write a level's shards (one task each) and read back how many nodes each got."""
    got = sent.groupBy("shard").applyInArrow(write, _FILES).toPandas()      # one row per shard
    nodes = np.zeros(level.shards, np.int64)
    nodes[got["shard"]] = got["nodes"]
    return Level(level.folder, level.order, np.concatenate(([0], np.cumsum(nodes)))), int(got["total"].sum())


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT,
          shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count, smooth and write the trie of the rows marked ``training``."""
    spark = docs.sparkSession
    docs = docs.where("training").select("text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("documents")).first()
    # A word takes some six bytes; the exact number does not matter.
    shards = max(4, -(-int(size["bytes"] or 0) // (6 * shard_tokens)))
    folder = scratch_path(spark, "ngram-trie")
    level = Level(folder, 1, np.zeros(shards + 1, np.int64))
    level, tokens = _built(docs.mapInArrow(_count_words(shards), "shard long, blob binary"), _write_words(level), level)
    levels = [level]
    for n in range(2, order + 1):
        level = Level(folder, n, np.zeros(shards + 1, np.int64))
        sent = docs.mapInArrow(_count_next(levels, shards, min_count), "shard long, blob binary")
        levels.append(_built(sent, _write_next(level, levels, int(size["documents"]), min_count), level)[0])
    return Model(tuple(levels), tokens, int(size["documents"]))


# Scoring ----------------------------------------------------------------------

def score_tokens(names: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, base log10, model log10) of each token."""
    look = _Lookup(list(model.levels))
    word, count = look.words_of(names)
    base = (count + 0.5) / (model.tokens + 0.5 * (model.words + 1))
    p = base.copy()
    node = word
    for level in model.levels[1:]:
        context = _previous(node, first, look.start if level is model.levels[1] else -1)
        node, a, rest = look.follow(level, context, word)
        p = a + rest * p
    return count > 0, np.log10(base), np.log10(p)


def _exact_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over documents that do not depend on the other documents of the chunk."""
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf in X.chunks(batches, max_bytes=4 << 20):
            names, first = _tokens(buf)
            known, base, full = score_tokens(names, first, model)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(first)), pa.array(X.per_doc_sum(known, first)),
                 pa.array(_exact_sums(base, first)), pa.array(_exact_sums(full, first))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return run


def lm_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long"), "text",
                       F.coalesce(fold != HELD_OUT, F.lit(False)).alias("training"))
    model = train(rows, order, min_count)
    scored = rows.select("doc_id", "text").mapInArrow(
        _score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
