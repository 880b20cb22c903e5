"""Piece encoding and decoding: batched Viterbi over a public vocabulary.

A text becomes its escaped form: a leading space mark, then every space as the
mark (a byte that UTF-8 never uses, so the mark's printed form in a text stays
apart).  No piece has a mark after another character, so the best path of a text
is the concatenation of the best paths of its words (a run of marks and what
follows up to the next run); a task solves each distinct word once.

Words of equal length advance together.  For every piece length the hashes of
all substrings of that length probe the sorted hashes of the pieces; then one
vectorised maximum per end position stores best scores and backpointers.
Characters outside the vocabulary fall back to byte pieces, so every text has a
path and decoding restores it exactly.

Piece scores.  The public vocabulary file ranks its pieces by merges instead of
giving log probabilities; a piece of rank r gets ``-log(r + RANK_SHIFT)`` (Zipf's
law), a byte piece ``BYTE_SCORE``.  Sums are integers in units of 1 / SCALE.
Ties take the longer last piece, so the result does not depend on the batch.

Defined results: null texts have null ids, empty texts no ids; null ids of
documents and repeated rows keep one row each; control characters and U+0000 go
through byte pieces; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm import text as X

MARK = "▁"
RANK_SHIFT = 8.0
BYTE_SCORE = -30.0
SCALE = 1 << 16
#: Cells (word x position x piece length) of one Viterbi matrix.
CELLS = 1 << 18
#: Distinct words whose paths a task remembers before it starts afresh.
REMEMBERED = 1 << 20
SPACE_MARK = 0xFF
PROBE_BITS = 20


def default_model() -> str:
    """The file named by ``PIECE_MODEL``, else the public one of the environment."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@dataclass
class Vocabulary:
    probe: np.ndarray         # first key with at least these leading bits, -1 where none has them
    crowd: int                # most keys that share their leading bits
    keys: np.ndarray          # sorted hashes of the pieces' bytes
    ids: np.ndarray           # their ids
    scores: np.ndarray        # their scores, fixed point
    lengths: list[int]        # byte lengths that occur
    byte_ids: np.ndarray      # id of each byte's piece
    surface: np.ndarray       # bytes of all ids, the mark as a space
    edges: np.ndarray         # surface[edges[i]:edges[i + 1]] belongs to id i


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a vocabulary; kept once per process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, surface = [], [], []
    byte_ids = np.zeros(256, np.int64)
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value] = i
            surface.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            piece = model.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} has a space mark inside")
            pieces.append(piece.encode().replace(MARK.encode(), bytes([SPACE_MARK])))
            ids.append(i)
            surface.append(piece.replace(MARK, " ").encode())
    merge = np.array([model.get_score(i) for i in ids])
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, -merge))] = np.arange(len(ids))
    keys = np.array([X.bytes_hash(p) for p in pieces], np.uint64)
    order = np.argsort(keys)
    top, first, crowd = np.unique(keys[order] >> np.uint64(64 - PROBE_BITS), return_index=True, return_counts=True)
    probe = np.full(1 << PROBE_BITS, -1, np.int32)
    probe[top] = first
    return Vocabulary(
        probe, int(crowd.max()), keys[order], np.array(ids)[order], np.rint(-np.log(rank + RANK_SHIFT) * SCALE).astype(np.int64)[order],
        sorted({len(p) for p in pieces}), byte_ids,
        np.frombuffer(b"".join(surface), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in surface]))))


def escape(buf: X.Buffer) -> X.Buffer:
    """A mark before every non-empty text, and every space as a mark."""
    full = np.diff(buf.offsets) > 0
    offsets = buf.offsets + np.concatenate(([0], np.cumsum(full)))
    out = np.full(int(offsets[-1]), SPACE_MARK, np.uint8)
    at = np.ones(len(out), bool)
    at[offsets[:-1][full]] = False
    out[at] = np.where(buf.data == 0x20, np.uint8(SPACE_MARK), buf.data)
    return X.Buffer(out, offsets)


def split_at_marks(buf: X.Buffer) -> X.Words:
    """Words of escaped texts: a new word starts at each mark that no mark precedes."""
    mark = buf.data == SPACE_MARK
    start = mark.copy()
    start[1:] &= ~mark[:-1]
    start[buf.offsets[:-1][np.diff(buf.offsets) > 0]] = True
    begin = np.flatnonzero(start)
    return X.Words(begin, np.append(begin[1:], len(buf.data)), np.searchsorted(begin, buf.offsets))


def best_paths(buf: X.Buffer, start: np.ndarray, end: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, edges): the ids of word i are ids[edges[i]:edges[i + 1]]."""
    length = end - start
    owner, found, place = [], [], []
    for size in np.unique(length):
        group = np.flatnonzero(length == size)
        per = max(1, CELLS // (int(size) * min(int(size), len(vocab.lengths))))
        for lo in range(0, len(group), per):
            part = group[lo:lo + per]
            rows = buf.data[start[part][:, None] + np.arange(size)]
            w, p, i = _advance(rows, vocab)
            owner.append(part[w])
            place.append(p)
            found.append(i)
    if not owner:
        return np.zeros(0, np.int64), np.zeros(len(start) + 1, np.int64)
    owner, place, found = map(np.concatenate, (owner, place, found))
    order = np.argsort(owner * (int(length.max()) + 1) + place)
    return found[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(start)))))


def _advance(rows: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi over words of one length (one per row): (row, start byte, id) of each piece."""
    n, size = rows.shape
    rows = np.ascontiguousarray(rows.T)                 # positions x words
    prefix = np.zeros((size + 1, n), np.uint64)
    np.cumsum(X._BYTE_VALUE[rows] * X._power("up", size)[:, None], axis=0, out=prefix[1:])
    lengths = [k for k in vocab.lengths if k <= size]
    down = X._power("down", size + 1)
    floor = np.iinfo(np.int64).min // 4
    # gain[j][l]: score of the piece of length l that ends at j, or floor; where[j][l]: its key.
    gain = np.full((len(lengths), size + 1, n), floor)
    where = np.zeros((len(lengths), size + 1, n), np.int32)
    for row, k in enumerate(lengths):
        raw = (prefix[k:] - prefix[:-k]) * down[:size + 1 - k, None]
        key = X.mix(raw + np.array(k, np.uint64) * X._ODD)
        first = vocab.probe[key >> np.uint64(64 - PROBE_BITS)].ravel()
        maybe = np.flatnonzero(first >= 0)
        key, at = key.ravel()[maybe], first[maybe]
        for _ in range(vocab.crowd):        # successors among keys with the same leading bits
            hit = vocab.keys[at] == key
            gain[row, k:].reshape(-1)[maybe[hit]] = vocab.scores[at[hit]]
            where[row, k:].reshape(-1)[maybe[hit]] = at[hit]
            maybe, key, at = maybe[~hit], key[~hit], np.minimum(at[~hit] + 1, len(vocab.keys) - 1)
    best = np.full((size + 1, n), floor)
    best[0] = 0
    took = np.zeros((size + 1, n), np.int32)        # index into lengths, -1: a byte piece
    byte = int(BYTE_SCORE * SCALE)
    steps = np.array(lengths)
    for j in range(1, size + 1):
        usable = int(np.searchsorted(steps, j, "right"))
        top, which = best[j - 1] + byte, np.full(n, -1, np.int32)
        if usable:
            total = best[j - steps[:usable]] + gain[:usable, j]
            # The longest piece wins a tie: look from the longest to the shortest.
            longest = usable - 1 - np.argmax(total[::-1], axis=0)
            value = np.take_along_axis(total, longest[None], 0)[0]
            better = value >= top
            top, which = np.where(better, value, top), np.where(better, longest, which).astype(np.int32)
        best[j], took[j] = top, which
    at = np.full(n, size)
    live = np.arange(n)
    out_row, out_at, out_id = [], [], []
    while len(live):
        j = at[live]
        which = took[j, live]
        piece = which >= 0
        step = np.where(piece, steps[np.maximum(which, 0)], 1) if len(steps) else np.ones(len(live), np.int64)
        ids = vocab.byte_ids[rows[j - 1, live]]
        ids[piece] = vocab.ids[where[which[piece], j[piece], live[piece]]]
        out_row.append(live)
        out_at.append(j - step)
        out_id.append(ids)
        at[live] = j - step
        live = live[at[live] > 0]
    return np.concatenate(out_row), np.concatenate(out_at), np.concatenate(out_id)


class Encoder:
    """Encodes buffers and remembers the paths of the words it has solved."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)        # sorted word hashes
        self.slot = np.zeros(0, np.int64)          # their rows in edges
        self.ids, self.edges = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, names)
        at = np.minimum(at, max(len(self.known) - 1, 0))
        return at, (self.known[at] == names) if len(self.known) else np.zeros(len(names), bool)

    def encode(self, buf: X.Buffer) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): the ids of text i are ids[edges[i]:edges[i + 1]]."""
        escaped = escape(buf)
        words = split_at_marks(escaped)
        if not words.n:
            return np.zeros(0, np.int32), np.zeros(buf.n + 1, np.int64)
        names, at, inverse = np.unique(X.word_hashes(escaped, words), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        new = ~self._find(names)[1]
        ids, edges = best_paths(escaped, words.start[at[new]], words.end[at[new]], self.vocab)
        known = np.concatenate((self.known, names[new]))
        slot = np.concatenate((self.slot, np.arange(new.sum()) + len(self.edges) - 1))
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]
        self.edges = np.concatenate((self.edges, edges[1:] + self.edges[-1]))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        row = self.slot[self._find(names)[0]][inverse]
        count = self.edges[row + 1] - self.edges[row]
        word_edge = np.concatenate(([0], np.cumsum(count)))
        take = np.arange(word_edge[-1]) + np.repeat(self.edges[row] - word_edge[:-1], count)
        return self.ids[take], word_edge[words.first]


def decode_buffer(ids: np.ndarray, edges: np.ndarray, vocab: Vocabulary) -> X.Buffer:
    """Texts of runs of ids; the leading space of each is dropped."""
    width = np.diff(vocab.edges)[ids]
    at = np.concatenate(([0], np.cumsum(width)))
    take = np.arange(at[-1]) + np.repeat(vocab.edges[:-1][ids] - at[:-1], width)
    data, offsets = vocab.surface[take], at[edges]
    keep = np.ones(len(data), bool)
    lead = offsets[:-1][np.diff(offsets) > 0]
    lead = lead[data[lead] == 0x20]
    keep[lead] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return X.Buffer(data[keep], kept[offsets])


def _list_array(ids: np.ndarray, edges: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))


def string_array(buf: X.Buffer, null: np.ndarray) -> pa.Array:
    plain = pa.StringArray.from_buffers(buf.n, pa.py_buffer(buf.offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf.data)))
    return pa.compute.if_else(pa.array(~null), plain, pa.nulls(buf.n, pa.string()))


def _encode(model: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(model)
        encoder = Encoder(vocab)
        for rows, buf in X.chunks(batches):
            ids, edges = encoder.encode(buf)
            null = rows.column("text").is_null().to_numpy(zero_copy_only=False)
            back = decode_buffer(ids, edges, vocab)
            same = np.diff(back.offsets) == np.diff(buf.offsets)
            if np.array_equal(back.offsets, buf.offsets):
                wrong = np.concatenate(([0], np.cumsum(back.data != buf.data)))
                same &= np.diff(wrong[buf.offsets]) == 0
            else:       # compare one by one only if some text came back changed
                same = np.array([np.array_equal(back.data[back.offsets[i]:back.offsets[i + 1]],
                                                buf.data[buf.offsets[i]:buf.offsets[i + 1]]) for i in range(buf.n)])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in keep), _list_array(ids, edges, null),
                 pa.array(np.diff(edges).astype(np.int64)), pa.array(same)],
                names=[*keep, "piece_ids", "n_pieces", "round_trip"])
    return run


ENCODED = "piece_ids array<int>, n_pieces long, round_trip boolean"


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, piece_ids, n_pieces, round_trip`` of every row.

    ``round_trip`` says that decoding the ids gave the text back, byte for byte.
    """
    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(_encode(model or default_model(), ["doc_id"]), f"doc_id long, {ENCODED}"))


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(model)
        for rows in batches:
            lists = rows.column("piece_ids")
            null = lists.is_null().to_numpy(zero_copy_only=False)
            count = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            buf = decode_buffer(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                np.concatenate(([0], np.cumsum(count))), vocab)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), string_array(buf, null)], names=["doc_id", "text"])
    return run


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, piece_ids`` (null ids give a null text)."""
    return (encoded.select(F.col("doc_id").cast("long"), F.col("piece_ids").cast("array<int>"))
            .mapInArrow(_decode(model or default_model()), "doc_id long, text string"))
