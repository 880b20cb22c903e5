"""Substring dedup by recompression: every word of a long repeat beyond its first document goes.

Parsing.  A document's words are renamed in rounds: runs of one name become one
name, and adjacent names of opposite random classes become a pair.  A new name is
the 64-bit hash of what it stands for, so equal runs and pairs get equal names in
every document without a dictionary round trip.  Each name carries its context,
the words that decided it; equal text over that context gives the equal name,
whatever surrounds it.

Revealing.  In each window of ``window`` words the highest name whose context lies
inside, the leftmost of them, is the window's anchor (a plain word if nothing
higher fits).  Equal windows have equal anchors, so a window that repeats has an
anchor that another document has too.  Documents have one anchor per ten words or
so; those are what is shuffled.

Verifying.  Only windows with shared anchors are hashed whole and compared, so the
result is exact up to 64-bit hashes, with no cap on repeats, documents or lengths.

Whole copies are settled first by a hash of all words: every copy but the smallest
id loses all its windows, and only that one takes part in the rest.

Defined results: null and empty texts have no words; texts shorter than a window
stay whole; rows without an id are neither originals nor cut; repeated rows (equal
ids) do not cut each other and are all returned; what is found for an id with
several texts applies to each as far as it reaches; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm import text as X
from stratus.session import materialize

WINDOW = 50
#: Rounds of pairing, and the rounds before which runs are named.
ROUNDS = 9
RUN_ROUNDS = (0, 3)


class Level:
    """Names of one round with the words they cover ([.., ..)) and their contexts."""

    def __init__(self, name, edge, lo, hi):
        self.name, self.edge = name, edge      # edge: a document border, never merged
        self.lo, self.hi = lo, hi              # context, both nondecreasing

    def runs(self) -> "Level":
        same = (self.name[1:] == self.name[:-1]) & ~self.edge[1:] & ~self.edge[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        last = np.append(first[1:], len(self.name)) - 1
        count = last - first + 1
        name = self.name[first]
        name = np.where(count > 1, X.mix(name + count.astype(np.uint64) * X._ODD), name)
        # Where a run ends is only known from what stands next to it.
        lo = self.lo[np.maximum(first - 1, 0)]
        hi = self.hi[np.minimum(last + 1, len(self.hi) - 1)]
        edge = self.edge[first]
        return Level(name, edge, np.where(edge, self.lo[first], lo), np.where(edge, self.hi[first], hi))

    def pairs(self, round_: int) -> "Level":
        side = (X.mix(self.name ^ np.uint64(round_ + 1)) >> np.uint64(63)).astype(bool)
        opens, closes = ~side & ~self.edge, side & ~self.edge
        joined = opens[:-1] & closes[1:]
        left = np.append(joined, False)
        right = np.concatenate(([False], joined))
        # An opening name looks to its right for a partner, a closing one to its left.
        lo, hi = self.lo.copy(), self.hi.copy()
        alone = np.flatnonzero(opens & ~left)
        hi[alone] = self.hi[np.minimum(alone + 1, len(hi) - 1)]
        alone = np.flatnonzero(closes & ~right)
        lo[alone] = self.lo[np.maximum(alone - 1, 0)]
        at = np.flatnonzero(left)
        name = self.name.copy()
        name[at] = X.mix(self.name[at] * np.uint64(3) + self.name[at + 1] + X.mix(np.full(1, round_, np.uint64)))
        hi[at] = self.hi[at + 1]
        keep = ~right
        return Level(name[keep], self.edge[keep], lo[keep], hi[keep])


def anchors(names: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, start word) of each window of the documents, in order.

    An anchor is the hash of its context's words and of its round.
    """
    start = X.ngram_starts(first, window)
    if not len(start):
        return np.zeros(0, np.uint64), start
    n_docs = len(first) - 1
    # One border name before each document and one at the end.
    shift = np.repeat(np.arange(n_docs) + 1, np.diff(first))
    total = len(names) + n_docs + 1
    at = np.arange(len(names)) + shift
    name = X.mix(np.arange(total, dtype=np.uint64) ^ X._ODD)
    name[at] = names
    edge = np.ones(total, bool)
    edge[at] = False
    prefix = X.prefix_sums(name)
    place = np.arange(total)
    levels = [Level(name, edge, place, place + 1)]
    for r in range(ROUNDS):
        level = levels[-1]
        levels.append((level.runs() if r in RUN_ROUNDS else level).pairs(r))
    todo, open_ = np.arange(len(start)), at[start]
    anchor = np.zeros(len(start), np.uint64)
    for r in range(ROUNDS, -1, -1):
        level = levels.pop()
        i = np.searchsorted(level.lo, open_)
        i = np.minimum(i, len(level.lo) - 1)
        fits = (level.lo[i] >= open_) & (level.hi[i] <= open_ + window)
        i = i[fits]
        anchor[todo[fits]] = X.span_hash(prefix, level.lo[i], level.hi[i]) ^ X.mix(np.full(1, r, np.uint64))
        todo, open_ = todo[~fits], open_[~fits]
        if not len(todo):
            break
    return anchor, start


def _names(buf: X.Buffer) -> tuple[X.Words, np.ndarray]:
    words = X.split_words(buf)
    return words, X.word_hashes(buf, words)


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf in X.chunks(batches):
            words, names = _names(buf)
            anchor, start = anchors(names, words.first, window)
            doc = words.doc()[start]
            salt = X.mix(np.arange(buf.n, dtype=np.uint64))
            _, at = np.unique(anchor ^ salt[doc], return_index=True)      # distinct per document
            at.sort()
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(buf.n + 1)), pa.int32()),
                                             pa.array(X.signed(anchor[at])))
            whole = [X.span_hash(X.prefix_sums(names ^ np.uint64(s)), words.first[:-1], words.first[1:]) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(words.counts().astype(np.int64)), pa.array(X.signed(whole[0])),
                 pa.array(X.signed(whole[1])), lists], names=["doc_id", "n_words", "whole_a", "whole_b", "anchors"])
    return run


_BLANK = bytes([0x20, *range(0x09, 0x0E)])
_TO_SPACE = bytes.maketrans(_BLANK, b" " * len(_BLANK))


def kept_text(buf: X.Buffer, doc: int, gone: np.ndarray | None = None) -> bytes:
    """The words of one document that stay (all by default), joined by single spaces."""
    raw = buf.data[buf.offsets[doc]:buf.offsets[doc + 1]].tobytes()
    words = [w for w in raw.translate(_TO_SPACE).split(b" ") if w]
    return b" ".join(words if gone is None else [w for w, out in zip(words, gone) if not out])


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf in X.chunks(batches):
            words, names = _names(buf)
            anchor, start = anchors(names, words.first, window)
            prefix = X.prefix_sums(names)
            edge = np.searchsorted(start, words.first)
            shared = rows.column("shared")
            hits = [start[edge[i]:edge[i + 1]][np.isin(anchor[edge[i]:edge[i + 1]], X.unsigned(shared[i].values.to_numpy()))]
                    for i in range(buf.n)]
            sizes = np.concatenate(([0], np.cumsum([len(h) for h in hits])))
            hit = np.concatenate(hits)
            offsets = pa.array(sizes, pa.int32())
            base = np.repeat(words.first[:-1], np.diff(sizes))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array((hit - base).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(X.signed(X.span_hash(prefix, hit, hit + window))))],
                names=["doc_id", "starts", "hashes"])
    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf in X.chunks(batches):
            counts = X.split_words(buf).counts()
            copy = rows.column("is_copy").to_numpy(zero_copy_only=False) & (counts >= window)
            gone = rows.column("gone")
            removed, kept = np.where(copy, counts, 0).astype(np.int64), []
            for i in range(buf.n):
                if copy[i]:
                    kept.append(b"")
                elif gone[i].is_valid:
                    at = gone[i].values.to_numpy()
                    out = X.spread(at[at + window <= counts[i]], window, counts[i])
                    removed[i] = out.sum()
                    kept.append(kept_text(buf, i, out))
                else:
                    kept.append(kept_text(buf, i))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(removed),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def repeats_removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller id; windows are judged on the input.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    parsed = materialize(docs.where(F.col("doc_id").isNotNull()).mapInArrow(
        _parse(window), "doc_id long, n_words long, whole_a long, whole_b long, anchors array<long>")
        .where(F.col("n_words") >= window), "parsed")
    whole = ["n_words", "whole_a", "whole_b"]
    least = materialize(parsed.groupBy(*whole).agg(F.min("doc_id").alias("original")), "originals")
    originals = least.select(F.col("original").alias("doc_id")).distinct()
    # An id with several texts may be an original and a copy: its windows are then judged one by one.
    copies = materialize(parsed.select("doc_id", *whole).join(least, whole).where("doc_id != original")
                         .select("doc_id").join(originals, "doc_id", "left_anti").distinct(), "copies")
    held = materialize(parsed.select("doc_id", "anchors").join(originals, "doc_id", "left_semi")
                       .select("doc_id", F.explode("anchors").alias("anchor")), "anchors")
    shared = materialize(held.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                         .where("lo != hi").select("anchor"), "shared-anchors")
    mine = materialize(held.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared")),
                       "to-judge")
    windows = materialize(docs.join(mine, "doc_id").mapInArrow(
        _windows(window), "doc_id long, starts array<int>, hashes array<long>"), "windows")
    each = windows.select("doc_id", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select(
        "doc_id", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    owner = materialize(each.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                        .where("lo != hi").select("hash", "lo"), "window-owners")
    gone = each.join(owner, "hash").where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("start").alias("gone"))
    cuts = materialize(gone.withColumn("is_copy", F.lit(False)).unionByName(copies.select(
        "doc_id", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("is_copy"))), "cuts")
    return (docs.join(cuts, "doc_id", "left").withColumn("is_copy", F.coalesce("is_copy", F.lit(False)))
            .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string"))
