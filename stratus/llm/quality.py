"""Quality rules: hashed n-gram likelihood ratio of trusted text against the raw corpus.

Word unigrams and bigrams are hashed into a fixed number of buckets.  One pass
counts the buckets over the whole corpus (raw) and over trusted documents
(target); tasks send their bucket totals, never rows of text.  A second pass
scores every document by its mean log ratio per n-gram, together with plain
rules on symbols, repeated lines and repeated phrases.  The cut-off is the
trusted documents' own low quantile, read off a histogram of fixed bins over all
labelled documents, so equal inputs give equal verdicts.

Defined results: a null or empty text has no words and fails the base rules;
null ids and repeated rows are scored like any other row (one output row each);
an empty table gives no rows; without trusted documents the ratio is 0 for all
and only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm import text as X
from stratus.session import materialize

BUCKETS = 1 << 16
#: Trusted rows from which the target multinomial is learned (lowest id hashes first).
TARGET_ROWS = 20_000
#: Share of trusted documents that may fall below the cut-off.
TRUSTED_LOSS = 0.002
#: Share of the raw multinomial mixed into the target's: no ratio is below log(MIXED).
MIXED = 0.05
#: Ratios are integers in units of 1 / SCALE, so sums do not depend on their order.
SCALE = 1 << 16
BIN = 0.005
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _grams(names: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs, and where each pair starts."""
    pairs, start = X.ngram_hashes(names, first, 2)
    size = np.uint64(buckets)
    return np.concatenate((names % size, pairs % size)).astype(np.int64), start


def _count_buckets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for rows, buf in X.chunks(batches):
            buf = buf.lower_ascii()
            words = X.split_words(buf)
            grams, start = _grams(X.word_hashes(buf, words), words.first, buckets)
            trusted = np.asarray(rows.column("trusted").to_numpy(zero_copy_only=False), bool)
            doc = words.doc()
            of = np.concatenate((trusted[doc], trusted[doc[start]]))
            raw += np.bincount(grams, minlength=buckets)
            target += np.bincount(grams[of], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                         names=["bucket", "raw", "target"])
    return run


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` ids that the labels mark as good, in the order of their hash."""
    return (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
            .select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
               target_rows: int = TARGET_ROWS) -> np.ndarray:
    """The table of fixed-point log ratios, one per bucket (bounded by ``buckets``)."""
    trusted = trusted_ids(labels, target_rows).withColumn("trusted", F.lit(True))
    counted = (docs.select("doc_id", "text")
               .join(F.broadcast(trusted), "doc_id", "left")        # at most target_rows ids
               .select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
               .mapInArrow(_count_buckets(buckets), "bucket long, raw long, target long")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    got = counted.toPandas()
    ratio = np.zeros(buckets)
    if got.target.sum():
        raw, target = got.raw.to_numpy() / got.raw.sum(), got.target.to_numpy() / got.target.sum()
        ratio[got.bucket] = np.log((1 - MIXED) * target / raw + MIXED)
    return np.rint(ratio * SCALE).astype(np.int64)


def text_measures(buf: X.Buffer, words: X.Words) -> dict[str, np.ndarray]:
    """Per document: words, their code points, symbols, repeated lines and words."""
    names = X.word_hashes(buf, words)
    points = np.concatenate(([0], np.cumsum((buf.data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[buf.data])))
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    lines = X.split_words(buf, newline)
    filled = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    doc = lines.doc()[filled]
    salt = X.mix(np.arange(buf.n, dtype=np.uint64))
    key = X.byte_span_hashes(buf, lines.start[filled], lines.end[filled]) ^ salt[doc]
    _, at = np.unique(key, return_index=True)
    dup_lines = np.bincount(doc, minlength=buf.n) - np.bincount(doc[at], minlength=buf.n)
    grams, start = X.ngram_hashes(names, words.first, REPEAT_WINDOW)
    _, inverse, times = np.unique(grams ^ salt[words.doc()[start]], return_inverse=True, return_counts=True)
    repeated = X.spread(start[times[inverse] > 1], REPEAT_WINDOW, words.n)
    return {
        "n_words": words.counts(),
        "word_chars": X.per_doc_sum(points[words.end] - points[words.start], words.first),
        "n_symbols": symbols[buf.offsets[1:]] - symbols[buf.offsets[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": X.per_doc_sum(repeated, words.first),
    }


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _score(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf in X.chunks(batches):
            words = X.split_words(buf)
            got = text_measures(buf, words)
            low = buf.lower_ascii()
            names = X.word_hashes(low, words)
            grams, start = _grams(names, words.first, len(ratios))
            total = X.per_doc_sum(ratios[grams[:words.n]], words.first)
            pair_doc = words.doc()[start]
            pairs = np.bincount(pair_doc, minlength=buf.n)
            edge = np.concatenate(([0], np.cumsum(pairs)))
            total = total + X.per_doc_sum(ratios[grams[words.n:]], edge)
            mean = total / np.maximum(got["n_words"] + pairs, 1) / SCALE
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(got[m].astype(np.int64)) for m in MEASURES), pa.array(mean)],
                names=["doc_id", *MEASURES, "log_ratio"])
    return run


def cut_off(scored: DataFrame, labels: DataFrame, loss: float = TRUSTED_LOSS) -> float:
    """The lower edge of the bin that holds the trusted documents' ``loss`` quantile.

    The histogram has at most a few thousand bins of width ``BIN`` whatever the
    number of documents, and covers every trusted document that passes the base
    rules.
    """
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    bins = (scored.where(~F.col("base_failed")).join(good, "doc_id")
            .groupBy(F.floor(F.col("log_ratio") / BIN).alias("bin")).count().toPandas().sort_values("bin"))
    if bins.empty:
        return float("-inf")
    before = np.cumsum(bins["count"].to_numpy()) - bins["count"].to_numpy()
    allowed = loss * bins["count"].sum()
    return float(bins["bin"].to_numpy()[before <= allowed][-1] * BIN)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                  target_rows: int = TARGET_ROWS, loss: float = TRUSTED_LOSS) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``log_ratio``, ``cut_off`` and ``kept``."""
    ratios = log_ratios(docs, labels, buckets, target_rows)
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", log_ratio double"
    scored = (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(ratios), schema)
              .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))
    scored = materialize(scored, "quality")
    limit = cut_off(scored, labels, loss)
    return (scored.withColumn("cut_off", F.lit(limit))
            .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.col("cut_off"))))
