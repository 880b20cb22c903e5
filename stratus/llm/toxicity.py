"""Toxicity: averaged subword embeddings under a linear softmax, trained in NumPy.

A word is the bag of its byte n-grams (word edges marked) and of itself; their
embeddings are averaged into a word vector, word vectors into the vector of a
passage of ``PASSAGE`` consecutive words, and a linear softmax gives its two
class scores.  Embeddings and softmax are trained jointly.  Misspellings share
most n-grams with the word they distort, so they score like it unseen.

A document is as toxic as its worst passage: a mean over thousands of words
would hide one insult.  Training gives every passage its document's label: harmless
words then pull both ways and cancel, telling ones do not.  The last step maps
worst-passage scores to probabilities by logistic regression, with the classes
weighted as they occur among all labels.

The model is linear after the embedding, so at scoring time every n-gram has one
fixed-point number; a task looks the numbers up for its distinct words and takes
integer sums, hence equal texts get equal scores wherever they are scored.

Training reads a bounded sample of labelled rows: ``TRAIN_ROWS`` documents, half of each
class, lowest id hashes first, and of these at most ``TRAIN_BYTES`` of passages, half of
each class, whole passages by the hash of their place (all of them below the bound; never
one above ``PASSAGE_BYTES``).  Tasks turn texts into numbers: the driver gets word names
per passage and bucket numbers per distinct word, not texts.  Scoring reads whole texts of
all rows, has no shuffle and keeps a fixed-size table.

Defined results: null and empty texts have no passage and score as a passage
whose words are all unknown; null ids and repeated rows give one row each; an
empty table gives none; without both classes in training nothing can be told apart
and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratus.llm import text as X
from stratus.session import materialize

TRAIN_ROWS = 4000
#: Bytes of words that training takes.  The driver holds up to twelve times as much (an int32 per n-gram).
TRAIN_BYTES = 16 << 20
PASSAGE_BYTES = 1 << 16
#: Word n-grams whose embeddings the driver sums at once.
STEP = 1 << 20
BINS = 1024
FOLDS = 5
BUCKETS = 1 << 17
DIM = 4
PASSAGE = 16
NGRAMS = (3, 4, 5)
EPOCHS = 80
RATE = 0.3
SCALE = 1 << 20
#: Embedding entries whose gradient is about as large as the TOP-th largest move at full rate.
TOP = 1500
#: Bytes that end a word: everything but ASCII letters, digits and non-ASCII.
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def fold(column: str = "doc_id"):
    """crc32 of the id as text, mod ``FOLDS``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


@dataclass
class Model:
    """Per-bucket fixed-point contributions, and the map from scores to probabilities."""
    weight: np.ndarray
    slope: float
    offset: float


def subwords(buf: X.Buffer, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, edges): those of word i are buckets[edges[i]:edges[i + 1]]."""
    length = end - start + 2
    edge = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(edge[-1]) - np.repeat(edge[:-1], length) - 1 + np.repeat(start, length)
    data = buf.data[np.clip(at, 0, max(len(buf.data) - 1, 0))] if len(start) else np.zeros(0, np.uint8)
    data[edge[:-1]], data[edge[1:] - 1] = ord("<"), ord(">")
    values = X._BYTE_VALUE[data]
    prefix = X.prefix_sums(values)
    owner = [np.arange(len(start))]
    found = [X.span_hash(prefix, edge[:-1], edge[1:]) ^ np.uint64(1)]
    for n in NGRAMS:
        at = X.ngram_starts(edge, n)
        owner.append(np.searchsorted(edge, at, "right") - 1)
        found.append(X.span_hash(prefix, at, at + n))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(start))
    return ((np.concatenate(found)[order] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), \
        np.concatenate(([0], np.cumsum(counts)))


def distinct_words(buf: X.Buffer, words: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each distinct word, the distinct word of each occurrence)."""
    _, at, inverse = np.unique(X.word_hashes(buf, words), return_index=True, return_inverse=True)
    return at, inverse


def passages(words: X.Words, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, document of each passage): runs of ``size`` words."""
    counts = words.counts()
    per_doc = -(-counts // size)
    base = np.cumsum(per_doc) - per_doc
    inside = np.arange(words.n) - np.repeat(words.first[:-1], counts)
    return np.repeat(base, counts) + inside // size, np.repeat(np.arange(len(counts)), per_doc)


def _worst(logit: np.ndarray, doc: np.ndarray, n: int, empty: float) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, doc, logit)
    return np.where(np.isinf(out), empty, out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(x, -40, 40))))


@dataclass
class Sample:
    """Training passages as numbers; word i has the buckets bucket[edge[i]:edge[i + 1]]."""
    toxic: np.ndarray          # per document
    doc: np.ndarray            # document of each passage
    token: np.ndarray          # word of each occurrence
    first: np.ndarray          # occurrences of passage i: first[i]:first[i + 1]
    bucket: np.ndarray
    edge: np.ndarray


def _word_sums(sample: Sample, entries: np.ndarray) -> np.ndarray:
    """Sum of ``entries`` (per bucket) over the buckets of each word, a step at a time."""
    out = np.empty(len(sample.edge) - 1)
    for lo, hi in _steps(sample.edge):
        part = slice(sample.edge[lo], sample.edge[hi])
        out[lo:hi] = np.add.reduceat(entries[sample.bucket[part]], sample.edge[lo:hi] - sample.edge[lo])
    return out


def _bucket_sums(sample: Sample, per_word: np.ndarray, buckets: int) -> np.ndarray:
    """The transpose: every bucket's sum of ``per_word`` over the words that have it."""
    out = np.zeros(buckets)
    for lo, hi in _steps(sample.edge):
        part = slice(sample.edge[lo], sample.edge[hi])
        out += np.bincount(sample.bucket[part], np.repeat(per_word[lo:hi], np.diff(sample.edge[lo:hi + 1])), buckets)
    return out


def _steps(edge: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words with about ``STEP`` buckets."""
    lo, n = 0, len(edge) - 1
    while lo < n:
        hi = max(int(np.searchsorted(edge, edge[lo] + STEP, "right")) - 1, lo + 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def fit(sample: Sample, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE,
        share_toxic: float | None = None, seed: int = 7) -> Model:
    """Train embeddings and softmax jointly (full-batch Adam) on labelled passages."""
    toxic, doc, token, first = sample.toxic, sample.doc, sample.token, sample.first
    base = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < base < 1:
        return Model(np.zeros(buckets, np.int64), 0.0, -np.inf)
    share = 1.0 / np.diff(sample.edge)
    n, n_words = len(doc), len(sample.edge) - 1
    size = np.diff(first)
    rng = np.random.default_rng(seed)
    params = {"emb": rng.normal(0, 0.1, (dim, buckets)), "out": rng.normal(0, 0.3, (2, dim)), "bias": np.zeros(2)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}

    def forward():
        word = np.stack([_word_sums(sample, e) * share for e in params["emb"]])
        mean = np.stack([np.add.reduceat(w[token], first[:-1]) / size if n else np.zeros(0) for w in word])
        return mean, params["out"] @ mean + params["bias"][:, None]

    positive, step = toxic[doc].astype(bool), 0
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    for _ in range(epochs):
        mean, scores = forward()
        error = (_sigmoid(scores[1] - scores[0]) - positive) * weight
        grad_scores = np.stack((-error, error))
        grad_mean = params["out"].T @ grad_scores
        grads = {"out": grad_scores @ mean.T, "bias": grad_scores.sum(1)}
        grads["emb"] = np.stack([_bucket_sums(sample, np.bincount(token, np.repeat(g / size, size), n_words) * share, buckets)
                                 for g in grad_mean])
        step += 1
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            # One step size for most n-grams: a frequent telling one moves far in a
            # round, one seen once hardly moves (per-entry scaling would memorise it).
            scale = np.sqrt(v / (1 - 0.99 ** step))
            scale = np.maximum(scale, np.partition(scale.ravel(), -TOP)[-TOP]) if k == "emb" else scale
            params[k] -= rate * (m / (1 - 0.9 ** step)) / (scale + 1e-12)
    _, scores = forward()
    weight = np.rint((params["out"][1] - params["out"][0]) @ params["emb"] * SCALE).astype(np.int64)
    worst = _worst(scores[1] - scores[0] - (params["bias"][1] - params["bias"][0]), doc, len(toxic), 0.0)
    slope, offset = _logistic(worst, toxic, base if share_toxic is None else share_toxic)
    return Model(weight, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3) -> tuple[float, float]:
    """One-variable logistic regression by Newton steps; ``share`` is the weight of class 1."""
    spread = max(float(x.std()), 1e-9)
    centre = float(np.median(x))
    z = np.stack((np.clip((x - centre) / spread, -8, 8), np.ones_like(x)))
    weight = np.where(y, share / max(y.sum(), 1), (1 - share) / max((y == 0).sum(), 1))
    coef = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(coef @ z)
        grad = z @ ((p - y) * weight) + ridge * coef
        hess = (z * (p * (1 - p) * weight)) @ z.T + ridge * np.eye(2)
        coef -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(coef[0] / spread), float(coef[1] - coef[0] * centre / spread)


def usable(labels: DataFrame) -> DataFrame:
    """One label per document outside the held-out fold (toxic if any row says so)."""
    return (labels.where(F.col("toxic").isin(0, 1) & (fold() != 0))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic``: at most ``rows`` labelled documents outside the held-out fold."""
    marked = usable(labels)
    picked = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
              for c in (0, 1)]
    # Broadcast: ``rows`` ids at most.
    return (docs.select("doc_id", "text").join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id"))


def _training_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> a row per passage: its words' names.  A document without words has one empty row."""
    for rows, buf in X.chunks(batches):
        buf = buf.lower_ascii()
        words = X.split_words(buf, BREAK)
        passage, doc = passages(words)
        first = np.concatenate(([0], np.cumsum(np.bincount(passage, minlength=len(doc)))))
        size = X.per_doc_sum(words.end - words.start, first)
        bare = np.setdiff1d(np.arange(buf.n), doc)
        doc = np.concatenate((doc, bare))
        place = np.concatenate((np.arange(len(size)), -np.ones(len(bare), np.int64)))
        edges = np.concatenate((first, np.full(len(bare), words.n)))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.array(place),
             pa.array(np.concatenate((size, np.zeros(len(bare), np.int64)))),
             pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(X.signed(X.word_hashes(buf, words)))).cast(pa.list_(pa.int64()))],
            names=["doc_id", "toxic", "place", "bytes", "words"])


def _training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> the name and the buckets of each distinct word."""
    for _, buf in X.chunks(batches):
        buf = buf.lower_ascii()
        words = X.split_words(buf, BREAK)
        short = words.end - words.start <= PASSAGE_BYTES
        words = X.Words(words.start[short], words.end[short], np.array([0, short.sum()]))
        names, at = np.unique(X.word_hashes(buf, words), return_index=True)
        bucket, edge = subwords(buf, words.start[at], words.end[at], BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(X.signed(names)), pa.LargeListArray.from_arrays(pa.array(edge, pa.int64()), pa.array(bucket.astype(np.int32))).cast(
                pa.list_(pa.int32()))], names=["word", "buckets"])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Sample:
    """The labelled sample as numbers, at most ``max_bytes`` of words."""
    picked = materialize(training_rows(docs, labels, rows).groupBy("doc_id")         # repeated rows train once
                         .agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")
    found = materialize(picked.select(F.col("doc_id").cast("long"), F.col("toxic").cast("long"), "text").mapInArrow(
        _training_passages, "doc_id long, toxic long, place long, bytes long, words array<long>")
        .withColumn("bin", F.pmod(F.xxhash64("doc_id", "place"), F.lit(BINS))).where(F.col("bytes") <= PASSAGE_BYTES), "toxicity-passages")
    # At most BINS rows of each class: how far the bound reaches in the order of the bins.
    sizes = np.zeros((2, BINS), np.int64)
    for r in found.groupBy("toxic", "bin").agg(F.sum("bytes").alias("n")).collect():
        sizes[r.toxic, r.bin] = r.n
    reach = [int(np.searchsorted(np.cumsum(s), max_bytes // 2, "right")) for s in sizes]
    chosen = found.where(F.col("bin") < F.when(F.col("toxic") == 1, reach[1]).otherwise(reach[0]))
    needed = chosen.select(F.explode("words").alias("word")).distinct()
    known = (picked.select("text").mapInArrow(_training_words, "word long, buckets array<int>")
             .groupBy("word").agg(F.first("buckets").alias("buckets")).join(needed, "word", "left_semi"))
    passage = chosen.select("doc_id", "toxic", "place", "words").toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("place", "ascending")])
    words = known.toArrow().combine_chunks().sort_by("word")
    ids, at, doc = np.unique(passage.column("doc_id").to_numpy(), return_index=True, return_inverse=True)
    toxic = passage.column("toxic").to_numpy()[at] if len(ids) else np.zeros(0, np.int64)
    counts = pc.list_value_length(passage.column("words")).to_numpy().astype(np.int64)
    token = np.searchsorted(words.column("word").to_numpy(), pc.list_flatten(passage.column("words")).to_numpy()).astype(np.int32)
    edge = np.concatenate(([0], np.cumsum(pc.list_value_length(words.column("buckets")).to_numpy().astype(np.int64))))
    return Sample(toxic, doc[counts > 0], token, np.concatenate(([0], np.cumsum(counts[counts > 0]))),
                  pc.list_flatten(words.column("buckets")).to_numpy(), edge)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    share = usable(labels).agg(F.avg("toxic")).first()[0]
    return fit(training_sample(docs, labels, rows, max_bytes), share_toxic=share)


def score_buffer(buf: X.Buffer, model: Model) -> np.ndarray:
    """Probability that each document is toxic."""
    buf = buf.lower_ascii()
    words = X.split_words(buf, BREAK)
    at, token = distinct_words(buf, words)
    bucket, edge = subwords(buf, words.start[at], words.end[at], len(model.weight))
    word = X.per_doc_sum(model.weight[bucket], edge) // np.maximum(np.diff(edge), 1)
    passage, doc = passages(words)
    first = np.concatenate(([0], np.cumsum(np.bincount(passage, minlength=len(doc)))))
    mean = X.per_doc_sum(word[token], first) / np.maximum(np.diff(first), 1) / SCALE
    return _sigmoid(model.slope * _worst(mean, doc, buf.n, 0.0) + model.offset)


def _score(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf in X.chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(score_buffer(buf, model))],
                names=[*keep, "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = train(docs, labels, rows)
    scored = (docs.select(F.col("doc_id").cast("long"), "text")
              .mapInArrow(_score(model, ["doc_id"]), "doc_id long, score double"))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below 0.5."""
    model = train(docs, labels, rows)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text_at = inner[names.index("text")]
    plain = docs.toDF(*inner).withColumnRenamed(text_at, "text")
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    scored = plain.mapInArrow(_score(model, plain.columns), schema)
    return scored.where(F.col("score") < 0.5).drop("score").toDF(*names)
