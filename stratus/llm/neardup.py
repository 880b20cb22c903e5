"""Near-duplicate components: one-permutation hashing, banded buckets, star-shaped candidates.

1. A document's distinct word shingles are hashed once; the hash names a bin and a
   value, each bin keeps its least value, and an empty bin borrows from a bin that
   its own fixed random walk reaches first (optimal densification).
2. Documents with equal shingle sets form a class; its smallest id represents it.
3. ``BANDS`` keys of so many bins that a pair at the threshold shares one with a
   chance of about a seventh are bucket keys; it shares none with a chance of 1e-5 to 3e-5.
4. Each bucket proposes stars: up to five centres, each paired with every member of
   another component.  A pair whose set sizes rule the similarity out is dropped, and
   so is one that differs in more of ``BITS`` sketch bits than a pair at the threshold
   does but for a chance of ``BIT_MISS``; bits and sizes travel with the bucket rows.
   The others are confirmed on full shingle sets, and links are contracted to
   components.  Centres are the member that meets most others over all its buckets
   (often the text that the others are copies of) and four of the bucket's smallest
   components.  A round never has more pairs than five times its bucket rows.
5. Then the centres leave their buckets (all they could link is settled).  In the first
   ``RARE_ROUNDS`` rounds the shingles of the documents whose buckets still span
   components are counted.  One that reaches the threshold with no other document of its
   buckets' sizes unless both share a shingle that at most ``RARE`` of them have is paired
   by those shingles and leaves too (a bound, no estimate): texts that met over a common
   passage, or far copies of a text with many copies.
6. What is left proposes stars until no bucket spans two components.  After ``STARS``
   rounds a key is extended by a band of bins that a pair at the threshold shares with a
   chance of a third, four ways and then eight ways (``STEPS``).

No step depends on the number of documents or pairs: a bucket is refined or dropped by
its own components alone.

Everything is keyed joins and aggregates over tables in the shared folder: hot
buckets and hot copies are skewed keys of plain joins (split by adaptive execution)
or are combined before the shuffle.  Nothing per document reaches the driver.

Defined results: null and empty texts have no shingles and link with nothing; a
text of fewer words than a shingle is one shingle; rows without an id link with
nothing (component null, kept); repeated rows are returned as often as they occur
and are kept like the first, as they carry the same id (an id with several texts
is confirmed by its greatest text); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm import text as X
from stratus.session import materialize

BANDS = 73
STARS = 8
RARE_ROUNDS = 2
RARE = 16
STEPS = ((1, 2, 4, 8), (16, 21, 27, 33, 39, 45, 50, 55))
BITS = 512
BIT_MISS = 1e-6
BLOCK = 2048


def rows_for(percent: int) -> int:
    """Bins of a band: a pair at ``percent`` similarity shares a band with a chance of about a third."""
    return max(1, round(math.log(1 / 3) / math.log(min(max(percent, 1), 99) / 100)))


def bins_for(percent: int) -> int:
    """Bins of a bucket key: a pair at ``percent`` similarity shares a key with a chance of about a seventh."""
    return max(1, round(math.log(1 / 7) / math.log(min(max(percent, 1), 99) / 100)))


def bits_for(percent: int, miss: float = BIT_MISS) -> int:
    """Most bits of ``BITS`` in which a pair at ``percent`` similarity differs but for a chance of ``miss``."""
    q, most, left = (1 - percent / 100) / 2, 0, 1.0
    while most < BITS:
        left -= math.comb(BITS, most) * q ** most * (1 - q) ** (BITS - most)
        if left <= miss:
            break
        most += 1
    return most


def shingle_sets(buf: X.Buffer, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the sorted distinct shingles of document i are hashes[edges[i]:edges[i + 1]]."""
    buf = buf.lower_ascii()
    words = X.split_words(buf)
    names = X.word_hashes(buf, words)
    hashes, start = X.ngram_hashes(names, words.first, n)
    doc = words.doc()[start] if len(start) else np.zeros(0, np.int64)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = X.span_hash(X.prefix_sums(names), words.first[short], words.first[short + 1])
    hashes, doc = np.concatenate((hashes, whole)), np.concatenate((doc, short))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=buf.n))))


def one_permutation(hashes: np.ndarray, edges: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation sketches, one row of ``bins`` values per set (empty sets: all ones)."""
    n = len(edges) - 1
    doc = np.repeat(np.arange(n), np.diff(edges))
    scrambled = X.mix(hashes)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    cell = doc * bins + (scrambled % np.uint64(bins)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], scrambled[order]
    sketch = np.full(n * bins, empty)
    if len(cell):
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sketch[cell[first]] = np.minimum.reduceat(value, first)
    sketch = sketch.reshape(n, bins)
    filled = sketch != empty
    row, col = np.nonzero(~filled & (np.diff(edges) > 0)[:, None])
    out, step = sketch.copy(), 0
    while len(row):        # the walk of a bin depends on the bin and the step alone
        step += 1
        walk = X.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(step << 40)) % np.uint64(bins)
        target = walk.astype(np.int64)[col]
        hit = filled[row, target]
        out[row[hit], col[hit]] = sketch[row[hit], target[hit]]
        row, col = row[~hit], col[~hit]
    return out


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of each of the first ``BITS`` bins, as words of 64 bits; unequal bins agree by half."""
    cells = np.arange(BITS, dtype=np.uint64) * X._ODD
    bits = (X.mix(sketch[:, :BITS] ^ cells) >> np.uint64(40)).astype(np.uint8) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def _band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each of ``BANDS`` bands of ``rows`` bins."""
    bands = sketch[:, :BANDS * rows].reshape(len(sketch), BANDS, rows)
    key = np.zeros((len(sketch), BANDS), np.uint64)
    for j in range(rows):
        key = X.mix(key + bands[:, :, j] + X._ODD)
    return X.mix(key + np.arange(BANDS, dtype=np.uint64))


def _sketch(shingle: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, buf in X.chunks(batches):
            hashes, edges = shingle_sets(buf, shingle)
            sums = [X.per_doc_sum_wrapping(X.mix(hashes ^ np.uint64(s)), edges) for s in (1, 2)]
            for lo in range(0, buf.n, BLOCK):        # short texts are many: sketches are larger than they
                cut = edges[lo:lo + BLOCK + 1]
                n = len(cut) - 1
                sketch = one_permutation(hashes[cut[0]:cut[-1]], cut - cut[0], max(BITS, BANDS * bins))

                def lists(values: np.ndarray) -> pa.Array:
                    at = np.arange(n + 1) * values.shape[1]
                    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [got.column("doc_id").slice(lo, n), got.column("mark").slice(lo, n), pa.array(np.diff(cut).astype(np.int64)),
                     *(pa.array(X.signed(x[lo:lo + n])) for x in sums), lists(X.signed(_band_keys(sketch, bins))),
                     lists(X.signed(_band_keys(sketch, rows))), lists(sketch_bits(sketch))],
                    names=["doc_id", "mark", "n_shingles", "set_a", "set_b", "keys", "bands", "bits"])
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, buf in X.chunks(batches):
            hashes, edges = shingle_sets(buf, shingle)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(X.signed(hashes)))
            yield pa.RecordBatch.from_arrays([got.column("doc_id"), lists], names=["doc_id", "shingles"])
    return run


def components(links: DataFrame) -> DataFrame:
    """``c, root`` for every component id ``c`` that a link ``(u, v)`` touches: the least id reachable.

    Rounds of hooking to the least neighbour and pointer jumping; each is written
    to the shared folder.  Ends when no label changes.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "links")
    label = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")), "labels")
    while True:
        near = (both.join(label.select(F.col("u").alias("v"), F.col("root").alias("other")), "v")
                .groupBy("u").agg(F.min("other").alias("other")))
        hooked = label.join(near, "u").select("u", "root", F.least("root", "other").alias("best"))
        # A root learns what its members found, then everyone jumps to its root's label.
        told = hooked.groupBy("root").agg(F.min("best").alias("told"))
        jumped = materialize(hooked.join(told, "root").select("u", F.col("root").alias("was"),
                                                              F.least("best", "told").alias("root")), "labels")
        jump = jumped.select(F.col("u").alias("root"), F.col("root").alias("next"))
        after = materialize(jumped.join(jump, "root", "left")
                            .select("u", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        if after.where("root != was").isEmpty():
            return after.select(F.col("u").alias("c"), "root")
        label = after.select("u", "root")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach the similarity."""
    # Late rounds have few pairs: only their ends' sets are shuffled.
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = sets.join(ends, "doc_id", "left_semi")
    members = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = members.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (both.select("a", "b", shared.alias("n"), (F.size("set_a") + F.size("set_b")).alias("m"))
            .where(100 * F.col("n") >= percent * (F.col("m") - F.col("n"))).select("a", "b"))


def _spanning(rows: DataFrame) -> DataFrame:
    """The rows of the buckets that have members of two components or more."""
    alive = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    return rows.join(alive, "key")


def classes_and_buckets(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) of every row; (rep, bands) of the texts that share a key; their bucket rows."""
    schema = "doc_id long, mark long, n_shingles long, set_a long, set_b long, keys array<long>, bands array<long>, bits array<long>"
    sketched = materialize(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
                           .mapInArrow(_sketch(shingle, bins_for(percent), rows_for(percent)), schema), "sketches")
    usable = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    name = ["n_shingles", "set_a", "set_b"]
    least = materialize(usable.groupBy(*name).agg(F.min("doc_id").alias("rep")), "classes")
    known = materialize(usable.select("doc_id", *name).join(least, name)
                        .select("doc_id", "n_shingles", "rep"), "class-members")
    rest = sketched.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    # The join has put rows of one id together; of several texts the one of the greatest hash stands for the id.
    reps = (usable.join(least.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
            .groupBy(F.col("doc_id").alias("rep"))
            .agg(F.max_by(F.struct(F.col("n_shingles").alias("n"), "keys", "bands", "bits"), F.struct("mark", "n_shingles", "set_a")).alias("r"))
            .select("rep", "r.*"))
    reps = materialize(reps, "representatives")
    keys = reps.select("rep", F.posexplode("keys").alias("at", "key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared-keys")
    rows = materialize(keys.join(shared, "key"), "shared-rows")
    nodes = materialize(reps.join(rows.groupBy("rep").agg(F.sum("m").alias("meets")), "rep").drop("keys"), "nodes")
    buckets = rows.drop("m").join(nodes.drop("bands"), "rep").withColumn("c", F.col("rep"))
    return known.unionByName(rest), nodes, materialize(buckets, "buckets")


def _centres(buckets: DataFrame) -> DataFrame:
    """(key, centre) of the buckets that span components: at most five centres a bucket."""
    card = F.struct("rep", "n", "bits", "meets")
    parts = (buckets.groupBy("key", "c")
             .agg(F.count(F.lit(1)).alias("m"), F.min_by(card, F.struct(-F.col("meets"), "rep")).alias("card")))
    one = F.struct("card.rep", "card.n", "card.bits", "c")
    orders = [F.struct(-F.col("card.meets"), F.col("card.rep")), *(F.struct("m", x) for x in (F.col("card.rep"), -F.col("card.rep"), F.xxhash64("card.rep"), -F.xxhash64("card.rep")))]
    return (parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.array_distinct(F.array(*(F.min_by(one, o) for o in orders))).alias("centres"))
            .where("k > 1").select("key", "centres"))


def _star_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a member and a centre of another component that sizes and bits do not rule out."""
    star = left.select("rep", "c", "n", "bits", F.explode("centres").alias("centre"))
    apart = F.lit(0)
    for i in range(BITS // 64):
        apart = apart + F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("centre.bits")[i]))
    alike = ((F.col("c") != F.col("centre.c")) & (100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
             & (apart <= bits_for(percent)))
    return star.where(alike).select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct()


def _refined(rest: DataFrame, nodes: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """Bucket rows under keys extended by the band keys ``steps`` further on."""
    ways = F.explode(F.array(*(F.lit(s) for s in steps))).alias("step")
    extended = rest.join(nodes.select("rep", "bands"), "rep").select("*", ways)
    other = F.element_at("bands", ((F.col("at") + F.col("step")) % BANDS + 1).cast("int"))
    return extended.withColumn("key", F.xxhash64("key", other)).drop("bands", "step")


def _by_rare_shingles(rest: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows): pairs by rare shingles of the documents that link by no others, and the rows of the rest.

    Two sets have at most the rare shingles that both hold and the lesser number of their
    common ones in common; sizes below are those of the bucket's least member.
    """
    lows = rest.groupBy("key").agg(F.min("n").alias("low"))
    docs = rest.join(lows, "key").groupBy("rep").agg(F.max("n").cast("long").alias("n"), F.min("low").cast("long").alias("low"))
    docs = materialize(docs, "spanning-documents")
    wanted = docs.select(F.col("rep").alias("doc_id"))
    shingles = materialize(sets.join(wanted, "doc_id", "left_semi")
                           .select(F.col("doc_id").alias("rep"), F.explode("shingles").alias("shingle")), "spanning-shingles")
    seen = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= RARE)
    rare = materialize(shingles.join(seen, "shingle"), "rare-shingles")
    docs = (docs.join(rare.groupBy("rep").agg(F.count(F.lit(1)).alias("rare")), "rep", "left")
            .withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0))))
    most = percent * (100 * F.col("n") + F.greatest(100 * F.col("low"), percent * F.col("n")))
    docs = materialize(docs.select("rep", "n", "common", (100 * (100 + percent) * F.col("common") < most).alias("leaves")), "rare-counts")
    ends = materialize(rare.where("m > 1").join(docs, "rep").drop("m"), "rare-ends")
    a, b = ends.where("leaves").alias("a"), ends.alias("b")
    met = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.rep") != F.col("b.rep"))
    once = ~F.col("b.leaves") | (F.col("a.rep") < F.col("b.rep"))
    alike = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    room = (100 + percent) * F.least("a.common", "b.common") - percent * (F.col("a.n") + F.col("b.n"))
    pairs = (a.join(b, met & once & alike)
             .select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"), room.alias("room"))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("room").alias("room"))
             .where((100 + percent) * F.col("shared") + F.col("room") >= 0).select("a", "b"))
    return pairs, rest.join(docs.where("leaves").select("rep"), "rep", "left_anti")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when their sets of ``shingle``-word shingles have at least
    ``percent`` / 100 of their union in common.
    """
    members, nodes, buckets = classes_and_buckets(docs, shingle, percent)
    wanted = nodes.select(F.col("rep").alias("doc_id"))
    # The join has put rows of one id together, so the aggregate needs no exchange.
    texts = (docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text")))
    sets = materialize(texts.mapInArrow(_sets(shingle), "doc_id long, shingles array<long>"), "shingle-sets")
    comp = nodes.select("rep", F.col("rep").alias("c"))
    tried, rounds, extra = None, 0, None
    while True:
        centres = materialize(_centres(buckets), "centres")
        if centres.isEmpty() and extra is None:
            break
        left = buckets.join(centres, "key")
        pairs = _star_pairs(left, percent)
        if extra is not None:
            pairs, extra = pairs.unionByName(extra).distinct(), None
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        rest = left.where(~F.exists("centres", lambda x: x["rep"] == F.col("rep"))).drop("centres")
        linked = materialize(confirm(pairs, sets, percent), "confirmed")
        if not linked.isEmpty():
            ends = (linked.join(comp.select(F.col("rep").alias("a"), F.col("c").alias("u")), "a")
                    .join(comp.select(F.col("rep").alias("b"), F.col("c").alias("v")), "b").where("u != v").select("u", "v"))
            roots = components(ends)
            comp = materialize(comp.join(roots, "c", "left").select("rep", F.coalesce("root", "c").alias("c")), "components")
            rest = rest.drop("c").join(comp, "rep")
        if rounds < RARE_ROUNDS:
            found, rest = _by_rare_shingles(materialize(_spanning(materialize(rest, "left")), "spanning"), sets, percent)
            found = materialize(found, "rare-pairs")
            extra = None if found.isEmpty() else found
        elif STARS <= rounds < STARS + len(STEPS):        # what no longer spans components is not refined
            rest = _refined(_spanning(rest), nodes, STEPS[rounds - STARS])
        buckets = materialize(_spanning(materialize(rest, "refined")), "buckets")
        rounds += 1
    out = members.join(comp, "rep", "left")
    component = F.coalesce("c", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest id (rows without words all stay).

    Rows that repeat an id are one document: the greatest row stays.
    """
    found = materialize(near_duplicates(docs.select("doc_id", "text"), shingle, percent), "near-duplicates")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    again = (found.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count()
             .where("count > 1").select(F.col("doc_id").alias("_id")))
    again = materialize(again, "repeated-ids")
    leave = materialize(gone.unionByName(again).distinct(), "not-kept")
    d, same = docs.alias("d"), F.col("d.doc_id") == F.col("e._id")
    rest = d.join(leave.alias("e"), same, "left_anti")
    order = ["text", *(c for c in docs.columns if c != "text")]
    one = (d.join(again.alias("e"), same, "left_semi").groupBy("doc_id")
           .agg(F.max(F.struct(*(F.col(f"`{c}`") for c in order))).alias("_row")).select("_row.*"))
    return rest.unionByName(one.select(*(F.col(f"`{c}`") for c in docs.columns)))
