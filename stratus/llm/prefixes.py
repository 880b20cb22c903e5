"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns; its name is (depth, two 64-bit words), the
words being the exclusive-or of position-dependent hashes of its turns.  Exclusive-or
splits anywhere, so a long conversation is cut into blocks: running words inside each
block, block totals in front.  A row also knows its parent's name: the words without its
own turn.  Equal names of different sequences have a chance of 2**-128 a pair.

Chains.  Nodes with one member set (equal smallest member and number of members) lie below
one another without a branch; they are one vertex of the trie that is totalled, and a
running sum of bytes along the smallest member gives each node its part of the chain.

Totals.  Chains are taken in reverse level order; a chain pops from a priority queue what
its children sent, closes its total and sends it on under its parent's place in that order.
The queue spills sorted runs to the shared folder.  A shard holds whole subtrees: the
maximal ones of at most ``members`` conversations, found by doubling parent pointers (at
most twice that many chains lie in one, so no key is hot).  What the shards' roots send is
summed by receiver and goes to the next tier, which does the same for subtrees of up to
``members ** 2`` conversations, and so on to the trie's root.  Chains of one member need
no queue: one leaf, nothing shared.

Joins to data that many rows refer to (a root's children) are salted: receivers are
replicated per (key, salt) in use.

Defined results: turns without a conversation are left out; null turns come first, rows of
one turn by the hash of their content, repeated rows are turns of their own; null roles
and texts are empty; an empty table has no nodes, not even a root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratus.llm.ranks import with_positions
from stratus.llm.stores import filesystem
from stratus.session import materialize, scratch_path

#: Turns of a conversation that one window takes, and ids that one piece of text holds.
BLOCK = 1024
PIECE = 512
#: Conversations of a shard's subtree in the first tier; the next tiers take powers of it.
MEMBERS = 1024
#: Messages that a queue holds before it spills.
QUEUE_ROWS = 200_000
NAME = ["depth", "x1", "x2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, slot, group_rows, a1, a2, bytes``: turns in order, as hashes of their content."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    small = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(F.lit(1), role, text).alias("a1"),
        F.xxhash64(F.lit(2), text, role).alias("a2"), F.octet_length(text).cast("long").alias("bytes"))
    return with_positions(small, ["conv_id"], ["turn", "a1", "a2"], "turns").drop("turn")


def rebuilt_turns(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each conversation took over a common start.

    Conversation c begins with the first crc32(c) % ``most`` turns of c - c % ``group`` and goes
    on with its own turns after as many.  Conversations: ``conv_id, length``; turns: ``conv_id,
    depth, a1, a2, bytes, length``.
    """
    own = materialize(numbered_turns(turns), "numbered-turns")
    convs = own.where("slot = 0").select("conv_id", F.col("group_rows").alias("n_own"))
    convs = convs.withColumn("taken", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most) \
                 .withColumn("donor", F.col("conv_id") - F.col("conv_id") % group)
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n_own").alias("n_donor"))
    convs = convs.join(donors, "donor", "left").withColumn("head", F.least("taken", F.coalesce("n_donor", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("head") + F.greatest(F.col("n_own") - F.col("taken"), F.lit(0))), "conversations")
    # A donor gives fewer than ``most`` turns to at most 2 * ``group`` conversations.
    given = own.where(F.col("slot") < most).select(F.col("conv_id").alias("donor"), "slot", "a1", "a2", "bytes")
    start = convs.join(given, "donor").where("slot < taken").select(
        "conv_id", (F.col("slot") + 1).alias("depth"), "a1", "a2", "bytes", "length")
    blocks = convs.select("conv_id", "taken", "head", "length",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_own - 1) div {BLOCK}"))).alias("block"))
    rest = (own.withColumn("block", F.expr(f"slot div {BLOCK}")).join(blocks, ["conv_id", "block"]).where("slot >= taken")
            .select("conv_id", (F.col("head") + F.col("slot") - F.col("taken") + 1).alias("depth"), "a1", "a2", "bytes", "length"))
    return convs.select("conv_id", "length"), start.unionByName(rest)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Each conversation's prefixes, the empty one included: names, parents' names, bytes so far."""
    rows = turns.select("*", F.xxhash64("depth", "a1").alias("l1"), F.xxhash64("a2", "depth").alias("l2"),
                        F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"x1": F.bit_xor("l1").over(inside), "x2": F.bit_xor("l2").over(inside),
                                "total": F.sum("bytes").over(inside)})
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    front = rows.groupBy("conv_id", "block").agg(F.bit_xor("l1").alias("b1"), F.bit_xor("l2").alias("b2"), F.sum("bytes").alias("bt"))
    zero = F.lit(0).cast("long")
    front = front.select("conv_id", "block", *[F.coalesce(f(c).over(earlier), zero).alias(f"f_{c}")
                                               for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bt"))])
    x1, x2 = F.col("x1").bitwiseXOR(F.col("f_b1")), F.col("x2").bitwiseXOR(F.col("f_b2"))
    whole = running.join(front, ["conv_id", "block"]).select(
        "conv_id", "depth", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("l1")).alias("p1"),
        x2.bitwiseXOR(F.col("l2")).alias("p2"), "bytes", (F.col("total") + F.col("f_bt")).alias("total"),
        (F.col("depth") == F.col("length")).alias("ends"))
    empty = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "x1", "x2", "p1", "p2", "bytes", "total")],
                         (F.col("length") == 0).alias("ends"))
    return whole.unionByName(empty)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix: smallest member ``conv_id``, members ``n_convs``, names, bytes."""
    return rows.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                   *[F.min(c).alias(c) for c in ("p1", "p2", "bytes", "total")])


def trie_chains(nodes: DataFrame, salts: int) -> DataFrame:
    """Maximal runs of nodes with one member set, and the chain they hang on."""
    up = F.min_by(F.struct("p1", "p2"), "depth")
    chains = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min(F.col("total") - F.col("bytes")).alias("before"),
        F.max("total").alias("after"), up.alias("up"))
    chains = chains.select("conv_id", "n_convs", "top", "bottom", "before", "after", "up.*",
                           (F.col("top") - 1).alias("above"), F.pmod(F.xxhash64("conv_id"), F.lit(salts)).alias("salt"))
    key = ["above", "p1", "p2", "salt"]
    asked = chains.where("top > 0").select(*key).distinct()
    known = asked.join(nodes.select(F.col("depth").alias("above"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                                    F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n")), key[:3])
    return chains.join(known, key, "left").drop(*key)


class SpillingQueue:
    """Priority queue of (place, place, three sums) that keeps at most ``limit`` messages in memory."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []        # (next message, run number, iterator, file)
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/{os.urandom(12).hex()}.arrow"
        ordered = sorted(self.heap)
        self.heap = []
        with fs.open_output_stream(path) as out:
            columns = [pa.array(c, pa.int64()) for c in zip(*ordered)]
            table = pa.table(columns, names=[f"c{i}" for i in range(len(columns))])
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table, max_chunksize=4096)
        self.spilled += 1
        self._next(self.spilled, self._read(fs, path))

    @staticmethod
    def _read(fs, path: str) -> Iterator[tuple]:
        with fs.open_input_stream(path) as source:
            for batch in pa.ipc.open_stream(source):
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
        fs.delete_file(path)

    def _next(self, number: int, run: Iterator[tuple]) -> None:
        message = next(run, None)
        if message is not None:
            heapq.heappush(self.runs, (message, number, run))

    def pop_at(self, place: tuple[int, int]) -> Iterator[tuple]:
        """Messages for ``place``, which must not lie before an earlier one."""
        while self.heap and self.heap[0][:2] == place:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:2] == place:
            message, number, run = heapq.heappop(self.runs)
            yield message
            self._next(number, run)

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


FORWARD = "conv_id long, n_convs long, leaves long, saved long, children long"


def _time_forward(folder: str, limit: int):
    """Rows of a shard in reverse level order -> their totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(folder, limit)
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                leaves, saved, children = r["leaves"], r["saved"], r["children"]
                for _, _, more_leaves, more_saved, more in queue.pop_at((-r["bottom"], r["conv_id"])):
                    leaves, saved, children = leaves + more_leaves, saved + more_saved, children + more
                leaves = leaves if children else 1
                saved += (r["n_convs"] - 1) * (r["after"] - r["before"])
                got.append((r["conv_id"], r["n_convs"], leaves, saved, children))
                if not r["is_root"]:
                    queue.push((1 - r["top"], r["up_conv"], leaves, saved, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)] if got else [pa.array([], pa.int64())] * 5,
                                             names=["conv_id", "n_convs", "leaves", "saved", "children"])
        if len(queue):
            raise RuntimeError("messages without a receiver: the shard does not hold whole subtrees")
    return run


def _shard_roots(chains: DataFrame, high: int) -> DataFrame:
    """``chains`` with the root of the maximal subtree of at most ``high`` members that holds each."""
    inside = F.coalesce(F.col("up_n") <= high, F.lit(False))
    rows = materialize(chains.withColumn("root_conv", F.when(inside, F.col("up_conv")).otherwise(F.col("conv_id")))
                       .withColumn("root_n", F.when(inside, F.col("up_n")).otherwise(F.col("n_convs"))), "roots")
    while True:
        far = rows.select(F.col("conv_id").alias("root_conv"), F.col("n_convs").alias("root_n"),
                          F.col("root_conv").alias("far_conv"), F.col("root_n").alias("far_n"))
        after = materialize(rows.join(far, ["root_conv", "root_n"]), "roots")
        moved = not after.where("far_n != root_n").isEmpty()
        rows = after.drop("root_conv", "root_n").withColumnsRenamed({"far_conv": "root_conv", "far_n": "root_n"})
        if not moved:
            return rows


def _sent(totals: DataFrame) -> DataFrame:
    """What chains send to parents outside their shard, summed by receiver."""
    return totals.where(F.col("up_conv").isNotNull()).groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("children"))


def chain_totals(chains: DataFrame, members: int = MEMBERS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``conv_id, n_convs, leaves, saved, children`` of each chain, its subtree included."""
    spark = chains.sparkSession
    spill = scratch_path(spark, "queue-runs")
    keys = ["conv_id", "n_convs"]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    single = chains.where("n_convs = 1").select(*keys, one.alias("leaves"), zero.alias("saved"), zero.alias("children"), "up_conv", "up_n")
    done, inbox = [single.drop("up_conv", "up_n")], materialize(_sent(single), "messages")
    largest = chains.agg(F.max("n_convs")).first()[0] or 1
    low, high = 1, members
    while low < largest:
        tier = _shard_roots(chains.where((F.col("n_convs") > low) & (F.col("n_convs") <= high)), high)
        is_root = (F.col("root_conv") == F.col("conv_id")) & (F.col("root_n") == F.col("n_convs"))
        fed = tier.join(inbox, keys, "left").fillna(0, ["leaves", "saved", "children"]).withColumn("is_root", is_root)
        ordered = fed.repartition("root_conv", "root_n").sortWithinPartitions(F.col("bottom").desc(), "conv_id")
        closed = materialize(ordered.mapInArrow(_time_forward(spill, queue_rows), FORWARD), "totals")
        done.append(closed)
        roots = tier.where(is_root).select(*keys, "up_conv", "up_n")
        inbox = materialize(inbox.unionByName(_sent(closed.join(roots, keys))).groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("leaves", "saved", "children")]), "messages")
        low, high = high, high * members
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, piece of text) sorted by node and piece -> the SHA-256 of each node's joined text."""
    node, state = None, None
    for batch in batches:
        got = []
        for depth, x1, x2, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if node != (depth, x1, x2):
                if node is not None:
                    got.append((*node, state.hexdigest()))
                node, state = (depth, x1, x2), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if got:
            yield _named(got)
    if node is not None:
        yield _named([(*node, state.hexdigest())])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    depth, x1, x2, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(x1, pa.int64()), pa.array(x2, pa.int64()),
                                       pa.array(text, pa.string())], names=[*NAME, "ends_sha256"])


def ending_members(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids, ascending and comma-joined, of the conversations that end at each node.

    Ids are joined in pieces of a bounded range first; one task then only streams a node's pieces.
    """
    pieces = rows.where("ends").groupBy(*NAME, F.expr(f"conv_id div {PIECE}").alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    return (pieces.repartition(*NAME).sortWithinPartitions(*NAME, "piece").select(*NAME, "text")
            .mapInArrow(_hash_pieces, "depth long, x1 long, x2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, rebuild: bool = True, members: int = MEMBERS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turn, role, text).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Without ``rebuild`` conversations are taken as they are.
    """
    spark = turns.sparkSession
    if rebuild:
        convs, steps = rebuilt_turns(turns)
    else:
        own = materialize(numbered_turns(turns), "numbered-turns")
        convs = own.where("slot = 0").select("conv_id", F.col("group_rows").alias("length"))
        steps = own.select("conv_id", (F.col("slot") + 1).alias("depth"), "a1", "a2", "bytes", F.col("group_rows").alias("length"))
    rows = materialize(prefixes(convs, steps), "prefixes")
    nodes = materialize(trie_nodes(rows), "trie-nodes")
    chains = materialize(trie_chains(nodes, _salts(spark)), "trie-chains")
    totals = chains.join(chain_totals(chains, members, queue_rows), ["conv_id", "n_convs"])
    # A chain is as long as its conversation: one row per block of depths, so that no key is hot.
    spread = totals.select("conv_id", "n_convs", "top", "bottom", "before", "up_conv", "leaves", "saved", "children",
                           F.explode(F.sequence(F.expr(f"top div {BLOCK}"), F.expr(f"bottom div {BLOCK}"))).alias("block"))
    found = nodes.withColumn("block", F.expr(f"depth div {BLOCK}")).join(spread, ["conv_id", "n_convs", "block"])
    passed = (F.col("n_convs") - 1) * (F.col("total") - F.col("bytes") - F.col("before"))
    return (found.join(ending_members(rows), NAME, "left")
            .select("conv_id", "depth",
                    F.when(F.col("depth") == F.col("top"), F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                    "n_convs", F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(F.lit(1)).alias("n_children"),
                    F.col("leaves").alias("n_leaves"), (F.col("saved") - passed).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def _salts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
