"""Merkle manifest of a data set: leaf hashes, a tree per group, inclusion proofs.

A leaf hashes a row's fields.  Within a group leaves stand in order, and per level every
``run`` consecutive nodes become the hash of their concatenation until one is left, the
group's subroot; the subroots, in order of their groups, give the root the same way.

Levels are lag and lead windows.  A node of level l stands in the row of its first leaf,
so on that level neighbours are ``run**l`` rows apart: fixed-offset lag and lead columns,
masked by the slot's place in its run and by the run's length, are the siblings, and rows
that are first in their run hash the parent.  Down again, a row takes the path of its
parent's row by a lag of the same offsets.

No window spans a group.  Slots are gapless (:mod:`stratus.llm.ranks`), so a group is cut
into blocks of ``run**levels`` slots, whose inner levels need nothing outside.  Block roots
are the rows of the next tier, a ``run**levels``-th of the rows; paths come back by a join
on (group, block), which has that many rows a key.

Defined results: nulls hash as ``-``, so they differ from empty strings; null groups are a
group of their own, which comes first; a null id stands first in its group; rows with one
id stand by leaf, and fully equal rows have equal leaves and a proof each; a single leaf
is its group's subroot, a single subroot the root, both with no siblings; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratus.llm.ranks import join_null_safe, with_positions
from stratus.session import materialize

RUN = 2
#: Levels inside a block: 256 slots for runs of two.
LEVELS = 8


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(f) for f in fields]))


def _climb(nodes: DataFrame, group: list[str], run: int, levels: int) -> DataFrame:
    """One tier: (group, slot, group_rows, hash, ...) with ``block``, ``path`` and ``top``.

    ``path`` lists what stands before and after the node on each level inside the block;
    ``top`` is the block's root, in the row of its first slot.
    """
    w = Window.partitionBy(*group, "block").orderBy("slot")
    rows = nodes.withColumn("block", F.expr(f"slot div {run ** levels}")).withColumn("top", F.col("hash"))

    def masks(level: int) -> tuple[Column, Column, Column]:
        step = run ** level
        place = F.expr(f"slot div {step}") % run
        return F.col("slot") % step == 0, place, F.col("group_rows") > step

    for level in range(levels):
        node, place, several = masks(level)
        step = run ** level
        before = [F.when(node & (place >= d), F.lag("top", d * step).over(w)) for d in range(run - 1, 0, -1)]
        after = [F.when(node & (place + d < run), F.lead("top", d * step).over(w)) for d in range(1, run)]
        rows = rows.withColumns({"_before": F.concat_ws("", *before), "_after": F.concat_ws("", *after)})
        first = F.col("slot") % (step * run) == 0
        rows = rows.withColumns({
            f"_level{level}": F.when(node & several, F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))),
            "top": F.when(first & several, digest(F.concat("top", "_after"))).when(first, F.col("top"))}).drop("_before", "_after")
    none = F.array().cast("array<struct<before:string,after:string>>")
    rows = rows.withColumn("path", F.when(F.col("slot") % (run ** levels) == 0, none))
    for level in reversed(range(levels)):
        _, place, several = masks(level)
        step = run ** level
        above = F.col("path")
        for d in range(1, run):
            above = F.when(place == d, F.lag("path", d * step).over(w)).otherwise(above)
        rows = rows.withColumn("path", F.when(F.col("slot") % step == 0, F.concat(
            F.when(several, F.array(f"_level{level}")).otherwise(none), above)))
    return rows.drop(*[f"_level{level}" for level in range(levels)])


def _forest(nodes: DataFrame, group: list[str], run: int, levels: int, name: str) -> list[DataFrame]:
    """Tiers from the leaves up; in the last one every group has one block."""
    tiers = []
    width = run ** levels
    while True:
        tier = materialize(_climb(nodes, group, run, levels), f"{name}-tier")
        tiers.append(tier)
        if (tier.agg(F.max("group_rows")).first()[0] or 0) <= width:
            return tiers
        nodes = tier.where(F.col("slot") % width == 0).select(
            *group, F.col("block").alias("slot"), F.expr(f"(group_rows + {width - 1}) div {width}").alias("group_rows"),
            F.col("top").alias("hash"))


def manifest(leaves: DataFrame, group: str, order: list[str], run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (with column ``leaf``) with ``slot``, ``path``, ``subroot`` and ``root``.

    ``path`` holds, level by level up to the root, the concatenated hashes of the run's
    nodes before and after the node; :func:`fold` recomputes the root from it.  ``leaves``
    must not hold the columns hash, top, block, slot, path, subroot, root or group_rows.
    """
    placed = with_positions(leaves, [group], [*order, "leaf"], "merkle").withColumn("hash", F.col("leaf"))
    tiers = _forest(placed, [group], run, levels, "merkle")
    subroots = tiers[-1].where("slot = 0").select(group, F.col("top").alias("leaf"))
    over = with_positions(subroots.withColumn("_all", F.lit(0)), ["_all"], [group], "subroots").withColumn("hash", F.col("leaf"))
    upper = _forest(over, ["_all"], run, levels, "subroots")
    root = upper[-1].where("slot = 0").select("_all", F.lit(0).cast("long").alias("block"),
                                              F.col("top").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("rest"))
    for tier in reversed(upper):
        root = _down(tier, root, ["_all"], ["root"])
    found = root.select(group, F.lit(0).cast("long").alias("block"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("rest"))
    for tier in reversed(tiers):
        found = _down(tier, found, [group], ["subroot", "root"])
    return found.drop("block", "rest", "hash", "group_rows", "top")


def _down(tier: DataFrame, above: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """The tier's rows with whole paths.  ``above`` has a row per (group, block): carried
    columns and the rest of the path; the result has them by (group, slot as next block)."""
    joined = join_null_safe(tier, above.select(*group, "block", *carried, "rest"), [*group, "block"])
    whole = joined.withColumn("path", F.concat("path", "rest")).withColumn("rest", F.col("path"))
    return whole.withColumn("block", F.col("slot"))


def proof(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda e: F.concat(e["before"], e["after"]))))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, e: digest(F.concat(e["before"], node, e["after"])))


def document_manifest(docs: DataFrame, presented: dict[str, Column] | None = None, run: int = RUN,
                      levels: int = LEVELS) -> DataFrame:
    """``doc_id, lang, leaf, presented, slot, path, subroot, root`` of a table of documents.

    ``presented`` gives the fields (of doc_id, source, lang, n_chars, text) that a later copy of
    the rows shows instead; the column of that name is the leaf of the copy.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    shown = {n: F.col(n) for n in names} | (presented or {})
    leaves = docs.select("doc_id", "lang", leaf([F.col(n) for n in names]).alias("leaf"),
                         leaf([shown[n] for n in names]).alias("presented"))
    return manifest(leaves, "lang", ["doc_id"], run, levels)


def verified(found: DataFrame) -> DataFrame:
    """A manifest with ``folded_root`` of the presented leaves and whether it is the root."""
    folded = found.withColumn("folded_root", fold(F.col("presented"), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
