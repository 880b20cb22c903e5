"""Merkle manifest against a plain tree built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm_fixtures import frame, odd_rows, words  # noqa: F401
from stratus.llm import merkle, ranks

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, slot long, block string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, run):
    """(root, siblings per leaf as (before, after) per level)."""
    level, owner, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(proofs):
            at = owner[i]
            lo = at - at % run
            p.append(("".join(level[lo:at]), "".join(level[at + 1:lo + run])))
        level = [H("".join(level[i:i + run])) for i in range(0, len(level), run)]
        owner = [o // run for o in owner]
    return level[0], proofs


def brute(rows, run):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], H("".join(field(v) for v in r[:5]))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], run) for g in order}
    root, above = tree([trees[g][0] for g in order], run)
    out = []
    for k, g in enumerate(order):
        for (i, h), p in zip(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[g][1]):
            path = p + above[k]
            out.append((i, h, trees[g][0], root, H("".join(a + b for a, b in path)), path))
    return out


def rows_of(n, lang=lambda i: "abc"[i % 3]):
    return [(i, "s", lang(i), i, f"t{i}", "x", 7, "b") for i in range(n)]


def null_first(r):
    return tuple((v is not None, "" if v is None else str(v)) for v in r)


@pytest.mark.parametrize(("run", "levels"), [(2, 2), (3, 1), (2, 8)])
def test_manifest_equals_a_tree_in_memory(frame, odd_rows, run, levels):  # noqa: F811
    odd = [(i, None if k % 4 else "ü", [None, "", "é", "a"][k % 4], None if k % 5 == 0 else k, t, "x", k, "b")
           for k, (i, t) in enumerate(odd_rows)]
    rows = rows_of(37, lambda i: "a" if i % 3 else "b") + [(500 + i, *odd[0][1:]) for i in range(9)] + odd
    got = merkle.verified(merkle.document_manifest(frame(rows, SCHEMA), run=run, levels=levels))
    found = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got.withColumn("proof", merkle.proof(F.col("path"))).collect()]
    assert sorted(found, key=null_first) == sorted((r[:5] for r in brute(rows, run)), key=null_first)
    assert got.where("NOT verified").count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 16, 17])
def test_sizes_around_blocks(frame, n):  # noqa: F811
    rows = rows_of(n, lambda i: None)
    got = merkle.document_manifest(frame(rows, SCHEMA), run=2, levels=2).withColumn("proof", merkle.proof(F.col("path")))
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got.collect()) == sorted(r[:5] for r in brute(rows, 2))


def test_changed_copies_fail_and_only_they(frame):  # noqa: F811
    rows = rows_of(60)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    copy = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.verified(merkle.document_manifest(frame(rows, SCHEMA), copy, levels=3)).collect()
    bad = {r.doc_id for r in got if not r.verified}
    assert bad == {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0} and bad
    paths = {r[0]: r[5] for r in brute(rows, 2)}
    for r in got:
        if r.doc_id in bad:
            i = r.doc_id
            node = H("".join(map(field, (i, "s", "abc"[i % 3], i + 1, f"t{i}"))))
            for before, after in paths[i]:
                node = H(before + node + after)
            assert r.folded_root == node != r.root


def test_empty_table(frame):  # noqa: F811
    assert merkle.verified(merkle.document_manifest(frame([], SCHEMA))).count() == 0


def test_equal_rows_get_positions_of_their_own(frame):  # noqa: F811
    rows = [(1, "a")] * 50 + [(None, "a")] * 7 + [(i, None) for i in range(20)]
    got = ranks.with_positions(frame(rows), ["text"], ["doc_id"], "t").collect()
    assert sorted(r.slot for r in got if r.text == "a") == list(range(57)) and {r.group_rows for r in got if r.text == "a"} == {57}
    assert sorted(r.slot for r in got if r.text == "a" and r.doc_id is None) == list(range(7))
    assert [r.doc_id for r in sorted((r for r in got if r.text is None), key=lambda r: r.slot)] == list(range(20))


def test_no_task_takes_a_whole_group(spark, frame):  # noqa: F811
    """Windows are partitioned by (group, block) in every level; no row number over a group."""
    nodes = frame([(i, "h") for i in range(9)]).selectExpr("text AS lang", "doc_id AS slot", "9L AS group_rows", "text AS hash")
    plan = merkle._climb(nodes, ["lang"], 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(lang") == 1 and "block" in plan.split("Exchange hashpartitioning(")[1][:40]
