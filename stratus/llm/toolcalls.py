"""Tool calls in chat transcripts: link, order, validate, serialise.

Messages carry calls (an id, a tool name, JSON arguments, ids of calls whose results
they use) and results (the id they answer).  Calls and results meet in a hash join on
(conversation, id).  Calls are ordered so that each comes after those it uses:

1. A call's effective place is the latest place among itself and all it uses,
   directly or not; places spread along uses until none changes.  In a transcript
   whose uses point backwards nothing changes and one look settles it.
2. Calls that end up at one place are ordered by their depth there.  A call whose
   depth passes the number of calls at its place lies on or behind a cycle; it is
   marked and keeps its own place among its peers.

Arguments are parsed once and validated against the tool's schema (required fields,
types, enumerations, unknown fields); the call is written as canonical JSON: keys
sorted, no blanks, non-ASCII kept, numbers as parsed.

A conversation may hold a third of all turns: no step gathers a conversation, each
output row is one call or result, and order is a sort key, not a list.

Defined results: duplicate call ids: the first by place is the call, later ones get
status ``duplicate``; results: the first one answers, later ones ``repeated``; a
result without a call is ``orphan``, a call without result ``open``; null ids link
with nothing; arguments that are missing, don't parse, hold a number beyond a double or a
lone surrogate, or are nested deeper than the parser goes give an error and null JSON; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.session import materialize

TYPES = {"string": str, "boolean": bool, "integer": int, "number": (int, float), "array": list, "object": dict, "null": type(None)}


def argument_errors(value, schema: dict) -> list[str]:
    """What is wrong with parsed arguments under an object schema; sorted."""
    if not isinstance(value, dict):
        return ["arguments: not an object"]
    known, errors = schema.get("properties", {}), []
    errors += [f"{name}: missing" for name in schema.get("required", []) if name not in value]
    for name, item in value.items():
        rule = known.get(name)
        if rule is None:
            if not schema.get("additionalProperties", True):
                errors.append(f"{name}: unknown")
            continue
        kind = TYPES[rule["type"]]
        if not isinstance(item, kind) or (isinstance(item, bool) and rule["type"] in ("integer", "number")):
            errors.append(f"{name}: not {rule['type']}")
            continue
        if "enum" in rule and item not in rule["enum"]:
            errors.append(f"{name}: not allowed")
        if "minLength" in rule and len(item) < rule["minLength"]:
            errors.append(f"{name}: too short")
        if "minimum" in rule and item < rule["minimum"]:
            errors.append(f"{name}: too small")
    return sorted(errors)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _strict(constant: str):
    raise ValueError(constant)


def _finite(digits: str) -> float:
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError(digits)
    return value


def judge(tool: str | None, raw: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str]]:
    """(canonical arguments, errors) of one call."""
    if tool not in schemas:
        errors = ["tool: unknown"]
    else:
        errors = []
    if raw is None:
        return None, errors + ["arguments: missing"]
    try:
        value = json.loads(raw, parse_constant=_strict, parse_float=_finite)
        text = canonical(value)
        text.encode()       # a lone surrogate is no character and can't be written
    except RecursionError:
        return None, errors + ["arguments: nested too deeply"]
    except ValueError:
        return None, errors + ["arguments: not JSON"]
    return text, errors + (argument_errors(value, schemas[tool]) if tool in schemas else [])


def _validate(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = [judge(t, a, schemas) for t, a in zip(rows.column("tool").to_pylist(), rows.column("arguments").to_pylist())]
            keep = [c for c in rows.schema.names if c != "arguments"]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.list_(pa.string()))], names=[*keep, "canonical", "errors"])
    return run


def _settle(calls: DataFrame, uses: DataFrame, start: str, step) -> DataFrame:
    """Repeat ``value = max(value, step(value of what is used))`` along uses until nothing changes.

    ``calls`` has (conv_id, call_id, start, ...); ``uses`` (conv_id, call_id, used_id).  Each
    round is written; only rows whose value changed send it on in the next.
    """
    value = materialize(calls.withColumn("value", F.col(start)), "settled")
    moved = value
    while True:
        told = (uses.join(moved.select("conv_id", F.col("call_id").alias("used_id"), F.col("value").alias("v")), ["conv_id", "used_id"])
                .groupBy("conv_id", "call_id").agg(F.max("v").alias("v")))
        after = materialize(value.join(told, ["conv_id", "call_id"], "left")
                            .withColumn("next", F.greatest("value", F.coalesce(step(F.col("v")), F.col("value")))), "settled")
        changed = after.where("next > value")
        value = after.drop("v", "value").withColumnRenamed("next", "value")
        if changed.isEmpty():
            return value
        moved = changed.drop("v", "value").withColumnRenamed("next", "value")


def ordered_calls(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, place) with ``place_after``, ``depth`` and ``cyclic``."""
    keys = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("used_id"))
    uses = materialize(uses.select("conv_id", "call_id", "used_id").distinct().join(known, ["conv_id", "used_id"]), "uses")
    placed = _settle(calls.select(*keys, "place"), uses, "place", lambda v: v).withColumnRenamed("value", "place_after")
    # Only uses between calls of one place still need an order.
    there = placed.select(*keys, "place_after")
    inner = (uses.join(there, keys).join(
        there.select("conv_id", F.col("call_id").alias("used_id"), F.col("place_after").alias("used_after")), ["conv_id", "used_id"])
        .where("place_after = used_after").select("conv_id", "call_id", "used_id"))
    inner = materialize(inner, "uses-at-place")
    touched = inner.select(*keys).unionByName(inner.select("conv_id", F.col("used_id").alias("call_id"))).distinct()
    crowd = materialize(there.join(touched, keys).withColumn("zero", F.lit(0).cast("long")), "calls-at-place")
    size = crowd.groupBy("conv_id", "place_after").agg(F.count(F.lit(1)).alias("crowd"))
    crowd = materialize(crowd.join(size, ["conv_id", "place_after"]), "calls-at-place")
    limit = crowd.select(*keys, "crowd")
    # Depths stop one past the number of calls, which only a cycle reaches.
    bounded = inner.join(limit, keys)
    depth = _depths(crowd, bounded)
    out = calls.join(placed.drop("place"), keys).join(depth, keys, "left")
    return (out.withColumn("cyclic", F.coalesce(F.col("depth") >= F.col("crowd"), F.lit(False)))
            .withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))).drop("crowd"))


def _depths(crowd: DataFrame, inner: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, crowd): the longest chain of uses below each call, at most ``crowd``."""
    keys = ["conv_id", "call_id"]
    value = materialize(crowd.select(*keys, "crowd", F.col("zero").alias("depth")), "depths")
    moved = value
    while True:
        told = (inner.join(moved.select("conv_id", F.col("call_id").alias("used_id"), F.col("depth").alias("d")), ["conv_id", "used_id"])
                .groupBy(*keys).agg(F.max("d").alias("d")))
        after = materialize(value.join(told, keys, "left").withColumn(
            "next", F.least("crowd", F.greatest("depth", F.coalesce(F.col("d") + 1, F.col("depth"))))), "depths")
        value = after.select(*keys, "crowd", F.col("next").alias("depth"))
        changed = after.where("next > depth")
        if changed.isEmpty():
            return value
        moved = changed.select(*keys, F.col("next").alias("depth"))


def link_tool_calls(calls: DataFrame, uses: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and result, with its link, order, verdict and canonical JSON.

    ``calls``: conv_id, call_id, place, tool, arguments.  ``uses``: conv_id, call_id, used_id.
    ``results``: conv_id, call_id, place, content.  Sort by (conv_id, place_after, depth,
    place, kind, call_id) to read a conversation in order.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "call_id", "place", "tool", "arguments")
    results = results.select("conv_id", "call_id", "place", "content")
    linkable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def ranked(rows: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
        """(the first row of each id, the rest): an aggregate, so a hot id is combined first."""
        body = [c for c in rows.columns if c not in keys]
        first = rows.where(linkable).groupBy(*keys).agg(
            F.min(F.struct(*body)).alias("f"), F.count(F.lit(1)).alias("n")).select(*keys, "f.*", "n")
        first = materialize(first, what)
        again = rows.where(linkable).join(first.where("n > 1").select(*keys, *(F.col(c).alias(f"f_{c}") for c in body)), keys)
        same = None
        for c in body:
            equal = F.col(c).eqNullSafe(F.col(f"f_{c}"))
            same = equal if same is None else same & equal
        # Of rows equal to the first, one is the first and the others are repeats of it.
        others = again.where(~same).select(*keys, *body)
        twins = (again.where(same).groupBy(*keys, *body).agg(F.count(F.lit(1)).alias("n"))
                 .where("n > 1").select(*keys, *body, F.explode(F.sequence(F.lit(2).cast("long"), "n"))).drop("col"))
        return first.drop("n"), others.unionByName(twins).unionByName(rows.where(~linkable).select(*keys, *body))

    call, more_calls = ranked(calls, "first-calls")
    result, more_results = ranked(results, "first-results")
    order = ordered_calls(call.select(*keys, "place"), uses.where(linkable & F.col("used_id").isNotNull()))
    checked = call.mapInArrow(
        _validate(schemas), "conv_id long, call_id string, place long, tool string, canonical string, errors array<string>")
    answer = result.select(*keys, "content", F.col("place").alias("answered_at"))
    linked = (checked.drop("place").join(order, keys).join(answer, keys, "left")
              .withColumn("status", F.when(F.col("cyclic"), "cyclic").when(F.col("answered_at").isNull(), "open").otherwise("linked")))
    called = call.select(*keys, F.lit(True).alias("has_call"))
    orphans = result.join(called, keys, "left_anti")

    def loose(rows: DataFrame, kind: str, status: str) -> DataFrame:
        return rows.select(*keys, "place", F.lit(kind).alias("kind"), F.lit(status).alias("status"),
                           F.col("place").alias("place_after"), F.lit(0).cast("long").alias("depth"),
                           F.lit(None).cast("string").alias("tool"), F.lit(False).alias("valid"),
                           F.array().cast("array<string>").alias("errors"), F.lit(None).cast("long").alias("answered_at"),
                           F.lit(None).cast("string").alias("message"))

    message = F.concat(F.lit('{"arguments":'), "canonical", F.lit(',"id":'), _json_string("call_id"), F.lit(',"name":'),
                       _json_string("tool"), F.lit(',"result":'),
                       F.when(F.col("content").isNull(), "null").otherwise(_json_string("content")), F.lit("}"))
    main = linked.select(*keys, "place", F.lit("call").alias("kind"), "status", "place_after", "depth", "tool",
                         (F.size("errors") == 0).alias("valid"), "errors", "answered_at", message.alias("message"))
    return (main.unionByName(loose(more_calls, "call", "duplicate")).unionByName(loose(orphans, "result", "orphan"))
            .unionByName(loose(more_results, "result", "repeated")))


def _json_string(column: str):
    """A JSON string literal: a one-field object without its braces and key."""
    return F.expr(f"regexp_extract(to_json(named_struct('x', {column}), map('ignoreNullFields', 'false')), '(?s)^.\"x\":(.*).$', 1)")


# Calls that the conversation table implies --------------------------------------

SCHEMAS = {
    "reply": {"required": ["prompt", "turn"], "additionalProperties": False,
              "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0},
                             "history": {"type": "array"}}},
    "configure": {"required": ["instructions"], "additionalProperties": False,
                  "properties": {"instructions": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
}


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, uses, results) that a table (conv_id, turn, role, text) implies.

    A user turn calls ``reply`` with its text and turn, a system turn ``configure``; the
    assistant turn after a user turn is that call's result.  A reply uses the configuration
    at turn 0 and the call two turns earlier, when there are such calls.
    """
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    name = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    asked = turns.where(F.col("role").isin("user", "system"))
    body = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt"))))
    body = body.otherwise(F.to_json(F.struct(F.col("text").alias("instructions"), F.col("turn").alias("turn"))))
    calls = asked.select("conv_id", name.alias("call_id"), F.col("turn").alias("place"),
                         F.when(F.col("role") == "user", "reply").otherwise("configure").alias("tool"), body.alias("arguments"))
    user = turns.where((F.col("role") == "user") & (F.col("turn") > 0))
    uses = user.select("conv_id", name.alias("call_id"), F.explode(F.array(
        F.lit("call_0"), F.when(F.col("turn") >= 2, F.concat(F.lit("call_"), (F.col("turn") - 2).cast("string"))))).alias("used_id"))
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("turn").alias("place"), F.col("text").alias("content"))
    return calls, uses, results
