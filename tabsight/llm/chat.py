"""Chat formatting: tool calls linked with their results.

Calls and results are joined by identifier, calls are put in topological
order of their dependencies, arguments are checked against a schema, and
each linked call is written as one line of canonical JSON (sorted keys, no
spaces, UTF-8).  One row per call: a conversation of any length is never
gathered in one place; (conversation, level, turn) is the reading order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import shared_checkpoint

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
         "null": type(None)}


# ----------------------------------------------------------------- validation
def schema_errors(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` breaks of a JSON schema: type, enum, minimum, maximum,
    minLength, maxLength, required, properties, additionalProperties, items."""
    out: list[str] = []
    want = schema.get("type")
    if want:
        names = [want] if isinstance(want, str) else want
        if not any(isinstance(value, TYPES[t]) and (t in ("boolean",) or not isinstance(value, bool)) for t in names):
            return [f"{at}: not {' or '.join(names)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _serialiser(schemas: dict[str, dict]):
    @F.pandas_udf("valid boolean, errors array<string>, json string")
    def serialise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for calls in batches:
            rows = []
            for c in calls.itertuples(index=False):
                depends = [] if c.depends_on is None else sorted(d for d in c.depends_on if d is not None)
                try:
                    arguments = json.loads(c.arguments) if c.arguments is not None else None
                    errors = (schema_errors(arguments, schemas[c.name]) if c.name in schemas
                              else ["$: unknown function"])
                except ValueError:
                    arguments, errors = c.arguments, ["$: not JSON"]
                rows.append((not errors, errors, canonical({
                    "id": c.call_id, "name": c.name, "arguments": arguments, "depends_on": depends,
                    "result": c.result})))
            yield pd.DataFrame(rows, columns=["valid", "errors", "json"])
    return serialise


# ---------------------------------------------------------- topological order
def chains(single: DataFrame) -> DataFrame:
    """``single`` (call_id, dep_id): calls with one dependency -> (call_id,
    anchor, dist, open): the first call along the dependencies that is not of
    this kind, and the steps to it.  Pointers jump over pointers, so the
    rounds are the logarithm of the longest chain; ``open`` are calls on or
    behind a cycle of such calls, which have no anchor."""
    kind = single.select(F.col("call_id").alias("dep_id"), F.lit(True).alias("open"))
    state = shared_checkpoint(single.join(kind, "dep_id", "left").select(
        "call_id", F.col("dep_id").alias("anchor"), F.lit(1).alias("dist"), F.coalesce("open", F.lit(False)).alias("open")))
    rounds = state.where("open").count().bit_length()  # then any chain without a cycle has ended
    for _ in range(rounds):
        ahead = state.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("dist").alias("more"),
                             F.col("open").alias("still"))
        moved = state.where("open").join(ahead, "anchor").select(
            "call_id", F.col("next").alias("anchor"), (F.col("dist") + F.col("more")).alias("dist"), F.col("still").alias("open"))
        state = shared_checkpoint(state.where("NOT open").unionByName(moved))
        if state.where("open").isEmpty():
            break
    return state


def _branching(edges: DataFrame, settled: DataFrame, tidy: int = 16) -> DataFrame:
    """``edges`` (call_id, anchor, w) of calls with several dependencies and
    the ``settled`` (call_id, level) -> all settled calls: a call whose
    anchors are all settled has the highest level + w.  One round settles all
    calls whose last anchor was settled in the round before, so the rounds
    are as many as the longest chain of calls with several dependencies."""
    new, parts, best = settled, [settled], None
    while not edges.isEmpty():
        known = new.select(F.col("call_id").alias("anchor"), "level")
        met = edges.join(known, "anchor").groupBy("call_id").agg(F.max(F.col("level") + F.col("w")).alias("level"))
        best = shared_checkpoint(met if best is None else best.unionByName(met).groupBy("call_id").agg(F.max("level").alias("level")))
        edges = shared_checkpoint(edges.join(known, "anchor", "left_anti"))
        still = edges.select("call_id").distinct()
        new = shared_checkpoint(best.join(still, "call_id", "left_anti"))
        if new.isEmpty():
            break
        best = best.join(still, "call_id", "left_semi")
        parts.append(new)
        if len(parts) > tidy:
            parts = [shared_checkpoint(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 without dependencies, else one more than the
    highest dependency.  ``edges`` (call_id, dep_id) hold only dependencies
    that exist.  Calls on or behind a cycle get no row.

    Chains of calls with one dependency each are contracted first
    (``chains``); only calls with several dependencies are settled round by
    round (``_branching``)."""
    edges = shared_checkpoint(edges.distinct())
    fan = shared_checkpoint(edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("dep_id").alias("dep_id")))
    roots = shared_checkpoint(calls.select("call_id").distinct().join(fan, "call_id", "left_anti").withColumn("level", F.lit(0)))
    found = chains(fan.where("n = 1").select("call_id", "dep_id"))
    many = fan.where("n > 1").select("call_id")
    settled = roots
    if not many.isEmpty():
        links = found.select(F.col("call_id").alias("dep_id"), "anchor", "dist", "open")
        weighted = (edges.join(many, "call_id", "left_semi").join(links, "dep_id", "left")
                    # behind a cycle: an anchor that is never settled
                    .select("call_id", F.when(F.col("open"), F.lit(None)).otherwise(F.coalesce("anchor", "dep_id")).alias("anchor"),
                            (F.coalesce("dist", F.lit(0)) + 1).alias("w")))
        settled = shared_checkpoint(_branching(shared_checkpoint(weighted), roots))
    ends = settled.select(F.col("call_id").alias("anchor"), "level")
    along = found.where("NOT open").join(ends, "anchor").select("call_id", (F.col("level") + F.col("dist")).alias("level"))
    return settled.unionByName(along)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` (call_id, conv_id, turn, name, arguments, depends_on) and
    ``results`` (call_id, content) -> (conv_id, turn, call_id, name, level,
    linked, valid, errors, json), one row per call.

    Of several results of a call the smallest text counts; a result without a
    call is left out; a call without a result has ``linked`` false and a null
    result.  Dependencies that no call bears are kept in the JSON but do not
    delay a call; a call in or behind a cycle has a null level.  Rows that
    repeat a call id each get a row, with the level of the id (all their
    dependencies count).  A call without an id has no level and no result.
    Unknown functions, text that is not JSON and schema breaks are listed in
    ``errors``."""
    wanted = results.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min("content").alias("result"), F.lit(True).alias("answered"))
    calls = calls.select("call_id", "conv_id", "turn", "name", "arguments", "depends_on")
    named = calls.where("call_id IS NOT NULL")
    ids = named.select(F.col("call_id").alias("dep_id")).distinct()
    edges = (named.select("call_id", F.explode("depends_on").alias("dep_id"))
             .join(ids, "dep_id", "left_semi").select("call_id", "dep_id"))
    call = F.struct("call_id", "name", "arguments", "depends_on", "result")
    # a hash join by identifier on any size of table; of a hot identifier the
    # results are one row, and adaptive execution splits its calls
    return (calls.join(wanted.hint("shuffle_hash"), "call_id", "left").join(levels(edges, named), "call_id", "left")
            .withColumn("out", _serialiser(schemas)(call))
            .select("conv_id", "turn", "call_id", "name", "level",
                    F.coalesce("answered", F.lit(False)).alias("linked"), "out.valid", "out.errors", "out.json"))


# ------------------------------------------------------------- conversations
#: A user turn read as a call of the assistant.
REPLY = {"reply": {"type": "object", "required": ["prompt"], "additionalProperties": False,
                   "properties": {"prompt": {"type": "string", "minLength": 1},
                                  "system": {"type": "string"}}}}


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))


def _call_id(turn: Column) -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a table (conv_id, turn, role, text).

    A user turn calls ``reply`` with its text as prompt, and depends on the
    user turn two turns before it (if it is not one of the first two); the assistant turn that follows it is its
    result.  The identifier is ``conv_id:turn``.  A null text gives a null
    prompt; other roles make no call (``other_turns`` has them)."""
    c = _turns(conversations)
    calls = c.where("role = 'user'").select(
        _call_id(F.col("turn")).alias("call_id"), "conv_id", "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.array_compact(F.array(F.when(F.col("turn") >= 2, _call_id(F.col("turn") - 2)))).alias("depends_on"))
    results = c.where("role = 'assistant'").select(_call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that ``link_calls`` of ``conversation_calls`` has in no row,
    in its columns: turns that are neither the user's nor the assistant's (the
    system's prompts), assistant turns that follow no user turn, and those
    whose text is not the result that counts for their call.  One row per
    turn, with ``linked`` false, no call, and the role and text as JSON."""
    c = _turns(conversations).where("role IS NULL OR role <> 'user'")
    asked = _turns(conversations).where("role IN ('user', 'assistant')").select(
        _call_id(F.when(F.col("role") == "user", F.col("turn")).otherwise(F.col("turn") - 1)).alias("id"),
        (F.col("role") == "user").alias("is_call"), F.when(F.col("role") == "assistant", F.col("text")).alias("text"))
    calls = (asked.where("id IS NOT NULL").groupBy("id").agg(F.max("is_call").alias("is_call"), F.min("text").alias("result"))
             .where("is_call").select("id", "result"))
    replies = c.where("role = 'assistant'").withColumn("id", _call_id(F.col("turn") - 1)).join(calls.withColumn("asked", F.lit(True)), "id", "left")
    rows = (c.where("role IS NULL OR role <> 'assistant'")
            .unionByName(replies.where("asked IS NULL OR NOT text <=> result").select(*c.columns)))
    none = F.lit(None).cast

    @F.pandas_udf("string")
    def turn_json(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for roles, texts in batches:
            yield pd.Series([canonical({"role": r, "text": t}) for r, t in zip(roles, texts)], dtype="object")
    return rows.select("conv_id", "turn", none("string").alias("call_id"), none("string").alias("name"), none("int").alias("level"),
                       F.lit(False).alias("linked"), none("boolean").alias("valid"), F.array().cast("array<string>").alias("errors"),
                       turn_json("role", "text").alias("json"))
