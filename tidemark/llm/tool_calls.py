"""Tool calls in chats: linking, ordering, validation and canonical JSON.

Calls and results are hash-joined by identifier.  A call names the calls whose
results it uses (``after``: one identifier or an array of them); its ``level`` is
its place in the topological order of that graph, the length of the longest way
to it.  Runs of calls with one predecessor each are contracted by pointer
doubling, so a chain of n calls takes log n joins; what is left, calls with
several predecessors, is ordered in rounds, one for each such call on the deepest
way.  Arguments are checked against the schema of their tool, and call, result
and verdict are written as canonical JSON: keys sorted, no spaces, UTF-8 kept.

Defined cases: of calls (or results) that repeat an identifier the one with the
smallest content stays and ``n_calls`` / ``n_results`` count all; a call without
a result has ``status`` "open", a result without a call "orphan"; a call on or
after a cycle, or after a call that isn't there, has no level, and ``placed`` is
false; predecessors that are null or repeated count once or not at all; arguments
that are null, no JSON object, or hold numbers that JSON doesn't have are
invalid; a schema with a keyword outside ``KEYWORDS`` raises ValueError; null
identifiers take no part; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise

#: JSON types by the names of a schema (fixed values).
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


#: The keywords that ``problems`` knows; others would be silently unchecked (fixed values).
KEYWORDS = {"type", "enum", "minLength", "maxLength", "pattern", "minimum", "maximum", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "anyOf", "title", "description", "default"}


def check_schema(schema: dict) -> None:
    """Raise ValueError for a schema that ``problems`` can't check wholly."""
    if unknown := sorted(set(schema) - KEYWORDS):
        raise ValueError(f"unknown keywords of a schema: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if wrong := [k for k in (kinds if isinstance(kinds, list) else [kinds]) if k not in TYPES]:
        raise ValueError(f"unknown types of a schema: {wrong}")
    for part in [*schema.get("properties", {}).values(), *schema.get("anyOf", []), *([schema["items"]] if "items" in schema else [])]:
        check_schema(part)


def _is(value, kind: str) -> bool:
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def _same(a, b) -> bool:
    """Equal as JSON, where true is not 1."""
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(_same(value, one) for one in schema["enum"]):
        found.append(f"{at}: not in enum")
    if "anyOf" in schema and all(problems(value, one, at) for one in schema["anyOf"]):
        found.append(f"{at}: none of anyOf")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{at}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: not like the pattern")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        found.append(f"{at}: out of range")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        if schema.get("additionalProperties", True) is False:
            found += [f"{at}.{name}: unknown" for name in sorted(value) if name not in own]
        for name in sorted(own):
            if name in value:
                found += problems(value[name], own[name], f"{at}.{name}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            found.append(f"{at}: wrong number of items")
        for i, item in enumerate(value if "items" in schema else []):
            found += problems(item, schema["items"], f"{at}[{i}]")
    return found


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


def _number(text: str) -> float:
    if math.isinf(value := float(text)):
        _refuse(text)
    return value


def parsed(text: str | None):
    """The value of a JSON text; ValueError for NaN, infinities and numbers too large for a double."""
    return json.loads(text or "", parse_constant=_refuse, parse_float=_number)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _contracted(nodes: DataFrame) -> DataFrame:
    """(call_id, top, steps): up the single predecessors to the first call with none or several of them.

    A call whose way up ends at a missing call, or never ends, is left out.
    """
    ways = materialise(nodes.select("call_id", F.when(F.size("parents") == 1, F.col("parents")[0]).alias("up")).select("call_id", F.coalesce("up", "call_id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("up").isNull().alias("ended")), "tool-calls-ways")
    left = nodes.count()
    while left > 0 and not ways.filter("not ended").isEmpty():
        ends = ways.select(F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("then"))
        longer = ways.filter("not ended").join(ends, "top").select("call_id", F.col("next").alias("top"), F.col("steps") + F.col("more"), F.col("then").alias("ended"))
        ways = materialise(ways.filter("ended").unionAll(longer), "tool-calls-ways")
        left //= 2
    return ways.filter("ended").drop("ended")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of each call: 0 without ``after``, else one more than the highest of those calls'."""
    after = F.col("after") if isinstance(calls.schema["after"].dataType, T.ArrayType) else F.array("after")
    nodes = calls.select("call_id", F.array_distinct(F.array_compact(F.coalesce(after, F.array().cast("array<string>")))).alias("parents"))
    nodes = materialise(nodes, "tool-calls-nodes")
    ways = materialise(_contracted(nodes), "tool-calls-contracted")
    # edges of the calls with several predecessors, each to the top of its predecessor's run
    several = nodes.filter("size(parents) > 1").select("call_id", F.size("parents").alias("n"), F.explode("parents").alias("parent"))
    edges = several.join(ways.withColumnRenamed("call_id", "parent"), "parent").select("call_id", "n", "top", "steps")
    edges = materialise(edges, "tool-calls-edges")
    placed = materialise(nodes.filter("size(parents) = 0").select("call_id", F.lit(0).cast("long").alias("level")), "tool-calls-placed")
    while True:
        ready = edges.join(placed.withColumnsRenamed({"call_id": "top", "level": "base"}), "top").groupBy("call_id").agg(F.count("*").alias("known"), F.first("n").alias("n"), F.max(F.col("base") + F.col("steps") + 1).alias("level"))
        new = materialise(ready.filter("known = n").select("call_id", "level").join(placed, "call_id", "left_anti"), "tool-calls-new")
        if new.isEmpty():
            break
        placed = placed.unionAll(new)
    tops = placed.withColumnsRenamed({"call_id": "top", "level": "base"})
    level = ways.join(tops, "top").select("call_id", (F.col("base") + F.col("steps")).alias("level"))
    return nodes.select("call_id").join(level, "call_id", "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each identifier.

    ``calls``: call_id, name, arguments (JSON), after.  ``results``: call_id,
    content.  ``schemas``: by tool name, a fixed table of the caller; one without a
    "type" is one of objects.
    """
    for schema in schemas.values():
        check_schema(schema)
    one = calls.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("call"), F.count("*").alias("n_calls"))
    two = results.filter("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    one = materialise(one, "tool-calls-once")
    order = levels(one.select("call_id", "call.after"))
    joined = one.hint("shuffle_hash").join(two, "call_id", "full").join(order, "call_id", "left")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("n_results").isNull(), "open").otherwise("linked")
    rows = joined.select("call_id", "call.name", "call.arguments", "content", "level", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, text = [], [], []
            for row in batch.to_pylist():
                found: list[str] = []
                arguments = None
                if row["status"] != "orphan":
                    try:
                        arguments = parsed(row["arguments"])
                        found = problems(arguments, {"type": "object", **schemas[row["name"]]}) if row["name"] in schemas else ["$: unknown tool"]
                    except (ValueError, RecursionError):
                        found = ["$: not JSON"]
                valid.append(row["status"] != "orphan" and not found)
                errors.append(found)
                text.append(canonical({"id": row["call_id"], "name": row["name"], "arguments": arguments, "result": row["content"], "level": row["level"], "status": row["status"], "valid": valid[-1]}))
            keep = [batch[c] for c in ("call_id", "name", "level", "status", "n_calls", "n_results")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(text, pa.string())], names=["call_id", "name", "level", "status", "n_calls", "n_results", "valid", "errors", "json"])

    return rows.mapInArrow(run, "call_id string, name string, level long, status string, n_calls long, n_results long, valid boolean, errors array<string>, json string")


#: The tool that a user's turn stands for when a plain chat is read as calls and results.
REPLY = {"reply": {"properties": {"text": {"type": "string", "minLength": 1}, "chars": {"type": "integer", "minimum": 1}}, "required": ["text", "chars"], "additionalProperties": False}}


def calls_of_chat(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chat (conv_id, turn, role, text) as calls and results.

    Each user turn calls ``reply``, after the user turn two before it, if there is
    one; the assistant turn that follows is its result.
    """
    ident = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    known = turns.filter("conv_id is not null and turn is not null")
    users = known.filter("role = 'user'")
    earlier = users.select("conv_id", (F.col("turn") + 2).alias("turn"), ident(F.col("turn")).alias("after")).distinct()
    arguments = F.to_json(F.struct(F.col("text"), F.length("text").alias("chars")))
    calls = users.join(earlier, ["conv_id", "turn"], "left").select(ident(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), "after")
    results = known.filter("role = 'assistant'").select(ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
