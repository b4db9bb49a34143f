"""Chat formatting: tool calls and their results linked, ordered, validated and serialised.

Messages are rows (conv_id, turn, role, text).  An assistant's text that is a JSON object with
``tool_calls`` holds calls ``{"id", "name", "arguments"}``; a tool's text is a JSON object
``{"tool_call_id", "content"}``; every other message is plain text.  Inside arguments
``{"$ref": id}`` stands for the result of another call of the conversation.

Method: calls and results meet in a hash join on (conversation, identifier).  Of calls with one
identifier the first (turn, then place in the message) counts, and of a call's results the
first; both are found by an aggregation with partial sums before the join, so the joins pair
each row with one row at most.  Calls are ordered topologically by their references: ``level`` is
the most references to a later call on any chain of references from the call, so ordering by
(level, turn, idx) puts every call after those it refers to: a later one is a level lower, an
earlier one no level higher.  Without a forward reference in the conversation that is 0; the calls
of the others go through rounds that place those whose references are placed (one round per step
of the longest chain; a round that places none ends them, and what is left lies on a cycle or
refers to one).  Level and ``cycle`` of every call are this step's.  Arguments are validated
against the tool's JSON schema, a parameter of the job.  JSON is written canonically: keys sorted,
no white space.

One row per call, result or text, so a conversation of any length never meets in one task; a
conversation that holds a large share of all rows is split by identifier.

``status``: linked, unanswered (call without result), orphan (result without call, or before it),
duplicate (a later call or result for an identifier), cycle, malformed (tool message that is no
such JSON), text.  ``errors``: schema and reference errors, sorted, joined by "; ".

Edge cases: null role or text is a plain text with empty content.  Null conv_id is a
conversation of its own; null turn sorts first.  Equal rows are kept: the tool messages among
them are duplicates of one another, told apart by the order ``idx`` (place inside the message)
and a hash of the text; exact repetitions all take the first one's part.  No rows give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import materialize

TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, TYPES.get(kind, object))


def _reference(value: object) -> str | None:
    return value["$ref"] if isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str) else None


def validate(value: object, schema: dict, at: str = "$") -> list[str]:
    """Errors of ``value`` under the usual keywords: type, enum, const, required, properties,
    additionalProperties, items, minItems, maxItems, minLength, maxLength, minimum, maximum.
    A reference stands for any value."""
    if _reference(value) is not None:
        return []
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at}: value not allowed")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += validate(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += validate(v, schema["additionalProperties"], f"{at}.{k}")
    size = {list: ("Items", "items"), str: ("Length", "characters")}.get(type(value))
    if size:
        if len(value) < schema.get(f"min{size[0]}", 0):
            out.append(f"{at}: too few {size[1]}")
        if len(value) > schema.get(f"max{size[0]}", len(value)):
            out.append(f"{at}: too many {size[1]}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        out += [e for i, v in enumerate(value) for e in validate(v, schema["items"], f"{at}[{i}]")]
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    return out


def references(value: object) -> list[str]:
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        r = _reference(v)
        if r is not None:
            out.append(r)
        elif isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(set(out))


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """The items of one message: kind, call_id, name, refs, errors, json."""
    text = text or ""
    plain = {"kind": "text", "call_id": None, "name": None, "refs": [], "errors": [], "json": None}
    if role in ("assistant", "tool"):
        try:
            body = json.loads(text)
        except (ValueError, RecursionError):
            body = None
        if role == "tool" and not (isinstance(body, dict) and isinstance(body.get("tool_call_id"), str)):
            return [plain | {"kind": "malformed", "json": canonical({"content": text, "role": role})}]
        if role == "tool":
            return [plain | {"kind": "result", "call_id": body["tool_call_id"], "json": canonical({"content": body.get("content"), "tool_call_id": body["tool_call_id"]})}]
        if isinstance(body, dict) and "tool_calls" in body:
            out = []
            for call in body["tool_calls"] if isinstance(body["tool_calls"], list) else [None]:
                if not (isinstance(call, dict) and isinstance(call.get("id"), str) and isinstance(call.get("name"), str)):
                    out.append(plain | {"kind": "malformed", "json": canonical({"content": call, "role": role})})
                    continue
                given = call.get("arguments", {})
                if isinstance(given, str):  # some formats send the arguments as JSON text
                    try:
                        given = json.loads(given)
                    except (ValueError, RecursionError):
                        pass
                errors = [f"$: unknown tool {call['name']}"] if call["name"] not in schemas else validate(given, schemas[call["name"]])
                out.append(plain | {"kind": "call", "call_id": call["id"], "name": call["name"], "refs": references(given), "errors": errors,
                                    "json": canonical({"arguments": given, "id": call["id"], "name": call["name"]})})
            return out
    return [plain | {"json": canonical({"content": text, "role": role or ""})}]


def _parse(schemas: dict[str, dict]):
    items = pa.list_(pa.struct([("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("refs", pa.list_(pa.string())),
                                ("errors", pa.list_(pa.string())), ("json", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                parsed = [parse_message(r, t, schemas) for r, t in zip(part["role"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"conv_id": part["conv_id"], "turn": part["turn"], "tag": part["tag"], "items": pa.array(parsed, items)})

    return run


def _levels(calls: DataFrame) -> DataFrame:
    """The first calls with their ``level``, null on a cycle and for what refers to one.

    ``calls``: stored (conv, call_id, call_at, call_refs), one row per identifier."""
    at = F.struct(F.coalesce("call_at.turn", F.lit(-(1 << 62))).alias("turn"), "call_at.idx")
    edges = calls.select("conv", "call_id", F.explode("call_refs").alias("ref"), at.alias("at"))
    target = calls.select("conv", F.col("call_id").alias("ref"), at.alias("ref_at"))
    edges = edges.join(target, ["conv", "ref"]).select("conv", "call_id", "ref", (F.col("ref_at") >= F.col("at")).cast("int").alias("later"))
    edges = materialize(edges, "call-references")
    forward = materialize(edges.where("later = 1").select("conv").distinct(), "forward-conversations")
    backward = calls.join(forward, "conv", "left_anti").withColumn("level", F.lit(0))
    # ``level`` of a waiting call: what its placed references ask for
    waiting = calls.join(forward, "conv", "left_semi").select("conv", "call_id", F.lit(0).alias("level"))
    edges = edges.join(forward, "conv", "left_semi")
    placed = None
    while not waiting.isEmpty():
        now = materialize(waiting.join(edges, ["conv", "call_id"], "left_anti"), "placed-calls")
        if now.isEmpty():  # the rest refer to one another in circles
            now, waiting = waiting.withColumn("level", F.lit(None).cast("int")), now
        else:
            met = edges.join(now.select("conv", F.col("call_id").alias("ref"), F.col("level").alias("below")), ["conv", "ref"])
            asked = met.groupBy("conv", "call_id").agg(F.max(F.col("below") + F.col("later")).alias("asked"))
            rest = waiting.join(now, ["conv", "call_id"], "left_anti").join(asked, ["conv", "call_id"], "left")
            waiting = materialize(rest.select("conv", "call_id", F.greatest("level", "asked").alias("level")), "waiting-calls")
            edges = materialize(edges.join(now.select("conv", F.col("call_id").alias("ref")), ["conv", "ref"], "left_anti").select("conv", "call_id", "ref", "later"), "open-references")
        placed = now if placed is None else placed.union(now)
    return backward if placed is None else backward.unionByName(calls.join(placed, ["conv", "call_id"]))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, idx, kind, call_id, name, status, level, errors, json: one row per call, result or text."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    read = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.xxhash64("role", "text").alias("tag"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    item = "struct<kind:string,call_id:string,name:string,refs:array<string>,errors:array<string>,json:string>"
    parsed = read.mapInArrow(_parse(schemas), f"conv_id {kind}, turn long, tag long, items array<{item}>")
    # the identity of a conversation, null included
    items = parsed.select("conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "turn", "tag",
                          F.posexplode("items").alias("idx", "i")).select("conv_id", "conv", "turn", "tag", "idx", "i.*")
    items = materialize(items, "chat-items")
    place = F.struct("turn", "idx", "tag")
    calls = items.where("kind = 'call'")
    first_call = materialize(calls.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "idx", "tag", "refs")).alias("c")), "first-calls")
    ids = first_call.select("conv", "call_id", F.struct("c.turn", "c.idx", "c.tag").alias("call_at"), F.col("c.refs").alias("call_refs"))
    results = items.where("kind = 'result'")
    after = results.join(ids.select("conv", "call_id", "call_at"), ["conv", "call_id"]).where(F.coalesce(place > F.col("call_at"), F.lit(False)))
    first_result = materialize(after.groupBy("conv", "call_id").agg(F.min(place).alias("result_at")), "first-results")
    # references to identifiers that the conversation does not have
    named = ids.select("conv", "call_id", F.explode("call_refs").alias("ref"))
    unknown = named.join(ids.select("conv", F.col("call_id").alias("ref")), ["conv", "ref"], "left_anti").groupBy("conv", "call_id").agg(
        F.sort_array(F.collect_set(F.concat(F.lit("$: unknown reference "), F.col("ref")))).alias("unknown"))
    about = _levels(ids).drop("call_refs").join(first_result, ["conv", "call_id"], "left").join(unknown, ["conv", "call_id"], "left")
    about = materialize(about, "calls")

    tool = items.where("kind in ('call', 'result')").join(about, ["conv", "call_id"], "left")
    is_call, first = F.col("kind") == "call", place == F.col("call_at")
    status = F.when(is_call & ~first, "duplicate").when(is_call & F.col("level").isNull(), "cycle").when(
        is_call, F.when(F.col("result_at").isNull(), "unanswered").otherwise("linked")).when(
        F.col("call_at").isNull() | ~F.coalesce(place > F.col("call_at"), F.lit(False)), "orphan").when(place == F.col("result_at"), "linked").otherwise("duplicate")
    errors = F.array_sort(F.concat("errors", F.when(is_call & first, F.coalesce("unknown", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))
    level = F.when(F.col("call_at").isNull(), 0).otherwise(F.col("level"))  # 0: a result without a call
    other = items.where("kind in ('text', 'malformed')")
    shape = ["conv_id", "turn", "idx", "kind", "call_id", "name"]
    return tool.select(*shape, status.alias("status"), level.cast("int").alias("level"), F.array_join(errors, "; ").alias("errors"), "json").union(
        other.select(*shape, F.col("kind").alias("status"), F.lit(0).alias("level"), F.lit("").alias("errors"), "json"))


def as_tool_messages(conversations: DataFrame, tool: str) -> DataFrame:
    """Plain conversations as tool messages: a user's turn calls ``tool`` (arguments: the prompt, and a
    reference to the call two turns before), the assistant's turn is the result of the call before it,
    other turns stay."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("long")
    name = lambda t: F.concat(conv, F.lit(":"), t.cast("string"))
    after = F.when(turn >= 2, F.array(F.struct(name(turn - 2).alias("$ref"))))
    call = F.struct(F.array(F.struct(name(turn).alias("id"), F.lit(tool).alias("name"), F.struct(F.col("text").alias("prompt"), after.alias("after")).alias("arguments"))).alias("tool_calls"))
    result = F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, F.to_json(call)).when(assistant, F.to_json(result)).otherwise(F.col("text")).alias("text"))
