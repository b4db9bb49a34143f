import json
import random

from postloom.llm import tool_calls
from postloom.llm.queries_chat import SCHEMAS
from postloom.llm.tool_calls import as_tool_messages, canonical, link_tool_calls, validate

WEATHER = {"type": "object", "required": ["city"], "additionalProperties": False, "properties": {
    "city": {"type": "string", "minLength": 2}, "days": {"type": "integer", "minimum": 1, "maximum": 5}, "unit": {"enum": ["c", "f"]},
    "from": {"type": ["string", "null"]}, "list": {"type": "array", "items": {"type": "number"}, "maxItems": 2}}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_validation():
    assert validate({"city": "Rome", "days": 3, "unit": "c", "from": None, "list": [1, 2.5]}, WEATHER) == []
    assert validate({"days": 9, "unit": "k", "x": 1, "list": ["a", 1, 2]}, WEATHER) == [
        "$.city: missing", "$.days: too large", "$.unit: value not allowed", "$.x: not allowed", "$.list: too many items", "$.list[0]: not of type number"]
    assert validate({"city": {"$ref": "a"}}, WEATHER) == [] and validate("x", WEATHER) == ["$: not of type object"]
    assert validate({"city": "R", "days": True}, WEATHER) == ["$.city: too few characters", "$.days: not of type integer"]
    assert canonical({"b": [1, {"d": "é\n", "c": None}], "a": 1.5}) == '{"a":1.5,"b":[1,{"c":null,"d":"é\\n"}]}'


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return sorted(((r.conv_id, r.turn, r.idx, r.kind, r.call_id, r.status, r.level, r.errors) for r in link_tool_calls(df, {"weather": WEATHER}).collect()), key=repr)


def test_linking_and_order(spark):
    ok = {"city": "Rome"}
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call(("a", "weather", ok), ("b", "weather", {"city": {"$ref": "a"}}))), (1, 2, "tool", result("b")), (1, 3, "tool", result("a")),
        (1, 4, "tool", result("a", "again")), (1, 5, "assistant", call(("a", "weather", ok))), (1, 6, "assistant", "plain {"), (1, 7, "tool", "no json"),
        # forward references: c needs d, d needs e
        (2, 0, "assistant", call(("c", "weather", {"city": {"$ref": "d"}}))), (2, 1, "assistant", call(("d", "weather", {"city": {"$ref": "e"}}))),
        (2, 2, "assistant", call(("e", "weather", ok))), (2, 3, "tool", result("c")),
        # a cycle, and a call outside it
        (3, 0, "assistant", call(("p", "weather", {"city": {"$ref": "q"}}), ("q", "weather", {"city": {"$ref": "p"}}), ("r", "weather", ok))),
        (4, 0, "tool", result("z")), (4, 1, "assistant", call(("z", "nothing", {"$ref": "gone"}))), (4, 2, "assistant", json.dumps({"tool_calls": [{"id": 1}, 5]})),
    ]
    assert linked(spark, rows) == sorted([
        (1, 0, 0, "text", None, "text", 0, ""), (1, 1, 0, "call", "a", "linked", 0, ""), (1, 1, 1, "call", "b", "linked", 0, ""), (1, 2, 0, "result", "b", "linked", 0, ""),
        (1, 3, 0, "result", "a", "linked", 0, ""), (1, 4, 0, "result", "a", "duplicate", 0, ""), (1, 5, 0, "call", "a", "duplicate", 0, ""), (1, 6, 0, "text", None, "text", 0, ""),
        (1, 7, 0, "malformed", None, "malformed", 0, ""),
        (2, 0, 0, "call", "c", "linked", 2, ""), (2, 1, 0, "call", "d", "unanswered", 1, ""), (2, 2, 0, "call", "e", "unanswered", 0, ""), (2, 3, 0, "result", "c", "linked", 2, ""),
        (3, 0, 0, "call", "p", "cycle", None, ""), (3, 0, 1, "call", "q", "cycle", None, ""), (3, 0, 2, "call", "r", "unanswered", 0, ""),
        (4, 0, 0, "result", "z", "orphan", 0, ""), (4, 1, 0, "call", "z", "unanswered", 0, "$: unknown reference gone; $: unknown tool nothing"),
        (4, 2, 0, "malformed", None, "malformed", 0, ""), (4, 2, 1, "malformed", None, "malformed", 0, ""),
    ], key=repr)


def test_edges(spark, rows_of):
    rows = [(None, None, None, None), (None, 1, "assistant", call(("a", "weather", {"city": "Rome"}))), (None, 2, "tool", result("a")), (1, None, "tool", result("a")),
            (1, 1, "user", ""), (1, 1, "user", ""), (2, 0, "assistant", call(("a", "weather", {"city": "Rome"}))), (2, 0, "assistant", call(("a", "weather", {"city": "Rome"})))]
    got = linked(spark, rows)
    assert got == sorted([
        (None, None, 0, "text", None, "text", 0, ""), (None, 1, 0, "call", "a", "linked", 0, ""), (None, 2, 0, "result", "a", "linked", 0, ""), (1, None, 0, "result", "a", "orphan", 0, ""),
        (1, 1, 0, "text", None, "text", 0, ""), (1, 1, 0, "text", None, "text", 0, ""), (2, 0, 0, "call", "a", "unanswered", 0, ""), (2, 0, 0, "call", "a", "unanswered", 0, "")], key=repr)
    df = spark.createDataFrame([(1, 0, "user", "hi", "x", "y")], "conv_id long, turn long, role string, text string, level string, conv string")
    assert link_tool_calls(as_tool_messages(df, "reply"), SCHEMAS).collect()[0].status == "unanswered"
    assert link_tool_calls(df.limit(0), SCHEMAS).collect() == []


def test_one_hot_conversation(spark):
    rows = [(1, 2 * k + d, "assistant" if d == 0 else "tool", call((f"c{k}", "weather", {"city": {"$ref": f"c{k - 1}"} if k else "Rome"})) if d == 0 else result(f"c{k}")) for k in range(300) for d in (0, 1)]
    got = linked(spark, rows)
    assert len(got) == 600 and {g[5] for g in got} == {"linked"} and {g[6] for g in got} == {0}


def longest(calls, refs):
    """Per call: the most references to a later call on a chain from it; None on a cycle or above one."""
    out = {}

    def level(c, above):
        if c in above:
            return None
        if c not in out:
            below = [(level(r, above | {c}), calls.index(r) >= calls.index(c)) for r in refs[c]]
            out[c] = None if any(b is None for b, _ in below) else max((b + late for b, late in below), default=0)
        return out[c]

    return {c: level(c, frozenset()) for c in calls}


def test_one_rule_for_every_level(spark):
    # backward chains beside a forward reference (d to e), and f above it
    refs = {1: {"a": [], "b": ["a"], "c": ["b"], "d": ["e"], "e": [], "f": ["d"]}, 2: {"a": [], "b": ["a"], "c": ["a", "b"]}}
    r = random.Random(7)
    for conv in range(3, 33):
        names = [f"n{k}" for k in range(6)]
        refs[conv] = {c: sorted(r.sample([x for x in names if x != c or r.random() < 0.1], r.choice((0, 1, 1, 2)))) for c in names}
    rows = [(conv, turn, "assistant", call((c, "weather", {"city": "Rome", "list": [{"$ref": x} for x in given]})))
            for conv, all_calls in refs.items() for turn, (c, given) in enumerate(all_calls.items())]
    want = {conv: longest(list(all_calls), all_calls) for conv, all_calls in refs.items()}
    assert want[1] == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 0, "f": 1} and set(want[2].values()) == {0}
    got = linked(spark, rows)
    assert {(g[0], g[4]): g[6] for g in got} == {(conv, c): v for conv, levels in want.items() for c, v in levels.items()}
    assert all((g[5] == "cycle") == (g[6] is None) for g in got) and len({g[6] for g in got}) > 3
    place = {(g[0], g[4]): (g[6], g[1], g[2]) for g in got}
    assert all(place[conv, x] < place[conv, c] for conv, all_calls in refs.items() for c, given in all_calls.items() for x in given if want[conv][c] is not None)


def test_levels_of_the_query_come_from_the_ordering(spark, monkeypatch):
    talk = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(8)] + [(2, 0, "system", "s"), (2, 1, "assistant", "x")]
    messages = as_tool_messages(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), "reply")
    ordering, given = tool_calls._levels, []

    def raised(calls):
        out = ordering(calls)
        given.append(sorted((x.conv, x.call_id, x.level) for x in out.collect()))
        return out.withColumn("level", out.level + 5)

    monkeypatch.setattr(tool_calls, "_levels", raised)
    got = link_tool_calls(messages, SCHEMAS).collect()
    assert given == [[("c1", f"1:{k}", 0) for k in (0, 2, 4, 6)]]
    assert {(x.kind, x.status, x.level) for x in got} == {("call", "linked", 5), ("result", "linked", 5), ("result", "orphan", 0), ("text", "text", 0)}
