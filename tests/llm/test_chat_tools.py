"""Linking, order, validation and canonical JSON of tool calls on small conversations."""

import json
import random

from corvello.llm import chat_tools

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"tools": [{"name": "add", "parameters": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "note": {"type": "string"}}, "required": ["a", "b"]}}]}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def run(spark, rows):
    got = chat_tools.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.conv_id, r.turn): (r.n_calls, r.n_linked, r.n_valid, r.level, json.loads(r.message)) for r in got}, got


def test_linking_order_and_validation(spark):
    rows = [
        (1, 0, "system", json.dumps(TOOLS)),
        (1, 1, "user", "sum \"x\"\né"),
        (1, 2, "assistant", call(("c1", "add", {"b": 2.5, "a": 1}), ("c2", "add", {"a": "${c1}", "b": 1}))),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3.5"})),
        (1, 4, "assistant", call(("c3", "add", {"a": 1, "b": 2, "note": "after ${c2} and ${c1}"}))),
        (1, 5, "tool", json.dumps({"tool_call_id": "nobody", "content": "x"})),
        (2, 0, "assistant", call(("c1", "add", {"z": [1, {"y": 1, "x": None}]}))),
        (2, 1, "assistant", call(("p", "f", {"x": "${q}"}), ("q", "f", {"x": "${p}"}), ("r", "f", {}))),
        (2, 2, "assistant", call((None, "f", {}), ("s", None, {}), ("t", "f", "text"))),
        (3, 0, "assistant", "{not json"),
        (3, 1, None, None),
    ]
    got, _ = run(spark, rows)
    assert len(got) == len(rows)
    assert got[1, 1] == (0, 0, 0, None, {"content": "sum \"x\"\né", "role": "user"})
    n_calls, n_linked, n_valid, level, message = got[1, 2]
    assert (n_calls, n_linked, n_valid, level) == (2, 1, 1, 1)
    first, second = message["tool_calls"]
    assert first == {"arguments": '{"a":1,"b":2.5}', "id": "c1", "level": 0, "name": "add", "result": "3.5", "valid": True}
    assert second["level"] == 1 and not second["valid"] and "result" not in second
    assert got[1, 4][:4] == (1, 0, 1, 2)
    assert got[1, 3] == (0, 1, 0, None, {"content": "3.5", "name": "add", "role": "tool", "tool_call_id": "c1"})
    assert got[1, 5][1] == 0
    assert got[2, 0][:4] == (1, 0, 1, 0) and got[2, 0][4]["tool_calls"][0]["arguments"] == '{"z":[1,{"x":null,"y":1}]}'
    assert got[2, 1][:4] == (3, 0, 3, None)
    assert [c["valid"] for c in got[2, 2][4]["tool_calls"]] == [False, False, False]
    assert got[3, 0][4] == {"content": "{not json", "role": "assistant"}
    assert got[3, 1][4] == {}


def test_edges(spark):
    assert run(spark, [])[1] == []
    rows = [(1, 0, "assistant", call(("c", "f", {})))] * 2 + [(1, 1, "tool", json.dumps({"tool_call_id": "c", "content": str(k)})) for k in (2, 1)] + [(None, None, "user", "x" * 100_000)]
    _, got = run(spark, rows)
    assert len(got) == 5
    assert [json.loads(r.message)["tool_calls"][0]["result"] for r in got if r.n_calls] == ["1", "1"]
    clash = spark.createDataFrame([(1, 0, "user", "hi", "k", 7)], SCHEMA + ", key string, level int")
    assert chat_tools.formatted(clash).collect()[0].message == '{"content":"hi","role":"user"}'


def test_content_order_and_nested_schemas(spark):
    line = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "tag": {"type": ["string", "null"], "maxLength": 3}}, "required": ["n"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"unit": {"enum": ["m", "ft"]}, "lines": {"type": "array", "items": line, "minItems": 1}}, "additionalProperties": {"type": "number", "exclusiveMaximum": 5}}
    cases = [({"unit": "m", "lines": [{"n": 1, "tag": None}, {"n": 2.0, "tag": "abc"}], "x": 4.5}, True), ({"unit": "km"}, False), ({"lines": []}, False), ({"lines": [{"n": 0}]}, False),
             ({"lines": [{"n": 1}, {"tag": "a"}]}, False), ({"lines": [{"n": 1, "tag": "abcd"}]}, False), ({"lines": [{"n": 1, "tag": 1}]}, False), ({"lines": [{"n": 1, "z": 1}]}, False), ({"x": 5}, False), ({"x": "5"}, False), ({}, True)]
    text = {"content": "let me \"see\"", "refusal": None, "role": "x", "tool_calls": [{"id": "b", "name": "f", "arguments": {"x": "${a}"}}, {"id": None, "name": "f", "arguments": {}}, {"id": "a", "name": "f", "arguments": {}}]}
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "size", "parameters": schema}]})), (1, 1, "assistant", call(*((f"c{k}", "size", a) for k, (a, _) in enumerate(cases))))]
    rows += [(2, 0, "assistant", json.dumps(text)), (2, 1, "assistant", json.dumps({"content": None, "tool_calls": []}))]
    got, _ = run(spark, rows)
    assert [c["valid"] for c in got[1, 1][4]["tool_calls"]] == [ok for _, ok in cases]
    message = got[2, 0][4]
    assert [c.get("id") for c in message["tool_calls"]] == ["a", "b", None]
    assert (message["content"], message["refusal"], message["role"]) == ("let me \"see\"", None, "assistant") and list(message) == sorted(message)
    assert got[2, 1][4] == {"role": "assistant", "tool_calls": []}


def test_random_call_graphs(spark):
    """Levels and order against peeling by hand; several conversations, forward and backward references, cycles, repeated ids."""
    rng, rows, want = random.Random(7), [], {}
    for conv in range(8):
        n = rng.randrange(3, 14)
        needs = {i: sorted({rng.randrange(n + 2) for _ in range(rng.randrange(3))} - ({i} if conv % 3 else set())) for i in range(n)}
        level, left = {}, dict(needs)
        while ready := [i for i, x in left.items() if not any(j in left for j in x)]:
            for i in ready:
                level[i] = max([level[j] + 1 for j in needs[i] if j in needs], default=0)
            for i in ready:
                del left[i]
        order = list(needs)
        rng.shuffle(order)
        parts = [order[: n // 2], order[n // 2 :]]
        for turn, part in enumerate(parts):
            rows.append((conv, turn, "assistant", call(*((f"id{i}", "f", {"x": " ".join(f"${{id{j}}}" for j in needs[i])}) for i in part))))
            places = [(level.get(i) is None, level.get(i, 0), part.index(i), i) for i in part]
            want[conv, turn] = [(f"id{i}", level.get(i)) for *_, i in sorted(places)]
    got, _ = run(spark, rows)
    assert {k: [(c["id"], c.get("level")) for c in v[4]["tool_calls"]] for k, v in got.items()} == want
