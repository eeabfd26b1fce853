import json

import pytest

from tessera.llm import tool_calls as tc


def test_canonical():
    assert tc.canonical({"b": 1.0, "a": [None, True, "é\n"], "\U0001f600": 0, "דּ": 1e-7}) == '{"a":[null,true,"é\\n"],"b":1,"\U0001f600":0,"דּ":1e-7}'
    with pytest.raises(ValueError):
        tc.canonical(float("nan"))


@pytest.mark.parametrize("value,schema,ok", [
    (1, {"type": "integer"}, True), (1.0, {"type": "integer"}, True), (True, {"type": "integer"}, False), (1.5, {"type": ["integer", "string"]}, False),
    ("ab", {"minLength": 3}, False), ("ab", {"pattern": "^a"}, True), ([1, "x"], {"items": {"type": "integer"}}, False), ([], {"minItems": 1}, False),
    ({"a": 1}, {"required": ["b"]}, False), ({"a": 1}, {"properties": {"a": {"maximum": 0}}}, False), ({"a": 1, "b": 2}, {"properties": {"a": {}}, "additionalProperties": False}, False),
    (None, {"type": "null"}, True), ("x", {"enum": ["y", "x"]}, True), (3, {"anyOf": [{"type": "string"}, {"minimum": 3}]}, True),
])
def test_valid(value, schema, ok):
    assert tc.valid(value, schema) is ok


def call(k, name="add", args=None, deps=None):
    return {"id": k, "name": name, "arguments": args if args is not None else {"x": 1}, **({"depends_on": deps} if deps else {})}


def test_linking(spark):
    tools = {"add": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    say = lambda *calls, content=None: json.dumps({"content": content, "tool_calls": list(calls)})
    answer = lambda k, c: json.dumps({"tool_call_id": k, "content": c})
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "assistant", say(call("a", deps=["b"]), call("b"), content="hm")), (1, 2, "tool", answer("b", "B")), (1, 3, "tool", answer("a", [2, 1])),
        (1, 4, "tool", answer("a", "late")), (1, 5, "assistant", say(call("a"), call("c", args='{"x": "no"}'))), (1, 6, "tool", answer("nobody", 0)),
        (2, 1, "assistant", say(call("p", deps=["q"]), call("q", args={"x": 2, "y": {"$result": "p"}}), call("r", "unknown"))), (3, 0, "assistant", "{broken"), (None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = {(r.conv_id, r.turn, r.idx): r for r in tc.link_tool_calls(df, tools).collect()}
    assert set(got) == {(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 4, 0), (1, 5, 1), (1, 5, 2), (1, 6, 0), (2, 1, 1), (2, 1, 2), (2, 1, 3), (3, 0, 0), (None, None, 0)}
    a, b = got[1, 1, 1], got[1, 1, 2]
    assert (a.level, b.level, a.linked, b.linked, a.valid) == (1, 0, True, True, True)
    assert a.json == '{"arguments":{"x":1},"depends_on":["b"],"id":"a","name":"add","result":{"content":[2,1],"turn":3},"valid":true}'
    assert got[1, 5, 1].kind == "duplicate" and got[1, 5, 1].linked is False
    assert got[1, 5, 2].valid is False and got[1, 5, 2].linked is False
    assert got[1, 4, 0].kind == got[1, 6, 0].kind == "orphan"
    assert got[2, 1, 1].level == got[2, 1, 2].level == tc.CYCLE and got[1, 5, 1].level == 1 and got[2, 1, 3].valid is False
    assert json.loads(got[3, 0, 0].json) == {"content": "{broken", "role": "assistant"}
    for r in got.values():
        assert tc.canonical(json.loads(r.json)) == r.json


def test_levels_are_topological(spark):
    import random

    r = random.Random(4)
    deps = {f"n{k}": [f"n{j}" for j in r.sample(range(k), min(k, 2))] for k in range(40)}
    order = list(deps)
    r.shuffle(order)
    rows = [(7, t, "assistant", json.dumps({"tool_calls": [call(k, deps=deps[k])]})) for t, k in enumerate(order)]
    got = tc.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    place = {json.loads(x.json)["id"]: (x.level, x.turn) for x in got}
    assert all(place[d] < place[k] for k in deps for d in deps[k])


def brute_levels(deps):
    """Levels by peeling: all calls whose dependencies are known, then the next ones."""
    found = {}
    while True:
        free = {k for k in deps if k not in found and all(d in found for d in deps[k] if d in deps)}
        if not free:
            return {k: found.get(k, tc.CYCLE) for k in deps}
        found |= {k: max((found[d] + 1 for d in deps[k] if d in deps), default=0) for k in free}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_same_as_peeling(spark, seed):
    """Chains, joins of several chains, circles, calls that hang on circles, unknown and own identifiers."""
    import random

    r = random.Random(seed)
    want, rows = {}, []
    for conv in range(12):
        n = r.choice([1, 5, 30, 70])
        ids = [f"{conv}/{k}" for k in range(n)]
        deps = {k: ([ids[at - 1]] if at and r.random() < 0.8 else r.sample(ids[:at], min(at, r.randint(0, 3)))) for at, k in enumerate(ids)}
        for k in r.sample(ids, n // 20):
            deps[k] = [*deps[k], r.choice([*ids, k, "unknown"])]
        want |= {(str(conv), k): v for k, v in brute_levels(deps).items()}
        rows += [(str(conv), k, v) for k, v in deps.items()]
    got = tc.levels(spark.createDataFrame(rows, "conv string, call_id string, deps array<string>").repartition(3)).collect()
    assert {(x.conv, x.call_id): x.level for x in got} == want and len(got) == len(want)
    assert max(want.values()) > 20 and tc.CYCLE in want.values()


def test_plain_turns_have_levels(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(41) if t != 20]
    got = {r.turn: r.level for r in tc.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.kind == "call"}
    assert got == {t: t // 2 if t < 20 else (t - 22) // 2 for t in range(0, 41, 2) if t != 20}


@pytest.mark.parametrize("text", [
    '{"tool_calls":[{"id":"a","arguments":{"x":NaN}}]}', '{"tool_calls":[{"id":"a","arguments":{"x":-Infinity}}]}', '{"tool_calls":[{"id":"a","arguments":{"x":1e400}}]}',
    '{"tool_calls":[{"id":"a","depends_on":5}]}', '{"tool_calls":[{"id":"a","depends_on":{"b":1}}]}', '{"tool_calls":[7]}', '{"tool_calls":["a",null]}',
    '{"tool_calls":[{"id":"a","arguments":' + "[" * 100_000 + "]" * 100_000 + "}]}", '{"tool_calls":[{"id":"a","arguments":' + '{"a":' * 300 + "1" + "}" * 300 + "}]}",
    '{"tool_calls":[{"id":"\\ud800","arguments":{}}]}', '{"tool_calls":[{"id":"a","arguments":{"x":' + "9" * 5000 + "}}]}", '{"tool_calls":', "{",
])
def test_malformed_messages_are_plain(text):
    for role in ("assistant", "tool"):
        assert tc.parse(1, 0, role, text) == [(0, "message", None, None, tc.canonical({"content": text, "role": role}), [])]


def test_odd_texts(spark):
    """Malformed, very long and half-encoded texts pass; arguments that are no JSON stay text."""
    bad = ['{"tool_calls":[{"id":"a","arguments":{"x":NaN}}]}', '{"tool_calls":[{"id":"a","depends_on":5}]}', '{"tool_call_id":"\\ud800"}', "[" * 50_000, "x" * 2_000_000, "", None]
    good = json.dumps({"tool_calls": [{"id": 5, "name": ["n"], "arguments": '{"x":NaN}'}, {"id": "deep", "arguments": "[" * 5000}, {"id": "long", "arguments": {"x": "y" * 1_000_000}}]})
    rows = [(1, k, role, t) for k, t in enumerate(bad) for role in ("assistant", "tool", "user", None)] + [(2, 0, "assistant", good)]
    got = tc.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len([r for r in got if r.conv_id == 2]) == 3 and all(json.loads(r.json) is not None for r in got)
    assert json.loads(next(r.json for r in got if r.conv_id == 2 and r.idx == 1))["arguments"] == '{"x":NaN}'


@pytest.mark.parametrize("value,text", [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (123456789.125, "123456789.125"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (333333333.33333329, "333333333.3333333"), (4.50, "4.5"), (2e-3, "0.002"), (1e23, "1e+23")])
def test_numbers_as_ecmascript_writes_them(value, text):
    assert tc.number(value) == text and float(text) == value


def test_calls_and_results_meet_in_a_hash_join(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tc.link_tool_calls(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_plain_table(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "user", ""), (2, 0, "assistant", "first"), (2, 2, "assistant", "alone"), (2, 0, "user", None), (3, 0, "user", "x"), (3, 0, "user", "x")]
    got = sorted((r.conv_id, r.turn, r.kind, r.linked, r.valid) for r in tc.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.kind != "message")
    assert got == [(1, 0, "call", True, True), (1, 2, "call", False, False), (2, 0, "call", False, False), (2, 2, "orphan", None, None), (3, 0, "call", False, True), (3, 0, "call", False, True)]
    assert tc.link_tool_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
