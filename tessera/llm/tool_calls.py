"""Chat formatting: tool calls linked with their results.

Messages become events: calls, results and plain messages. One aggregate by
identifier finds the first call and the first result, which count, and a shuffled
hash join brings them back to the events. A call's level is 0 if it depends on no
other call, else one more than the highest level it depends on: chains of calls with
one dependency each are followed by doubling steps, and only what joins several
chains is peeled, level by level. Arguments are validated against the tools'
schemas, and every event is written as canonical JSON: no white space, keys sorted
by UTF-16 and floats written as RFC 8785 does; integers keep all their digits.

Rows stay events throughout, so a conversation of any length is never gathered.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import importable, written

#: The tool that a plain user turn calls, and its schema.
RESPOND = {"respond": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}}
EVENTS = "conv_id long, turn long, idx int, kind string, call_id string, name string, payload string, deps array<string>"
#: Level of calls that depend on themselves, over any number of steps, and of calls that depend on such.
CYCLE = -1
#: JSON nested deeper than this is plain text.
NESTING = 200


def number(value: float) -> str:
    """A float in the shortest decimal form that reads back, as ECMAScript writes it."""
    if not math.isfinite(value):
        raise ValueError("not a JSON number")
    if value == 0:
        return "0"
    mantissa, _, exponent = repr(abs(value)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))  # digits before the decimal point
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= point <= 21:
        text = digits + "0" * (point - k)
    elif 0 < point <= 21:
        text = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[0] + ("." + digits[1:] if k > 1 else "") + f"e{point - 1:+d}"
    return "-" * (value < 0) + text


def canonical(value) -> str:
    """JSON in one form: equal values give equal text. ValueError for numbers that JSON has not."""
    if value is None or isinstance(value, (bool, str, int)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


def loaded(text: str):
    """The value of a JSON text; ValueError if it is none, holds numbers or characters that JSON or UTF-8 has not, or nests too deep."""

    def finite(x: str) -> float:
        if not math.isfinite(value := float(x)):
            raise ValueError("not a JSON number")
        return value

    try:
        value = json.loads(text, parse_constant=finite, parse_float=finite)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(NESTING):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            canonical(value).encode("utf-8")  # UnicodeEncodeError, a ValueError, for half a surrogate pair
            return value
    raise ValueError("nested too deep")


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES[kind])


def valid(value, schema: dict) -> bool:
    """Whether a value meets a JSON schema of types, enumerations, bounds, patterns, properties and items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return False
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return False
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if "anyOf" in schema and not any(valid(value, s) for s in schema["anyOf"]):
        return False
    if _is(value, "number"):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(valid(x, schema.get("items", {})) for x in value)
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", [])):
            return False
        rest = [v for k, v in value.items() if k not in known]
        if rest and (more is False or isinstance(more, dict) and not all(valid(v, more) for v in rest)):
            return False
        return all(valid(value[k], s) for k, s in known.items() if k in value)
    return True


def references(value) -> list[str]:
    """Identifiers of calls that arguments refer to, as {"$result": id}, in order."""
    if isinstance(value, dict):
        own = [value["$result"]] if isinstance(value.get("$result"), str) else []
        return own + [r for k in sorted(value) for r in references(value[k])]
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


def _calls(body: dict, role: str) -> list[tuple] | None:
    """The events of a message with tool calls; None if it is malformed."""
    out = []
    if body.get("content"):
        out.append((0, "message", None, None, canonical({"content": body["content"], "role": role}), []))
    for k, call in enumerate(body["tool_calls"], 1):
        deps = call.get("depends_on") or [] if isinstance(call, dict) else None
        if not isinstance(deps, list):
            return None
        args = call.get("arguments")
        if isinstance(args, str):
            try:
                args = loaded(args)
            except ValueError:
                pass
        deps = [d for d in deps if isinstance(d, str)] + references(args)
        name, call_id = (None if call.get(x) is None else str(call[x]) for x in ("name", "id"))
        out.append((k, "call", call_id, name, canonical(args), list(dict.fromkeys(deps))))
    return out


def parse(conv, turn, role, text) -> list[tuple]:
    """The events of one message: (idx, kind, call_id, name, payload, deps). Text that is no well-formed call or result is a plain message."""
    body = None
    if role in ("assistant", "tool") and text and text.lstrip().startswith("{"):
        try:
            body = loaded(text)
        except ValueError:
            body = None
    if role == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list) and (found := _calls(body, role)) is not None:
        return found
    if role == "tool" and isinstance(body, dict) and "tool_call_id" in body:
        return [(0, "result", str(body["tool_call_id"]), None, canonical({"content": body.get("content"), "turn": turn}), [])]
    if role == "user" and turn is not None:
        return [(0, "call", f"{conv}:{turn}", "respond", canonical({"prompt": text, "turn": turn}), [f"{conv}:{turn - 2}"] if turn >= 2 else [])]
    if role == "assistant" and turn is not None and turn >= 1:
        return [(0, "result", f"{conv}:{turn - 1}", None, canonical({"content": text, "turn": turn}), [])]
    return [(0, "message", None, None, canonical({"content": text, "role": role}), [])]


def events(messages: DataFrame) -> DataFrame:
    """The events of all messages; see EVENTS."""
    importable(messages.sparkSession)

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("idx", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("payload", pa.string()), ("deps", pa.list_(pa.string()))])
        for batch in batches:
            rows = [(c, t, *e) for c, t, r, x in zip(*(col.to_pylist() for col in batch.columns), strict=True) for e in parse(c, t, r, x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(read, EVENTS)


def levels(calls: DataFrame) -> DataFrame:
    """conv, call_id, level of calls (conv, call_id, deps), one row each.

    Level 0 depends on no other call of the conversation, each further level on
    calls of lower ones; CYCLE marks calls that never come free. The number of
    steps is the logarithm of the longest chain, and one more for every call
    with several dependencies along a path.
    """
    key = ["conv", "call_id"]
    calls = written(calls.select(*key, "deps"), "calls")
    known = calls.select("conv", F.col("call_id").alias("dep"))
    edges = written(calls.select(*key, F.explode("deps").alias("dep")).distinct().join(known.hint("shuffle_hash"), ["conv", "dep"]), "dependencies")
    if edges.isEmpty():
        return calls.select(*key, F.lit(0).alias("level"))
    degree = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    # end: what a chain leads to, steps: over how many calls; a call without or with several dependencies ends its own
    single = F.coalesce(F.col("n"), F.lit(0)) == 1
    start = calls.select(*key).join(degree.hint("shuffle_hash"), key, "left")
    chains = written(start.select(*key, F.when(single, F.col("dep")).otherwise(F.col("call_id")).alias("end"), F.when(single, 1).otherwise(0).alias("steps"), (~single).alias("done"), F.coalesce("n", F.lit(0)).alias("n")), "chains")
    done, left = chains.filter("done"), chains.filter("NOT done")
    most = max(1, left.count()).bit_length() + 1
    for _ in range(most):
        if left.isEmpty():
            break
        ahead = done.unionByName(left).select("conv", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"), F.col("done").alias("over"))
        moved = written(left.join(ahead.hint("shuffle_hash"), ["conv", "end"]).select(*key, F.col("next").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("over").alias("done"), "n"), "chains")
        done, left = done.unionByName(moved.filter("done")), moved.filter("NOT done")
    found = _joined_levels(written(done, "chains-done"), edges)
    # what is left after so many doublings runs in a circle
    return found.unionByName(left.select(*key, F.lit(CYCLE).alias("level")))


def _joined_levels(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """conv, call_id, level of calls whose chains have ended, at a call without dependencies or with several."""
    key = ["conv", "call_id"]
    ends = chains.filter("n = 0").select(*key, F.lit(0).alias("level"))
    waits = chains.filter("n > 1").select(*key)
    if not waits.isEmpty():
        leads = chains.select("conv", F.col("call_id").alias("dep"), "end", "steps")
        # a dependency in a circle has no end, and its call never comes free
        open_edges = written(edges.join(waits, key, "left_semi").join(leads, ["conv", "dep"], "left").select(*key, "end", F.col("steps")), "joins")
        ends = written(ends, "levels-found")
        while True:
            at = open_edges.join(ends.select("conv", F.col("call_id").alias("end"), "level"), ["conv", "end"], "left")
            free = at.groupBy(*key).agg(F.max(F.col("steps") + F.col("level") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0")
            free = written(free.select(*key, F.col("level").cast("int").alias("level")), "levels-found")
            if free.isEmpty():
                break
            ends = ends.unionByName(free)
            open_edges = written(open_edges.join(free, key, "left_anti"), "joins")
    named = ends.select("conv", F.col("call_id").alias("end"), "level")
    return chains.join(named.hint("shuffle_hash"), ["conv", "end"], "left").select(*key, F.coalesce(F.col("level") + F.col("steps"), F.lit(CYCLE)).cast("int").alias("level"))


def link_tool_calls(messages: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, idx, kind, level, linked, valid, json: one row for each event but linked results.

    ``kind``: call; duplicate, a call whose identifier came before; orphan, a result
    without a call or after the first result; message. ``level``: see ``levels``; of
    a duplicate, its first call's, and 0 of what is no call. Within a conversation, (level,
    turn, idx) is a topological order. ``linked``: the call has a result, which its json
    holds; ``valid``: its tool is known and its arguments meet the schema (both null
    for other kinds). ``tools``: schemas by name; by default plain user turns call
    ``respond`` and the next turn, if an assistant's, is the result.

    Null text fails its schema, an empty one too; a text of any length is one event, as
    a plain message if it is no well-formed JSON, nests over ``NESTING`` deep, or holds numbers
    or characters that JSON or UTF-8 has not. Null turns and roles make plain messages; null
    conversation ids are one conversation. A call without an identifier is never linked and
    has level 0. Repeated rows each give their row; of different ones at one place the smallest
    payload counts. No rows give no rows. Other columns are ignored, whatever their names.
    """
    schemas = RESPOND if tools is None else tools
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv")
    rows = written(events(messages).select("*", conv, F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "idx").alias("at")), "events")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    firsts = rows.filter((is_call | is_result) & F.col("call_id").isNotNull()).groupBy("conv", "call_id").agg(
        F.min(F.when(is_call, F.struct("at", "payload", "deps"))).alias("call"), F.min(F.when(is_result, F.struct("at", "payload"))).alias("answer")
    )
    firsts = written(firsts.select("conv", "call_id", F.col("call.at").alias("first_call"), F.col("call.deps").alias("deps"), F.col("answer.at").alias("first_result"), F.col("answer.payload").alias("result")), "first-events")
    ordered = levels(firsts.filter("first_call IS NOT NULL"))
    by_id = firsts.drop("deps").join(ordered.hint("shuffle_hash"), ["conv", "call_id"], "left")
    joined = rows.join(by_id.hint("shuffle_hash"), ["conv", "call_id"], "left")
    again = is_call & (F.col("at") != F.col("first_call"))
    kind = F.when(again, "duplicate").when(is_result, "orphan").otherwise(F.col("kind"))
    folded = is_result & F.col("first_call").isNotNull() & (F.col("at") == F.col("first_result"))
    out = joined.filter(~F.coalesce(folded, F.lit(False))).select(
        "conv_id", "turn", "idx", kind.alias("kind"), F.when(is_call, F.coalesce("level", F.lit(0))).otherwise(0).alias("level"), "call_id", "name", "payload", "deps", F.when(is_call & ~F.coalesce(again, F.lit(False)), F.col("result")).alias("result")
    )

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            linked, fits, text = [], [], []
            for r in batch.select(["kind", "call_id", "name", "payload", "deps", "result"]).to_pylist():
                if r["kind"] not in ("call", "duplicate"):
                    linked.append(None)
                    fits.append(None)
                    text.append(r["payload"] if r["kind"] == "message" else f'{{"id":{canonical(r["call_id"])},"result":{r["payload"]}}}')
                    continue
                good = r["name"] in schemas and valid(json.loads(r["payload"]), schemas[r["name"]])
                linked.append(r["result"] is not None)
                fits.append(good)
                # the payloads are canonical already, and the keys below are in order
                text.append(f'{{"arguments":{r["payload"]},"depends_on":{canonical(r["deps"])},"id":{canonical(r["call_id"])},"name":{canonical(r["name"])},"result":{r["result"] or "null"},"valid":{canonical(good)}}}')
            keep = [batch[c] for c in ("conv_id", "turn", "idx", "kind", "level")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(linked, pa.bool_()), pa.array(fits, pa.bool_()), pa.array(text, pa.string())], names=["conv_id", "turn", "idx", "kind", "level", "linked", "valid", "json"])

    return out.mapInArrow(write, "conv_id long, turn long, idx int, kind string, level int, linked boolean, valid boolean, json string")
