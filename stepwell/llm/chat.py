"""Chat formatting with linked tool calls.

Input rows are messages: conversation, turn, role, text.  An assistant's text may be a
JSON object with ``tool_calls`` (a list of ``{"id", "name", "arguments"}``, arguments an
object or its JSON text, and optionally ``"after"``, ids of calls whose results it needs)
and ``content``; a tool's text may be an object with ``tool_call_id`` and ``content``.
Any other text is plain content.

* Calls and results are joined by (conversation, identifier), a hash join.
* Order: a result comes after its call, and a call after the results that it names in
  ``after``.  Places are (turn, step): a message that would come too early moves to its
  cause's turn, with a larger step.  Causes are followed by joins to the end of the longest
  chain, in the conversations where a message comes no later than its cause: messages with
  one cause by doubling, those with several in one round a link between such messages.
  What peeling from either side leaves is on a cycle, or between two, and is marked; there
  only links that go forward by (turn, seq) count.  No conversation is ever gathered: each
  message is one row, and sorting by (conversation, turn_at, step, turn, seq) gives the
  formatted order.
* Arguments are checked against the schemas given by tool name: a subset of JSON Schema
  (type, required, properties, items, enum, additionalProperties, minimum, maximum).
* Each message is serialised as canonical JSON: sorted keys, no white space, UTF-8.

Nulls and edges: a null role becomes "user" and a null text "".  A null conversation or
turn is kept; null turns sort first.  A result without its call, and a call without a
result, are marked ``orphan`` and ``unanswered``.  Of calls with one id in a conversation
the first (by turn) is the one that results link to, the others are marked ``repeated``.
Repeated rows are messages of their own.  Text that isn't JSON, or isn't such an object,
is plain content.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.llm import tables as S

_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema, as paths with reasons."""
    out = []
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values allowed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind in _KINDS and isinstance(value, _KINDS[kind])


def _object(text: str | None) -> dict | None:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _arguments(call: dict) -> Any:
    given = call.get("arguments", {})
    if isinstance(given, str):
        try:
            return json.loads(given)
        except (ValueError, RecursionError):
            return given
    return given


def parse(role: str, text: str | None, schemas: dict[str, dict]) -> dict:
    """A message's canonical JSON, the ids of its calls with what they need, and its result's id."""
    message: dict[str, Any] = {"role": role, "content": text or ""}
    found, calls, wrong, result = _object(text), [], [], None
    if found and role == "assistant" and isinstance(found.get("tool_calls"), list) and all(isinstance(c, dict) and "id" in c for c in found["tool_calls"]):
        message["content"] = found.get("content") or ""
        message["tool_calls"] = []
        for c in found["tool_calls"]:
            name, arguments = str(c.get("name", "")), _arguments(c)
            message["tool_calls"].append({"id": str(c["id"]), "name": name, "arguments": arguments})
            after = c.get("after") or []
            calls.append((str(c["id"]), [str(x) for x in after] if isinstance(after, list) else []))
            if name not in schemas:
                wrong.append(f"{c['id']}: no schema for {name!r}")
            else:
                wrong += [f"{c['id']}: {v}" for v in violations(arguments, schemas[name])]
    elif found and role == "tool" and "tool_call_id" in found:
        result = str(found["tool_call_id"])
        content = found.get("content", "")
        message["content"] = content if isinstance(content, str) else canonical(content)
        message["tool_call_id"] = result
    return {"json": canonical(message), "calls": calls, "result": result, "wrong": wrong}


_PARSED = "conv long, turn long, seq long, role string, json string, calls array<struct<id:string,after:array<string>>>, result string, wrong array<string>"


def _parse(schemas: dict[str, dict]):
    kinds = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("json", pa.string()), ("calls", pa.list_(pa.struct([("id", pa.string()), ("after", pa.list_(pa.string()))]))), ("result", pa.string()), ("wrong", pa.list_(pa.string()))])

    def run(batches):
        numbering = S.serial()
        for b in batches:
            roles = [r if r is not None else "user" for r in b.column(2).to_pylist()]
            found = [parse(r, t, schemas) for r, t in zip(roles, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([next(numbering) for _ in found], pa.int64()), pa.array(roles, pa.string()), pa.array([f["json"] for f in found], pa.string()), pa.array([[{"id": i, "after": a} for i, a in f["calls"]] for f in found], kinds.field("calls").type), pa.array([f["result"] for f in found], pa.string()), pa.array([f["wrong"] for f in found], kinds.field("wrong").type)], schema=kinds)

    return run


def link(df: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, turn_at, step, seq, role, json, n_calls, link (its call's seq), orphan, unanswered, repeated, cyclic, errors."""
    S.tune(df.sparkSession)
    named = lambda c, kind: F.col(f"`{c}`").cast(kind)
    four = df.select(named(conv_col, "long").alias("conv"), named(turn_col, "long").alias("turn"), named(role_col, "string").alias("role"), named(text_col, "string").alias("text"))
    parsed = S.save(four.mapInArrow(_parse(schemas or {}), _PARSED), "messages")
    none = F.col("turn").isNull()
    calls = parsed.select("conv", "turn", "seq", F.explode("calls").alias("c")).select("conv", "turn", "seq", F.col("c.id").alias("call"), F.col("c.after").alias("after"))
    first = W.partitionBy("conv", "call").orderBy(none.desc(), "turn", "seq")
    calls = S.save(calls.withColumn("nth", F.row_number().over(first)), "calls")
    owner = calls.filter("nth = 1").select(F.col("conv").alias("oc"), F.col("call").alias("oid"), F.col("seq").alias("call_seq"))
    results = parsed.filter("result is not null").select("conv", "seq", "result")
    linked = S.save(results.join(owner, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("result") == F.col("oid")), "left").select("conv", "result", "seq", "call_seq"), "results")
    # causes: a result's call, and for a call the results of those it comes after
    needs = calls.select(F.col("conv").alias("nc"), "seq", F.explode("after").alias("need"))
    answered = linked.filter("call_seq is not null").select("conv", "result", F.col("seq").alias("cause"))
    causes = linked.filter("call_seq is not null").select("seq", F.col("call_seq").alias("cause"))
    causes = causes.union(needs.join(answered, F.col("nc").eqNullSafe(F.col("conv")) & (F.col("need") == F.col("result"))).select("seq", "cause")).filter("seq != cause").distinct()
    causes = S.save(causes, "causes")
    places = _places(parsed.select("conv", "seq", "turn"), causes)
    per = calls.groupBy("seq").agg(F.max(F.when(F.col("nth") > 1, True).otherwise(False)).alias("repeated"))
    open_calls = calls.filter("nth = 1").select("conv", "call", F.col("seq").alias("s")).join(linked.select(F.col("conv").alias("lc"), "result").distinct(), F.col("conv").eqNullSafe(F.col("lc")) & (F.col("call") == F.col("result")), "left_anti")
    open_calls = open_calls.groupBy(F.col("s").alias("seq")).agg(F.lit(True).alias("unanswered"))
    out = parsed.join(places, "seq", "left").join(per, "seq", "left").join(open_calls, "seq", "left").join(linked.select("seq", "call_seq"), "seq", "left")
    no = F.lit(False)
    return out.select(
        "conv", "turn", F.coalesce("turn_at", "turn").alias("turn_at"), F.coalesce("step", F.lit(0)).alias("step"), "seq", "role", "json", F.size("calls").alias("n_calls"),
        F.col("call_seq").alias("link"), (F.col("result").isNotNull() & F.col("call_seq").isNull()).alias("orphan"), F.coalesce("unanswered", no).alias("unanswered"),
        F.coalesce("repeated", no).alias("repeated"), F.coalesce("cyclic", no).alias("cyclic"), F.col("wrong").alias("errors"),
    )


_UNKNOWN = -(1 << 62)


def _places(messages: DataFrame, causes: DataFrame) -> DataFrame:
    """(seq, turn_at, step, cyclic) of messages with causes: the largest place among the causes', and a step more."""
    own = messages.select("conv", "seq", F.coalesce("turn", F.lit(_UNKNOWN)).alias("t"))
    edges = causes.join(own, "seq").join(own.select(F.col("seq").alias("cause"), F.col("t").alias("ct")), "cause")
    edges = S.save(edges.select("conv", "seq", "t", "cause", "ct"), "links")
    late = edges.filter("ct >= t").select(F.col("conv").alias("lc")).distinct()  # elsewhere nothing moves
    edges = S.save(edges.join(late, F.col("conv").eqNullSafe(F.col("lc")), "left_semi").drop("conv"), "links")
    if edges.isEmpty():
        return messages.limit(0).select("seq", F.col("turn").alias("turn_at"), F.lit(0).alias("step"), F.lit(False).alias("cyclic"))
    nodes = S.save(edges.select("seq", "t").union(edges.select(F.col("cause").alias("seq"), F.col("ct").alias("t"))).distinct(), "nodes")
    places = _settled(nodes, edges)
    left = S.save(nodes.join(places, "seq", "left_anti"), "left")
    cyclic = left.select("seq", F.lit(True).alias("cyclic"))
    if not left.isEmpty():  # on a cycle or behind one: peeled from the other side too
        inner = edges.join(left.select("seq"), "seq", "left_semi").join(left.select(F.col("seq").alias("cause")), "cause", "left_semi")
        behind = _settled(left, inner.select(F.col("cause").alias("seq"), F.col("seq").alias("cause")))
        core = S.save(left.join(behind, "seq", "left_anti").select("seq"), "core")
        cyclic = core.withColumn("cyclic", F.lit(True))
        within = edges.join(core, "seq", "left_semi").join(core.select(F.col("seq").alias("cause")), "cause", "left_semi")
        cut = within.filter("ct > t or (ct = t and cause > seq)").select("seq", "cause")
        places = _settled(nodes, S.save(edges.join(cut, ["seq", "cause"], "left_anti"), "links"))
    known = F.when(F.col("turn_at") != _UNKNOWN, F.col("turn_at")).alias("turn_at")
    return places.join(cyclic, "seq", "left").select("seq", known, F.col("step").cast("int").alias("step"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def _settled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, turn_at, step) of the nodes (seq, t) that no cycle leads to, by links (seq, cause).

    A node with one cause has a place of the form max(own, place of `p` + k steps); such forms are
    composed until `p` is a node without causes or with several.  Those with several are settled
    once all their causes are.
    """
    n = nodes.count()
    degrees = edges.groupBy("seq").agg(F.count("*").alias("n"), F.min("cause").alias("p"))
    of = S.save(nodes.join(degrees, "seq", "left").select("seq", "t", "p", F.coalesce("n", F.lit(0)).alias("n")), "degrees")
    place = lambda turn, step: F.struct(turn.alias("turn_at"), step.alias("step"))
    later = lambda x, k: place(x["turn_at"], x["step"] + k)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    chains = S.save(of.filter("n = 1").select("seq", "p", place(F.col("t"), zero).alias("own"), one.alias("k"), F.lit(True).alias("open")), "chains")
    while not chains.filter(F.col("open") & (F.col("k") <= n)).isEmpty():  # a chain of more links than nodes ends in a cycle
        theirs = chains.select(F.col("seq").alias("p"), F.col("p").alias("p2"), F.col("own").alias("own2"), F.col("k").alias("k2"))
        more = F.col("p2").isNotNull() & (F.col("k") <= n)
        chains = S.save(
            chains.join(theirs, "p", "left").select(
                "seq", F.when(more, F.col("p2")).otherwise(F.col("p")).alias("p"), F.when(more, F.greatest("own", later(F.col("own2"), F.col("k")))).otherwise(F.col("own")).alias("own"),
                F.when(more, F.col("k") + F.col("k2")).otherwise(F.col("k")).alias("k"), F.col("p2").isNotNull().alias("open"),
            ), "chains",
        )
    new = S.save(of.filter("n = 0").select("seq", place(F.col("t"), zero).alias("place")), "settled")
    found = [new]
    several = edges.select("seq", "cause").join(of.filter("n > 1").select("seq", "t"), "seq")
    forms = chains.select(F.col("seq").alias("cause"), F.col("p").alias("p1"), F.col("own").alias("own1"), F.col("k").alias("k1"))
    several = several.join(forms, "cause", "left").select("seq", "t", F.coalesce("p1", "cause").alias("p"), F.col("own1").alias("own"), F.coalesce("k1", zero).alias("k"), F.lit(None).cast(new.schema["place"].dataType).alias("place"))
    several = S.save(several, "several")
    while not several.isEmpty() and not new.isEmpty():
        theirs = new.select(F.col("seq").alias("p"), F.col("place").alias("theirs"))
        reached = F.when(F.col("theirs").isNotNull(), later(F.greatest("own", later(F.col("theirs"), F.col("k"))), 1))
        several = several.join(theirs, "p", "left").select("seq", "t", "p", "own", "k", F.coalesce("place", reached).alias("place"))
        several = S.save(several.withColumn("all", F.count("place").over(W.partitionBy("seq")) == F.count("*").over(W.partitionBy("seq"))), "several")
        new = S.save(several.filter("all").groupBy("seq").agg(F.greatest(place(F.first("t"), zero), F.max("place")).alias("place")), "settled")
        several = several.filter("not all").drop("all")
        found.append(new)
    known = S.save(functools.reduce(DataFrame.union, found), "settled")
    ends = chains.join(known.select(F.col("seq").alias("p"), F.col("place").alias("theirs")), "p")
    ends = ends.select("seq", F.greatest("own", later(F.col("theirs"), F.col("k"))).alias("place"))
    return S.save(known.union(ends).select("seq", "place.turn_at", "place.step"), "places")
