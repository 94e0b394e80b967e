"""Chat formatting: tool calls linked with their results.

Calls and results are gathered per conversation and identifier, hash-joined,
put in topological order of the calls they depend on, checked against the
tools' schemas and written as canonical JSON (sorted keys, no blanks, UTF-8).

Chains of calls with one prerequisite each are followed by pointer doubling,
so that a conversation of any length takes a logarithmic number of rounds;
calls with several are ordered level by level.  All joins are by conversation
and identifier, so a long conversation is not one task's.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.runtime import stored, stored_map, written

#: What the operator reads.
CALLS = "conv_id, turn long, call_id string, name string, arguments string (JSON), after array<string>"
RESULTS = "conv_id, turn long, call_id string, content string"

_MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string, content string"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``(conv_id, turn, role, text)`` messages whose
    texts are JSON: assistants' ``tool_calls`` and tools' ``tool_call_id``."""
    parsed = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.from_json("text", _MESSAGE).alias("m"))
    calls = parsed.where("role = 'assistant' and m.tool_calls is not null").select("conv_id", "turn", F.inline("m.tool_calls"))
    calls = calls.select("conv_id", "turn", F.col("id").alias("call_id"), "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    results = parsed.where("role = 'tool'").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    return calls, results


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks a JSON schema (types, required, properties,
    additionalProperties, items, enum, minimum, maximum, minLength, maxLength)."""
    kind = schema.get("type")
    if kind is not None and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{name}: missing" for name in schema.get("required", ()) if name not in value]
        for name in sorted(value):
            if name in known:
                found += violations(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{name}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            found += violations(item, schema["items"], f"{at}[{k}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            found.append(f"{at}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{at}: range")
    return found


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


def check_arguments(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """(parsed arguments or None, violations)."""
    try:
        value = json.loads(arguments, parse_constant=_refuse) if arguments is not None else None
    except (ValueError, RecursionError):
        return None, ["$: no JSON"]
    if arguments is None:
        return None, ["$: missing"]
    if name not in schemas:
        return value, ["unknown tool"]
    return value, violations(value, schemas[name])


def _chained(chain: DataFrame) -> DataFrame:
    """``(conv_id, call_id, up, dist, done)`` of ``(conv_id, call_id, up)``:
    for each call with one prerequisite the first call up its chain that has
    none or several, and the steps to it; not ``done`` on cycles."""
    known = chain.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("goes_on"))
    state = stored(chain.join(known, ["conv_id", "up"], "left").select("conv_id", "call_id", "up", F.lit(1).alias("dist"), F.col("goes_on").isNull().alias("done")), "chains")
    left = None
    while True:  # the steps that are known double in each round
        waiting = state.frame.where("not done").count()
        if waiting in (0, left):
            return state.frame
        left = waiting
        ahead = state.frame.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("done").alias("arrived"))
        moved = state.frame.where("not done").join(ahead, ["conv_id", "up"]).select("conv_id", "call_id", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("arrived").alias("done"))
        following = stored(state.frame.where("done").unionByName(moved), "chains")
        state.drop()
        state = following


def _levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)``: 0 without prerequisites, else one more
    than the highest; null on cycles and behind them."""
    both = ["conv_id", "call_id"]
    nodes = calls.select(both)
    needs = calls.select(*both, F.explode(F.array_distinct("call.after")).alias("needs")).where("needs is not null")
    edges = stored(needs.join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"]), "edges")
    if not edges.rows:
        return nodes.withColumn("level", F.lit(0))
    degrees = written(edges.frame.groupBy(both).agg(F.count("*").alias("n"), F.min("needs").alias("up")), "degrees")
    chains = _chained(degrees.where("n = 1").select(*both, "up"))
    roots = nodes.join(degrees.select(both), both, "left_anti").withColumn("level", F.lit(0))
    # Calls with several prerequisites wait for the ends of these chains.
    forks = edges.frame.join(degrees.where("n > 1").select(both), both, "left_semi")
    ends = chains.select("conv_id", F.col("call_id").alias("needs"), "up", "dist", "done")
    waiting = stored(forks.join(ends, ["conv_id", "needs"], "left").select(*both, F.coalesce("up", "needs").alias("up"), F.coalesce("dist", F.lit(0)).alias("dist"), F.coalesce("done", F.lit(True)).alias("done")), "forks")
    known = roots
    if waiting.rows:
        known = written(roots, "levels")
    while waiting.rows:  # one round for each level of calls with several
        base = known.select("conv_id", F.col("call_id").alias("up"), "level")
        met = waiting.frame.join(base, ["conv_id", "up"], "left").withColumn("open", F.col("level").isNull() | ~F.col("done"))
        judged = met.groupBy(both).agg(F.max("open").alias("open"), (F.max(F.col("level") + F.col("dist")) + 1).alias("level"))
        ready = stored(judged.where("not open").select(*both, "level"), "ready")
        if not ready.rows:
            break
        known = known.unionByName(ready.frame)
        waiting = stored(waiting.frame.join(ready.frame.select(both), both, "left_anti"), "forks")
    base = known.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"))
    followed = chains.where("done").join(base, ["conv_id", "up"]).select(*both, (F.col("base") + F.col("dist")).alias("level"))
    return nodes.join(known.unionByName(followed), both, "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per conversation and identifier, as a written table:

    ``(conv_id, call_id, call_turn, result_turn, name, status, level, valid,
    errors array<string>, n_calls, n_results, json)``.

    ``status`` is linked, unanswered (no result), orphan (no call), early (the
    result is before its call) or cyclic.  ``level`` orders the calls of a
    conversation topologically: sort by (level, call_turn, call_id).

    * rows without an identifier or conversation are no calls and no results;
    * of repeated identifiers the earliest call and result count, by turn and
      then by content; ``n_calls`` and ``n_results`` tell how many there were;
      rows are counted before the join, so repeats never multiply;
    * arguments that are null or no JSON are invalid and serialised as null;
      a null content is serialised as null; long texts are kept whole;
    * prerequisites that name no call of the conversation are ignored; other
      columns are ignored, whatever their names; empty tables are no error.
    """
    known = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    first = calls.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").cast("long").alias("turn"), "name", "arguments", "after")).alias("call"), F.count("*").alias("n_calls"))
    first = written(first, "calls")
    answers = results.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").cast("long").alias("turn"), "content")).alias("result"), F.count("*").alias("n_results"))
    ordered = first.join(_levels(first), ["conv_id", "call_id"])
    linked = ordered.hint("shuffle_hash").join(answers, ["conv_id", "call_id"], "full")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("level").isNull(), "cyclic").when(F.col("result").isNull(), "unanswered").when(F.col("result.turn") < F.col("call.turn"), "early").otherwise("linked")
    rows = linked.select(
        "conv_id",
        "call_id",
        F.col("call.turn").alias("call_turn"),
        F.col("result.turn").alias("result_turn"),
        F.col("call.name").alias("name"),
        status.alias("status"),
        "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("call.arguments").alias("arguments"),
        F.col("result.content").alias("content"),
    )

    def run(batches):
        for batch in batches:
            valid, errors, texts = [], [], []
            table = {name: batch.column(name).to_pylist() for name in ("call_id", "name", "status", "arguments", "content")}
            for ident, name, state, arguments, content in zip(*table.values(), strict=True):
                value, found = (None, []) if state == "orphan" else check_arguments(name, arguments, schemas)
                valid.append(not found and state != "orphan")
                errors.append(found)
                texts.append(canonical({"arguments": value, "id": ident, "name": name, "result": content}))
            columns = [x for x in batch.schema.names if x not in ("arguments", "content")]
            yield pa.record_batch([*(batch.column(x) for x in columns), pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*columns, "valid", "errors", "json"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return stored_map(rows, run, f"conv_id {kind}, call_id string, call_turn long, result_turn long, name string, status string, level int, n_calls long, n_results long, valid boolean, errors array<string>, json string", "linked").frame


#: The schemas of the calls that :func:`exchanges` makes of plain turns.
EXCHANGE_SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    },
    "setup": {
        "type": "object",
        "properties": {"instruction": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["instruction", "turn"],
        "additionalProperties": False,
    },
}


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results.

    Each user turn calls for a reply, the assistant's next turn is its result;
    a system turn is a call that sets the conversation up.  A call depends on
    the calls among the two turns before it: with the assistant's turns between
    them, a conversation is one chain of calls.  Other roles are neither.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("words"), "text")
    name = lambda turn: F.concat(F.lit("turn-"), turn.cast("string"))
    turn, user = F.col("turn"), F.col("role") == "user"
    arguments = F.when(user, F.to_json(F.struct(F.col("words").alias("prompt"), "turn"))).otherwise(F.to_json(F.struct(F.col("words").alias("instruction"), "turn")))
    calls = rows.where("role in ('user', 'system')").select("conv_id", "turn", name(turn).alias("call_id"), F.when(user, "reply").otherwise("setup").alias("name"), arguments.alias("arguments"), F.array(name(turn - 1), name(turn - 2)).alias("after"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
