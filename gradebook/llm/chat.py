"""Chat formatting: tool calls are linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.operators.positions import number_within
from gradebook.sources.checkpoints import checkpointed, written_once

#: tool: {field: (type, required)}; types are string, integer, number, boolean, array and object.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def chat_messages(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """Order and serialise the messages of conversations.

    ``messages``: conv_id, turn, role, text, call_id, tool, arguments (JSON text), after. A row with a tool is a call; a row with a
    call_id but no tool is a result; others are plain. Calls and results meet in a hash join on (conv_id, call_id). ``after``
    names the call whose result a call needs. Order within a conversation: a message stands at its turn, a result right after its
    call, and a call not before the calls it depends on; the chains are followed by pointer doubling.

    One row per message: conv_id, position (1 ...), turn, role, kind (plain, call, result), call_id, linked (a call with a result, a result with a
    call), errors (array: invalid JSON, unknown tool, missing, mistyped and unknown arguments, repeated
    call, missing or circular dependency), json (keys sorted, no blanks, nulls left out; arguments canonical as well).

    Of calls that share an id in a conversation the first by turn is meant, the others are reported. Repeated rows stay, each
    with its own position. Nulls sort last; rows without conv_id form one conversation. An empty table gives no rows.
    Long conversations are ordered by several tasks; no conversation is gathered into one row.
    """
    key = F.xxhash64("conv_id", F.isnull("conv_id"))
    rows = messages.select(
        "conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(2**62)).alias("at"), "turn", "role", "text", "call_id", "tool", "arguments", "after",
        key.alias("chat"), F.when(F.col("tool").isNotNull(), "call").when(F.col("call_id").isNotNull(), "result").otherwise("plain").alias("kind"))
    first = F.struct("at", F.xxhash64("tool", "arguments", "text", "after").alias("hash"), "after")
    calls = written_once(
        rows.where("kind = 'call' AND call_id IS NOT NULL").groupBy("chat", "call_id").agg(F.min(first).alias("f"))
        .select("chat", "call_id", F.col("f.at").alias("call_at"), F.col("f.hash").alias("call_hash"), F.col("f.after").alias("call_after")), "calls")
    answered = rows.where("kind = 'result'").select("chat", "call_id").distinct().withColumn("answered", F.lit(True))
    placed = _placed(calls)
    linked = rows.join(placed.join(answered, ["chat", "call_id"], "left"), ["chat", "call_id"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    hash_ = F.xxhash64("tool", "arguments", "text", "after")
    meant = call & (F.col("at") == F.col("call_at")) & (F.col("call_hash") == hash_)
    known = F.col("call_at").isNotNull()
    place = F.when(meant | (result & known), F.col("start")).otherwise(F.col("at"))
    depth = F.when(meant | (result & known), F.col("depth") * 2 + F.when(result, 1).otherwise(0)).otherwise(0)
    judged = linked.withColumns({
        "start": place, "depth": depth, "sub": F.when(result & known, F.col("call_id")),
        "linked": F.when(call, meant & F.coalesce("answered", F.lit(False))).when(result, known).otherwise(False),
        "errors": F.when(call, F.array_compact(F.concat(_argument_errors(schemas), F.array(
            F.when(F.col("call_id").isNotNull() & ~meant, F.lit("repeated call")), F.when(meant, F.col("trouble")))))).otherwise(F.array().cast("array<string>")),
    })
    unique = [F.col("start"), F.col("depth"), F.col("call_id"), F.col("at"), F.col("role"), F.xxhash64("text", "tool", "arguments", "after")]
    ordered = number_within(judged.select(
        "conv_id", "chat", "start", "depth", "at", "turn", "role", "text", "kind", "call_id", "tool", "arguments", "after", "linked", "errors"), "chat", unique, "position")
    json = F.to_json(F.struct(
        F.expr("try_parse_json(arguments)").alias("arguments"), "call_id", F.col("text").alias("content"), "role", F.col("tool").alias("tool")))
    return ordered.select("conv_id", "position", "turn", "role", "kind", "call_id", "linked", "errors", json.alias("json"))


def _placed(calls: DataFrame) -> DataFrame:
    """(chat, call_id, call_at, call_hash, start, depth, trouble): where calls stand once their dependencies are respected.

    ``start`` is the latest turn on the chain of dependencies, ``depth`` the number of calls before it on the chain. Each
    round doubles the stretch of the chain that has been looked at; chains that are longer than there are calls are circles.
    """
    state = calls.select(
        "chat", "call_id", "call_at", "call_hash", F.col("call_at").alias("start"), F.lit(0).cast("bigint").alias("depth"),
        F.col("call_after").alias("next"), F.lit(None).cast("string").alias("trouble"))
    state = checkpointed(state)
    reach, most = 1, calls.groupBy("chat").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first().n
    while reach <= 2 * most and state.where("next IS NOT NULL").limit(1).count():
        ahead = state.select(
            "chat", F.col("call_id").alias("next"), F.col("start").alias("next_start"), F.col("depth").alias("next_depth"), F.col("next").alias("next_next"),
            F.lit(True).alias("found"))
        state = checkpointed(
            state.join(ahead, ["chat", "next"], "left").select(
                "chat", "call_id", "call_at", "call_hash", F.greatest("start", "next_start").alias("start"),
                F.when(F.col("found"), F.col("depth") + 1 + F.col("next_depth")).otherwise(F.col("depth")).alias("depth"),
                F.col("next_next").alias("next"),
                F.when(F.col("next").isNotNull() & F.col("found").isNull(), F.lit("missing dependency")).otherwise(F.col("trouble")).alias("trouble")))
        reach *= 2
    circle = F.col("next").isNotNull()
    return state.select(
        "chat", "call_id", "call_at", "call_hash", F.when(circle, F.col("call_at")).otherwise(F.col("start")).alias("start"),
        F.when(circle, F.lit(0)).otherwise(F.col("depth")).alias("depth"),
        F.when(circle, F.lit("circular dependency")).otherwise(F.col("trouble")).alias("trouble"))


def _argument_errors(schemas: Schemas) -> Column:
    """What is wrong with ``arguments`` by the schema of ``tool``."""
    value = F.expr("try_parse_json(arguments)")
    kind = F.coalesce(F.expr("schema_of_variant(try_parse_json(arguments))"), F.lit(""))
    names = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    errors = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (type_, required) in fields.items():
            has = F.array_contains(names, field)
            found = F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")), F.lit("VOID"))
            checks.append(F.when(has & ~found.rlike(f"^(?:{_TYPES[type_]})$"), F.lit(f"mistyped {field}")))
            if required:
                checks.append(F.when(~has, F.lit(f"missing {field}")))
        unknown = F.transform(F.array_except(names, F.array(*map(F.lit, fields))), lambda n: F.concat(F.lit("unknown "), n))
        errors = F.when(F.col("tool") == tool, F.concat(F.array(*checks), F.sort_array(unknown))).otherwise(errors)
    return F.when(F.col("arguments").isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("invalid JSON"))).otherwise(errors)
