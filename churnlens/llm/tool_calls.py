"""Chat formatting: tool calls linked to their results (DataFrame functions only).

``calls`` (conv_id, call_id, after, name, arguments): ``after`` names the call
whose result this one builds on, or is null; ``arguments`` is JSON text.
``results`` (call_id, seq, content).  Identifiers are joined by hash.

Order.  A call's level is its distance to a call that builds on none, found by
pointer doubling: each round joins every call with its ancestor's ancestor, so a
conversation of any length takes as many rounds as its longest chain has binary
digits, and no conversation is gathered anywhere.  Sorted by level, each call
stands after the one it builds on.  A call in or behind a cycle has no level.

Checks.  Arguments must be a JSON object whose fields have the types of the tool's
schema, with all required ones and, unless the schema says so, no others.

status: ok, unanswered (no result), duplicate (different calls share an
identifier; each has its rows, and calls that build on it build on the smallest by name
and arguments), missing (``after`` names no call),
cycle, unknown_tool, invalid_json, invalid_arguments; orphan for a result without a
call; context for a message that is neither.  The first that holds counts, in the order: orphan, duplicate, cycle,
missing, unknown_tool, invalid_json, invalid_arguments, unanswered, ok.

One row a call and result: conv_id, call_id, level, seq, status, line; line is
canonical JSON: keys sorted, no blanks, nulls written.  Equal rows count once; a null
call_id matches nothing and such a call or result is unanswered or orphan (an orphan
without a call_id keeps its conv_id where ``results`` has one); null or
empty arguments are invalid JSON; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import materialise

#: Tool -> field -> (type, required); the field "*" allows others.
Schemas = dict[str, dict[str, tuple[str, bool]]]
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*"}


def levels(calls: DataFrame) -> DataFrame:
    """call_id and level (null in or behind a cycle) of calls (call_id, after); an ``after`` that names no call is none."""
    ids = calls.select(F.col("call_id").alias("id"))
    at = materialise(
        calls.join(ids, F.col("after") == F.col("id"), "left")
        .select("call_id", F.col("id").alias("anc"), F.when(F.col("id").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    left = -1
    while (now := at.where("anc is not null").count()) not in (0, left):
        left = now
        up = at.select(F.col("call_id").alias("anc"), F.col("anc").alias("anc2"), F.col("level").alias("more"))
        at = materialise(at.join(up, "anc", "left").select(
            "call_id", F.col("anc2").alias("anc"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
    return at.select("call_id", F.when(F.col("anc").isNull(), F.col("level")).alias("level"))


def arguments_status(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """null where the arguments fit the tool's schema, else what is wrong."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    out = F.lit("unknown_tool")
    for tool, fields in schemas.items():
        fits = kind.startswith("OBJECT")
        for field, (type_, required) in fields.items():
            if field != "*":
                # a missing field and a JSON null differ: the first has no variant
                got = F.try_variant_get(value, f"$['{field}']", "variant")
                right = F.schema_of_variant(got).rlike(f"^({_TYPES[type_]})$")
                fits = fits & F.coalesce(right, F.lit(not required))
        if "*" not in fields:
            extra = F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields]).cast("array<string>"))
            fits = fits & (F.coalesce(F.size(extra), F.lit(0)) == 0)
        out = F.when(name.eqNullSafe(F.lit(tool)), F.when(value.isNull(), "invalid_json").when(~fits, "invalid_arguments")).otherwise(out)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, others: DataFrame | None = None) -> DataFrame:
    """Calls with their results, levels, status and canonical JSON; and the messages
    ``others`` (conv_id, seq, content) that are neither, each distinct one with a row of its own."""
    one = materialise(calls.select("conv_id", "call_id", "after", "name", "arguments").distinct(), "calls")
    fields = F.struct("name", "arguments", "after", "conv_id")
    heads = materialise(one.where("call_id is not null").groupBy("call_id").agg(F.min(fields)["after"].alias("after"), F.count(F.lit(1)).alias("n")), "heads")
    parents = levels(heads.select("call_id", "after")).withColumnsRenamed({"call_id": "parent", "level": "above"})
    one = one.join(heads.select("call_id", "n"), "call_id", "left").join(parents, F.col("after") == F.col("parent"), "left")
    one = one.withColumn("level", F.when(F.col("parent").isNull(), 0).otherwise(F.col("above") + 1).cast("long"))
    whose = F.col("conv_id") if "conv_id" in results.columns else F.lit(None)
    answers = results.select(F.col("call_id").alias("answers"), "seq", "content", F.when(F.col("call_id").isNull(), whose).alias("whose")).distinct()
    # rows without an identifier match nothing: they stay out of the join, where they would meet in one task
    one = one.withColumn("is_call", F.lit(True))
    both = (one.where("call_id is not null").join(answers.where("answers is not null"), F.col("call_id") == F.col("answers"), "full")
            .unionByName(one.where("call_id is null"), allowMissingColumns=True)
            .unionByName(answers.where("answers is null"), allowMissingColumns=True))
    wrong = arguments_status(F.col("name"), F.col("arguments"), schemas)
    status = (F.when(F.col("is_call").isNull(), "orphan").when(F.col("n") > 1, "duplicate")
              .when(F.col("level").isNull(), "cycle")
              .when(F.col("after").isNotNull() & F.col("parent").isNull(), "missing")
              .otherwise(F.coalesce(wrong, F.when(F.col("content").isNull(), "unanswered").otherwise("ok"))))
    rows = both.select(F.coalesce("conv_id", "whose").alias("conv_id"), F.coalesce("call_id", "answers").alias("call_id"), "level",
                       "seq", status.alias("status"), "name", "after", "content", F.try_parse_json("arguments").alias("arguments"))
    if others is not None:
        rows = rows.unionByName(others.select("conv_id", "seq", "content", F.lit("context").alias("status")).distinct(), allowMissingColumns=True)
    line = F.to_json(F.struct("after", "arguments", "call_id", F.col("content"), "level", "name", "status"), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "call_id", "level", "seq", "status", line.alias("line"))


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text): a user
    turn asks the tool ``answer``, building on the question two turns before; an
    assistant turn is the result of the call of the turn before.  Without a conv_id or
    turn both have no identifier.  Turns of other roles are neither (``other_turns``)."""
    def name(back: int) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))

    asked = messages.where("role = 'user'")
    parent = asked.select(name(0).alias("parent")).distinct()
    calls = (asked.select("conv_id", name(0).alias("call_id"), name(2).alias("before"), F.lit("answer").alias("name"),
                          F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"}).alias("arguments"))
             .join(parent, F.col("before") == F.col("parent"), "left")
             .select("conv_id", "call_id", F.col("parent").alias("after"), "name", "arguments"))
    results = messages.where("role = 'assistant'").select(
        "conv_id", name(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


def other_turns(messages: DataFrame) -> DataFrame:
    """Turns of plain conversations that are neither calls nor results: system messages, unknown and missing roles."""
    return messages.where("role is null or role not in ('user', 'assistant')").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("content"))
