"""No call or result vanishes."""

from __future__ import annotations

import json

from churnlens.llm import queries, tool_calls


def test_calls_of_one_identifier_keep_their_rows(spark):
    any_ = {"any": {"*": ("object", False)}}
    calls = [(1, "a", None, "any", '{"x":1}'), (1, "a", "b", "any", '{"x":2}'), (1, "b", None, "any", "{}"), (1, "c", "a", "any", "{}"),
             (1, None, None, "any", "{}"), (1, None, None, "any", '{"x":1}'), (2, "a", None, "any", '{"x":1}')]
    results = [("a", 1, "done"), ("c", 2, "done")]
    rows = tool_calls.link_tool_calls(spark.createDataFrame(calls, "conv_id long, call_id string, after string, name string, arguments string"),
                                      spark.createDataFrame(results, "call_id string, seq long, content string"), any_).collect()
    got = sorted((r["conv_id"], r["call_id"] or "", r["level"], r["seq"] or 0, r["status"], json.dumps(json.loads(r["line"])["arguments"])) for r in rows)
    assert got == sorted([(1, "a", 0, 1, "duplicate", '{"x": 1}'), (1, "a", 1, 1, "duplicate", '{"x": 2}'), (2, "a", 0, 1, "duplicate", '{"x": 1}'),
                          (1, "b", 0, 0, "unanswered", "{}"), (1, "c", 1, 2, "ok", "{}"), (1, "", 0, 0, "unanswered", "{}"), (1, "", 0, 0, "unanswered", '{"x": 1}')])


def test_turns_without_keys_and_twice(spark):
    turns = [(1, 0, "user", "one"), (1, 0, "user", "two"), (1, 1, "assistant", "yes"), (None, 0, "user", "who"), (2, None, "user", "when"),
             (None, 1, "assistant", "me"), (2, None, "assistant", "now"), (3, None, "assistant", "now")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = tool_calls.link_tool_calls(*tool_calls.conversation_calls(df), queries.ANSWER).collect()
    got = sorted(((r["conv_id"], r["call_id"], r["seq"], r["status"], (json.loads(r["line"])["arguments"] or {}).get("prompt")) for r in rows), key=str)
    assert got == sorted([(1, "1:0", 1, "duplicate", "one"), (1, "1:0", 1, "duplicate", "two"), (None, None, None, "unanswered", "who"),
                          (2, None, None, "invalid_arguments", "when"), (None, None, 1, "orphan", None), (2, None, None, "orphan", None),
                          (3, None, None, "orphan", None)], key=str)


def test_turns_of_other_roles_and_rows_without_identifiers(spark):
    """Every message has a row, also without an identifier or a role."""
    turns = ([(i, 0, "system", f"s{i}") for i in range(5)] + [(0, 0, "system", "s0"), (None, None, None, None), (1, 3, "tool", "t")]
             + [(None, k, "user", f"u{k}") for k in range(400)] + [(None, k, "assistant", f"a{k}") for k in range(400)])
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(8)
    out = tool_calls.link_tool_calls(*tool_calls.conversation_calls(df), queries.ANSWER, tool_calls.other_turns(df))
    rows = out.collect()
    assert sum(r["status"] == "context" for r in rows) == 7 and sum(r["status"] == "unanswered" for r in rows) == 400
    assert sum(r["status"] == "orphan" for r in rows) == 400 and len(rows) == 807
    assert json.loads(next(r["line"] for r in rows if r["conv_id"] == 1 and r["status"] == "context" and r["seq"] == 3))["content"] == "t"
