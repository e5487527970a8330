"""Tools told and read back: requests without tools, without messages, and with what isn't a tool."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import generate as G

LOOK = '{"type": "function", "function": {"name": "look"}}'
CALL = '<tool_call>{"name": "look", "arguments": {"a": 1}}</tool_call>'
MESSAGES = "array<struct<role: string, content: string, calls: array<struct<id: string, name: string, arguments: string>>>>"


def test_answers_are_read_only_for_requests_with_tools(spark):
    rows = [
        (1, f"so {CALL}", None, [LOOK], None), (2, f"so {CALL}", "<think>", None, "auto"), (3, f"so {CALL}", None, [LOOK], "none"), (4, f"so {CALL}", None, [], None), (5, None, "<think>", [LOOK], "auto"),
        (6, f"so {CALL}", "<think>", ['{"name": "keep"}'], "auto"), (7, f"{CALL} and {CALL}", None, ["no tool", LOOK], "required"),
    ]
    asked = spark.createDataFrame(rows, "request long, prompt string, prefix string, tools array<string>, choice string").withColumn("style", F.lit(None).cast("string"))
    got = {r["request"]: (r["content"], len(r["calls"]), r["finish_reason"]) for r in G.executed(asked, lambda p: p).collect()}
    whole = (f"so {CALL}", 0, "stop")
    assert got == {
        1: ("so", 1, "tool_calls"), 2: (f"<think>so {CALL}", 0, "stop"), 3: whole, 4: whole, 5: ("<think>", 0, "stop"), 6: (f"<think>so {CALL}", 0, "stop"), 7: ("and", 2, "tool_calls"),
    }


def test_call_ids_agree_on_every_run(spark):
    asked = spark.createDataFrame([(9, f"{CALL}{CALL}", None, [LOOK], None, None)], "request long, prompt string, prefix string, tools array<string>, choice string, style string")
    first, again = (G.executed(asked.repartition(n), lambda p: p).collect()[0]["calls"] for n in (1, 3))
    assert first == again and first[0]["id"] != first[1]["id"]


def test_definitions_leave_out_what_is_no_object(spark):
    rows = [(1, [LOOK, "3", "{", '{"name": "é", "description": "d", "parameters": {"p": [1]}}']), (2, []), (3, None)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id int, tools array<string>").select("id", G.tool_definitions("tools")).collect()}
    assert got == {1: '[{"name": "look", "description": "", "parameters": {}}, {"name": "é", "description": "d", "parameters": {"p": [1]}}]', 2: "[]", 3: "[]"}


def test_tools_go_to_the_first_message(spark):
    call = [("c1", "look", '{"a": 1}'), ("c2", "keep", "{}")]
    rows = [(1, [], "none"), (2, None, "auto"), (3, [("user", "hi", None), ("assistant", "", call), ("tool", "found", None), ("assistant", "done", call)], "auto"), (4, [("system", None, None), ("user", "hi", None)], "none"), (5, [("user", "hi", [])], "none")]
    asked = spark.createDataFrame(rows, f"id int, m {MESSAGES}, choice string")
    made = asked.select("id", G.attached_tools(F.col("m"), F.array(F.lit(LOOK)), F.col("choice"), F.lit("look")).alias("m"))
    got = {r["id"]: [(m["role"], m["content"], m["tools"] is not None, m["metadata"]) for m in r["m"]] for r in made.collect()}
    said = "Important: Do NOT call any tools. Respond with text only."
    assert got == {
        1: [("system", said, True, None)], 2: [("system", "", True, None)],
        3: [("user", "hi", True, None), ("assistant", '{"a": 1}', False, "look"), ("observation", "found", False, None), ("assistant", "done", False, "look")],
        4: [("system", f"\n\n{said}", True, None), ("user", "hi", False, None)], 5: [("system", said, False, None), ("user", "hi", True, None)],
    }


def test_tags_stand_behind_the_system_text(spark):
    rows = [(1, [("system", "Be kind.")], "auto"), (2, [("system", None)], "none"), (3, [("user", "hi")], "auto"), (4, [], "auto")]
    asked = spark.createDataFrame(rows, "id int, m array<struct<role: string, content: string>>, choice string")
    made = asked.select("id", G.tagged_tools(F.col("m"), F.array(F.lit('{"name": "look"}')), F.col("choice"), F.lit("look")).alias("m"))
    got = {r["id"]: [(m["role"], m["content"]) for m in r["m"]] for r in made.collect()}
    tags = '<|tool|> [{"name": "look", "description": "", "parameters": {}}] <|/tool|>'
    alone = ("system", f"{G.TOOLS_SYSTEM}\n\n{tags}")
    assert got == {1: [("system", f"Be kind.\n\n{tags}")], 2: [("system", f"Important: Do NOT call any tools. Respond with text only.\n\n{tags}")], 3: [alone, ("user", "hi")], 4: [alone]}
