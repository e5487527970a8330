"""Generation with tools: tools told to the model in three forms, and calls read out of what it answers.

The generator is a column function from prompts to texts (a batched model on a cluster, a stand-in in tests).  Everything else is
expressions; the grammar of calls and the text of tool definitions are Arrow-batched functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import calls as C
from sparkloom.operators.messages import tool_names
from sparkloom.operators.templates import tool_choice_sentence

# The tags around tool definitions, and the system text where a request has none.
TOOLS_OPEN, TOOLS_CLOSE, TOOLS_SYSTEM = "<|tool|>", "<|/tool|>", "You are a helpful assistant with some tools."

#: A message with tools attached.
ATTACHED = "array<struct<role: string, content: string, tools: array<string>, metadata: string>>"


def executed(requests: DataFrame, generate: Callable[[Column], Column]) -> DataFrame:
    """``requests`` (request, prompt, prefix, tools array<string>, choice, style) with content, calls and finish_reason.

    The thinking prefix (null: none) goes before the answer.  Calls of the tools' names are read where there are tools and the choice isn't
    "none"; with a call the reason is tool_calls and the content is the text without its calls, else the whole text.  An answer of
    null is empty."""
    answer = F.concat(F.coalesce("prefix", F.lit("")), F.coalesce(generate(F.col("prompt")), F.lit("")))
    asks = (F.coalesce(F.size("tools"), F.lit(0)) > 0) & (F.coalesce("choice", F.lit("auto")) != "none")
    told = requests.withColumn("__answer", answer).withColumn("__names", F.when(asks, tool_names(F.col("tools"))))
    # the batched functions see the rows of requests without tools as empty texts
    read = told.withColumn("__text", F.when(asks, F.col("__answer")).otherwise(""))
    reads = {"calls": C.tool_calls("request", "__text", "__names", "style"), "__rest": C.text_without_calls("__text", "__names", "style")}
    rest = read.withColumns(reads)  # at once, so that one worker a task runs both
    called = F.size("calls") > 0
    out = rest.withColumn("content", F.when(called, F.col("__rest")).otherwise(F.col("__answer"))).withColumn("finish_reason", F.when(called, "tool_calls").otherwise("stop"))
    return out.drop("__answer", "__names", "__text", "__rest")


@F.pandas_udf(T.StringType())
def tool_definitions(tools: pd.Series) -> pd.Series:
    """Tool definitions (JSON texts, wrapped or not) as one JSON list of name, description and parameters; what isn't an object is left out."""

    def told(listed) -> str:
        read = [C._loaded(t or "") for t in (listed if listed is not None else ())]
        inner = [t.get("function", t) for t in read if isinstance(t, dict)]
        return json.dumps([{"name": f.get("name", ""), "description": f.get("description", ""), "parameters": f.get("parameters", {})} for f in inner], ensure_ascii=False)

    return tools.map(told)


def _led(messages: Column, content: Callable[[Column], Column], alone: Column) -> Column:
    """``messages`` whose system message at the head has ``content`` of its own; ``alone`` as one where there is none."""
    first = F.try_element_at(messages, F.lit(1))
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    led = F.concat(F.array(first.withField("content", content(F.coalesce(first["content"], F.lit(""))))), rest)
    return F.when(F.coalesce(first["role"] == "system", F.lit(False)), led).otherwise(F.concat(F.array(alone), messages))


def tagged_tools(messages: Column, tools: Column, choice: Column, name: Column) -> Column:
    """array<struct<role, content>> with the tools between tags behind the system text, and what the choice asks before them."""
    sentence = tool_choice_sentence(choice, name)
    between = F.concat(F.when(sentence != "", F.concat(sentence, F.lit("\n\n"))).otherwise(""), F.lit(f"{TOOLS_OPEN} "), tool_definitions(tools), F.lit(f" {TOOLS_CLOSE}"))
    alone = F.struct(F.lit("system").alias("role"), F.concat(F.lit(f"{TOOLS_SYSTEM}\n\n"), between).alias("content"))
    return _led(messages, lambda c: F.when(c != "", F.concat(c, F.lit("\n\n"), between)).otherwise(between), alone)


def attached_tools(messages: Column, tools: Column, choice: Column, name: Column) -> Column:
    """array<struct<role, content, calls>> as ``ATTACHED``, for templates that find the tools as a field of the first message.

    Tool results are observations; a message that calls has its first call's name as metadata and, without a text, its arguments as content.
    What the choice asks goes into the system message, which is put before all others where there is none; no messages make one."""
    sentence = tool_choice_sentence(choice, name)

    def told(m: Column, i: Column) -> Column:
        call = F.when(m["role"] == "assistant", F.try_element_at(m["calls"], F.lit(1)))
        content = F.when(call.isNotNull() & (F.coalesce(m["content"], F.lit("")) == ""), F.coalesce(call["arguments"], F.lit("{}"))).otherwise(m["content"])
        role = F.when(m["role"] == "tool", "observation").otherwise(m["role"])
        return F.struct(role.alias("role"), content.alias("content"), F.when(i == 0, tools).alias("tools"), F.when(call.isNotNull(), F.coalesce(call["name"], F.lit(""))).alias("metadata"))

    row = lambda held: F.struct(F.lit("system").alias("role"), sentence.alias("content"), held.alias("tools"), F.lit(None).cast("string").alias("metadata"))
    made = F.transform(messages, told).cast(ATTACHED)
    asked = _led(made, lambda c: F.concat(c, F.lit("\n\n"), sentence), row(F.lit(None).cast("array<string>")))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(row(tools)).cast(ATTACHED)).when(sentence != "", asked.cast(ATTACHED)).otherwise(made)
