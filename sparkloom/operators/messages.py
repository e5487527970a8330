"""Message algebra over arrays of messages: roles, contents, tool groups, budgets, protocol mappings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as X

#: Tokens that a message costs besides its text, and tokens that no answer may use.
OVERHEAD, MARGIN, FALLBACK = 4, 256, 4096


def role(name: Column) -> Column:
    """Trimmed and lower-cased; developer is system, nothing is user."""
    low = F.lower(X.strip(F.coalesce(name, F.lit(""))))
    return F.when(low == "developer", "system").when(low == "", "user").otherwise(low)


def content_text(blocks: Column) -> Column:
    """Text of content blocks array<struct<type, text>>, one line each; an image is an error."""
    image = F.exists(blocks, lambda b: b["type"] == "image_url")
    texts = F.filter(blocks, lambda b: b["type"].isin("text", "input_text") & (F.coalesce(b["text"], F.lit("")) != ""))
    joined = F.array_join(F.transform(texts, lambda b: b["text"]), "\n")
    return F.when(blocks.isNull(), "").when(image, F.raise_error(F.lit("image content is not supported"))).otherwise(joined)


def normalised(messages: Column) -> Column:
    """Roles and contents in their plain form; empty content beside tool calls is null."""
    return F.transform(
        messages,
        lambda m: m.withField("role", role(m["role"])).withField(
            "content", F.when((F.coalesce(m["content"], F.lit("")) == "") & (F.coalesce(m["calls"], F.lit("")) != ""), F.lit(None).cast("string")).otherwise(F.coalesce(m["content"], F.lit("")))
        ),
    )


def without_thinking(messages: Column) -> Column:
    """Thinking taken out of every string content; messages that are blank then go unless tools hang on them."""
    clean = F.transform(messages, lambda m: F.when(m["content"].isNotNull(), m.withField("content", X.strip_thinking(m["content"]))).otherwise(m))
    tied = lambda m: (F.coalesce(m["calls"], F.lit("")) != "") | (F.coalesce(m["tool_call_id"], F.lit("")) != "")
    return F.filter(clean, lambda m: m["content"].isNull() | (X.strip(m["content"]) != "") | tied(m))


def cost(message: Column) -> Column:
    """Estimated tokens of a message: role, content, calls, name and call id, joined by line feeds."""
    part = lambda c: F.nullif(c, F.lit(""))
    text = F.concat_ws("\n", F.coalesce(message["role"], F.lit("")), message["content"], part(message["calls"]), part(message["name"]), part(message["tool_call_id"]))
    return X.estimate_tokens(text) + OVERHEAD


def tool_groups(turns: DataFrame) -> DataFrame:
    """conv_id, turn, head_turn: an assistant row with calls and the tool rows right after it, by its own turn."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    head = (F.col("role") == "assistant") & (F.coalesce("calls", F.lit("")) != "")
    marked = turns.withColumn("__break", (F.col("role") != "tool").cast("int")).withColumn("__run", F.sum("__break").over(by))
    inside = Window.partitionBy("conv_id", "__run")
    found = marked.withColumn("__head", F.max(F.when(head, F.col("turn"))).over(inside))
    return found.filter("__head IS NOT NULL").select("conv_id", "turn", F.col("__head").alias("head_turn"))


def units(messages: Column) -> Column:
    """The messages as array<struct<open, role, tokens, turns>>: a tool group is one unit, any other message its own.

    A run is a message and the tool rows behind it; it stays one unit where its first message calls.  Runs are slices, so the work is in
    proportion to the messages."""
    head = lambda m: F.coalesce((m["role"] == "assistant") & (F.coalesce(m["calls"], F.lit("")) != ""), F.lit(False))
    tool = lambda m: F.coalesce(m["role"] == "tool", F.lit(False))

    def unit(run: Column) -> Column:
        tokens = F.aggregate(run, F.lit(0), lambda n, m: n + cost(m).cast("int"))
        return F.struct(head(run[0]).alias("open"), run[0]["role"].alias("role"), tokens.alias("tokens"), F.transform(run, lambda m: m["turn"].cast("long")).alias("turns"))

    starts = F.array_compact(F.transform(messages, lambda m, i: F.when((i == 0) | ~tool(m), i)))
    ends = F.slice(F.concat(starts, F.array(F.size(messages))), F.lit(2), F.size(starts))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(messages, a + 1, b - a))
    return F.flatten(F.transform(runs, lambda run: F.when(head(run[0]), F.array(unit(run))).otherwise(F.transform(run, lambda m: unit(F.array(m))))))


def trimmed(messages: Column, budget: Column) -> Column:
    """Turns that stay within ``budget`` tokens, in order.

    System messages and the last user message always stay.  If these alone reach the budget nothing else does; otherwise units are taken from the newest
    on while they fit, and one that doesn't fit is passed over."""
    all_units = units(messages)
    last_user = F.array_max(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["turn"]))
    fixed = lambda u: (u["role"] == "system") | F.coalesce(u["turns"][0] == last_user, F.lit(False))
    base = F.aggregate(F.filter(all_units, fixed), F.lit(0), lambda s, u: s + u["tokens"])
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def take(state: Column, u: Column) -> Column:
        fits = state["used"] + u["tokens"] <= budget - base
        return F.when(fits, F.struct((state["used"] + u["tokens"]).alias("used"), F.concat(state["kept"], u["turns"]).alias("kept"))).otherwise(state)

    always = F.flatten(F.transform(F.filter(all_units, fixed), lambda u: u["turns"]))
    more = F.aggregate(F.reverse(F.filter(all_units, lambda u: ~fixed(u))), start, take)["kept"]
    return F.array_sort(F.when(base >= budget, always).otherwise(F.concat(always, more)))


def reserve(window: Column, max_output: Column) -> Column:
    """Tokens kept for the answer: at most half the window, and a margin."""
    return F.least(F.coalesce(max_output, F.lit(FALLBACK)), F.floor(window / 2)).cast("int") + MARGIN


def drop_oldest(rendered: Column, budget: Column) -> Column:
    """How many of the oldest units have to go until the rest fits, for units whose rendered sizes add up."""
    total = F.aggregate(rendered, F.lit(0), lambda s, x: s + x)
    state = F.struct(total.alias("left"), F.lit(0).alias("gone"))
    step = lambda s, x: F.when(s["left"] > budget, F.struct((s["left"] - x).alias("left"), (s["gone"] + 1).alias("gone"))).otherwise(s)
    return F.aggregate(rendered, state, step)["gone"]


def max_tokens(window: Column, prompt: Column, hardware: Column, client: Column) -> Column:
    """The least of what the window leaves, the hardware's limit and the client's wish; an error if the prompt fills the window."""
    room = F.when(window.isNotNull() & (prompt > 0), F.nullif(F.greatest(window - prompt - MARGIN, F.lit(0)), F.lit(0)))
    full = window.isNotNull() & (prompt > 0) & (prompt >= window)
    least = F.least(room, hardware, client)
    return F.when(full, F.raise_error(F.lit("prompt exceeds the context window"))).otherwise(F.coalesce(F.greatest(least, F.when(least.isNotNull(), F.lit(1))), F.lit(FALLBACK))).cast("int")


def finish_reason(completion: Column, limit: Column) -> Column:
    return F.when((limit > 0) & (completion >= limit), "length").otherwise("stop")


def stop_reason(finish: Column) -> Column:
    """The second protocol's name for a finish reason."""
    return F.when(finish == "length", "max_tokens").when(finish == "tool_calls", "tool_use").otherwise("end_turn")


def tool_choice(kind: Column, name: Column) -> Column:
    """The second protocol's tool choice as the first one's: a word, or the JSON of a named function."""
    named = _function_json(F.struct(name.alias("name")))
    return F.when(kind == "any", "required").when((kind == "tool") & (F.coalesce(name, F.lit("")) != ""), named).otherwise("auto")


def thinking(kind: Column) -> Column:
    return F.when(kind == "enabled", True).when(kind == "disabled", False)


def stops(one: Column, many: Column) -> Column:
    """Stop words of a string or a list; null for none."""
    listed = F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
    kept = F.filter(listed, lambda s: s.isNotNull() & (s != ""))
    return F.when(F.size(kept) > 0, kept)


def context_window(configured: Column, *detected: Column) -> Column:
    """The configured window, else the first positive of the detected ones."""
    positive = [F.when(c > 0, c) for c in detected]
    return F.coalesce(F.when(configured > 0, configured), *positive)


def violations(n: Column, response_format: Column, parallel: Column) -> Column:
    """Names of parameters that a request may not set as it does."""
    bad = F.array(
        F.when(n > 1, "n"), F.when((F.coalesce(response_format, F.lit("text")) != "text") & (response_format != ""), "response_format"), F.when(~parallel, "parallel_tool_calls")
    )
    return F.filter(bad, lambda x: x.isNotNull())


def client_limit(completion: Column, legacy: Column) -> Column:
    return F.coalesce(completion, legacy).cast("int")


def tools_of(tools: Column, functions: Column) -> Column:
    """Tool definitions; legacy function definitions are wrapped where there are no tools.  Both are arrays of JSON texts."""
    wrapped = F.transform(functions, lambda f: F.concat(F.lit('{"type":"function","function":'), f, F.lit("}")))
    return F.when(F.size(tools) > 0, tools).when(F.size(functions) > 0, wrapped)


def legacy_choice(function_call: Column) -> Column:
    """A legacy function_call as a tool choice: auto and none are words, a named one is the JSON of a function."""
    name = F.get_json_object(function_call, "$.name")
    return F.when(function_call.isin("auto", "none"), function_call).when(F.coalesce(name, F.lit("")) != "", _function_json(F.struct(name.alias("name"))))


def _function_json(value: Column) -> Column:
    return F.to_json(F.struct(F.lit("function").alias("type"), value.alias("function")))


def tool_definitions(tools: Column) -> Column:
    """The second protocol's tools array<struct<name, description, schema>> as JSON texts of the first one's; schemas are JSON texts."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.transform(
        tools,
        lambda t: F.concat(
            F.lit('{"type":"function","function":{"name":'), quoted(F.coalesce(t["name"], F.lit(""))), F.lit(',"description":'), quoted(F.coalesce(t["description"], F.lit(""))),
            F.lit(',"parameters":'), F.coalesce(t["schema"], F.lit("{}")), F.lit("}}"),
        ),
    )


def tool_names(tools: Column) -> Column:
    """The different names in tool definitions (JSON texts), wrapped or not."""
    names = F.transform(tools, lambda t: F.coalesce(F.get_json_object(t, "$.function.name"), F.get_json_object(t, "$.name")))
    return F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""))


def system_text(text: Column, blocks: Column | None = None) -> Column:
    """A system field, a text or array<struct<type, text>>, as one text."""
    if blocks is None:
        return F.coalesce(text, F.lit(""))
    listed = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.coalesce(text, F.array_join(F.transform(listed, lambda b: b["text"]), "\n"), F.lit(""))


def request_messages(system: Column, messages: Column, request: Column) -> Column:
    """A whole request of the second protocol as array<struct<role, content, tool_call_id, calls>>.

    ``messages`` is array<struct<turn, role, blocks>>; the system text goes first where there is one."""
    calls = "array<struct<id: string, name: string, arguments: string>>"
    shape = f"array<struct<role: string, content: string, tool_call_id: string, calls: {calls}>>"
    none, empty = F.lit(None).cast("string"), F.array().cast(calls)
    row = lambda who, content, call=none, made=empty: F.struct(who.alias("role"), content.alias("content"), call.alias("tool_call_id"), made.alias("calls"))

    def turn(m: Column) -> Column:
        said = assistant_blocks(m["blocks"], F.concat_ws("|", request.cast("string"), m["turn"].cast("string")))
        users = F.transform(user_blocks(m["blocks"]), lambda u: row(u["role"], u["content"], u["tool_call_id"]))
        return F.when(m["role"] == "assistant", F.array(row(F.lit("assistant"), said["content"], none, said["calls"])).cast(shape)).otherwise(users.cast(shape))

    head = F.when(F.coalesce(system, F.lit("")) != "", F.array(row(F.lit("system"), system)).cast(shape)).otherwise(F.array().cast(shape))
    return F.concat(head, F.flatten(F.transform(messages, turn)))


def ignored_parameters(**given: Column) -> Column:
    """Names of the parameters that are set and play no part, for a warning."""
    return F.filter(F.array(*[F.when(value.isNotNull(), F.lit(name)) for name, value in given.items()]), lambda x: x.isNotNull())


def thinking_flag(requested: Column, configured: Column) -> Column:
    """Whether to think: the request's word, else the model's setting, else no."""
    return F.coalesce(requested, configured, F.lit(False))


def parameter_record(given: Column, known: tuple[str, ...]) -> Column:
    """struct of the known keys of map<string, string> ``given``, and the others as map ``extra``."""
    others = F.map_filter(given, lambda k, v: ~k.isin(*known))
    return F.struct(*[F.try_element_at(given, F.lit(k)).alias(k) for k in known], others.alias("extra"))


def counted_tokens(count) -> object:
    """A token counter from a batched function ``count(texts)``; a text that it fails on counts 0."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        asked = texts.fillna("").tolist()
        try:
            return pd.Series(count(asked))
        except Exception:  # a tokenizer may fail in any way; each text is then tried by itself
            return pd.Series([_or_zero(count, t) for t in asked])

    return run


def _or_zero(count, text: str) -> int:
    try:
        return int(count([text])[0])
    except Exception:  # told as 0
        return 0


def assistant_blocks(blocks: Column, request: Column) -> Column:
    """Typed blocks of an assistant as struct<content, calls array<struct<id, name, arguments>>>; thinking is dropped."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    calls = F.transform(
        F.filter(blocks, lambda b: b["type"] == "tool_use"),
        lambda b, i: F.struct(
            F.coalesce(F.nullif(b["id"], F.lit("")), call_id(request, i)).alias("id"), F.coalesce(b["name"], F.lit("")).alias("name"),
            F.coalesce(F.nullif(b["input"], F.lit("")), F.lit("{}")).alias("arguments"),
        ),
    )
    return F.struct(F.when(F.size(texts) > 0, F.array_join(texts, "\n")).alias("content"), calls.alias("calls"))


def user_blocks(blocks: Column) -> Column:
    """Typed blocks of a user as array<struct<role, tool_call_id, content>>: texts gather into one message until a tool result."""
    shape = "array<struct<role: string, tool_call_id: string, content: string>>"
    state = F.struct(F.array().cast(shape).alias("out"), F.array().cast("array<string>").alias("texts"))
    message = lambda who, call, text: F.struct(F.lit(who).alias("role"), call.alias("tool_call_id"), text.alias("content"))
    none = F.lit(None).cast("string")
    flushed = lambda s: F.when(F.size(s["texts"]) > 0, F.concat(s["out"], F.array(message("user", none, F.array_join(s["texts"], "\n"))))).otherwise(s["out"])

    def add(s: Column, b: Column) -> Column:
        result = message("tool", F.coalesce(b["tool_use_id"], F.lit("")), F.coalesce(b["content"], F.lit("")))
        return (
            F.when(b["type"] == "text", F.struct(s["out"].alias("out"), F.concat(s["texts"], F.array(F.coalesce(b["text"], F.lit("")))).alias("texts")))
            .when(b["type"] == "tool_result", F.struct(F.concat(flushed(s), F.array(result)).alias("out"), F.array().cast("array<string>").alias("texts")))
            .when(b["type"] == "image", F.raise_error(F.lit("image content is not supported")))
            .otherwise(s)
        )

    out = F.aggregate(blocks, state, add, flushed)
    return F.when(F.size(out) > 0, out).otherwise(F.array(message("user", none, F.lit(""))))


def call_id(request: Column, ordinal: Column) -> Column:
    """A call's id, the same on every run."""
    return F.concat(F.lit("call_"), F.substring(F.sha2(F.concat_ws("|", request.cast("string"), ordinal.cast("string")), 256), 1, 8))


def response_blocks(text: Column, reasoning: Column, calls: Column) -> Column:
    """Blocks of an answer: thinking, text, tool uses; an empty text block where there is nothing else."""
    block = lambda kind, text=None, id=None, name=None, value=None: F.struct(
        F.lit(kind).alias("type"), *[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in (("text", text), ("id", id), ("name", name), ("input", value))]
    )
    none = F.array().cast("array<struct<type: string, text: string, id: string, name: string, input: string>>")
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    parsed = lambda c: F.when(F.try_parse_json(c["arguments"]).isNotNull(), c["arguments"]).otherwise("{}")
    uses = F.transform(calls, lambda c: block("tool_use", id=F.regexp_replace(c["id"], "^call_", "toolu_"), name=c["name"], value=parsed(c)))
    out = F.concat(F.when(some(reasoning), F.array(block("thinking", reasoning))).otherwise(none), F.when(some(text), F.array(block("text", text))).otherwise(none), F.coalesce(uses, none))
    return F.when(F.size(out) > 0, out).otherwise(F.array(block("text", F.lit(""))))
