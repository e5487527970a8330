"""Registered queries over conversations: planning, message algebra, templates, tool calls, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import calls as T
from sparkloom.functions import text as X
from sparkloom.operators import converse as V
from sparkloom.operators import messages as M
from sparkloom.operators import templates as P
from sparkloom.plans.retrieval import table
from sparkloom.streaming import split as Z


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def gathered(spark: SparkSession, d: str) -> DataFrame:
    return V.gather(turns(spark, d))


def thought(spark: SparkSession, d: str) -> DataFrame:
    """Turns with thinking text in assistant rows: none, a closed pair, an open tag or an empty pair by (conv_id + turn) modulo 4."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    text = (
        F.when(F.col("role") != "assistant", F.col("text"))
        .when(kind == 1, F.concat(F.lit("<think>\nweigh "), F.col("conv_id"), F.lit("\n\n</think>\n\n"), F.col("text")))
        .when(kind == 2, F.concat(F.lit("<think>open "), F.col("text")))
        .when(kind == 3, F.concat(F.lit("<think></think>\n"), F.col("text")))
        .otherwise(F.col("text"))
    )
    return turns(spark, d).withColumn("text", text)


THOUGHT = """thought AS (SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN text
  WHEN (conv_id + turn) % 4 = 1 THEN '<think>' || chr(10) || 'weigh ' || conv_id || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || text
  WHEN (conv_id + turn) % 4 = 2 THEN '<think>open ' || text WHEN (conv_id + turn) % 4 = 3 THEN '<think></think>' || chr(10) || text ELSE text END AS text FROM conversations)"""


def tooled(spark: SparkSession, d: str) -> DataFrame:
    """Turns times ten, with one call on the first assistant row of every third conversation and a tool row after it."""
    rows = turns(spark, d)
    first = rows.filter((F.col("role") == "assistant") & (F.pmod("conv_id", F.lit(3)) == 0)).groupBy("conv_id").agg(F.min("turn").alias("first"))
    met = rows.join(first, "conv_id", "left")
    here = F.coalesce(F.col("turn") == F.col("first"), F.lit(False))
    call = F.concat(F.lit('[{"id":"call_'), F.col("conv_id"), F.lit('"}]'))
    none = F.lit(None).cast("string")
    base = met.select("conv_id", (F.col("turn") * 10).alias("turn"), "role", F.col("text").alias("content"), F.when(here, call).alias("calls"), none.alias("tool_call_id"), none.alias("name"))
    more = met.filter(here).select(
        "conv_id", (F.col("turn") * 10 + 1).alias("turn"), F.lit("tool").alias("role"), F.lit("result").alias("content"), none.alias("calls"),
        F.concat(F.lit("call_"), F.col("conv_id")).alias("tool_call_id"), none.alias("name"),
    )
    return base.unionByName(more)


TOOLED = """firsts AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0 GROUP BY conv_id),
met AS (SELECT c.*, coalesce(turn = first, false) AS here FROM conversations c LEFT JOIN firsts USING (conv_id)),
tooled AS (SELECT conv_id, turn * 10 AS turn, role, text AS content, CASE WHEN here THEN '[{"id":"call_' || conv_id || '"}]' END AS calls, NULL::VARCHAR AS tool_call_id FROM met
  UNION ALL SELECT conv_id, turn * 10 + 1, 'tool', 'result', NULL, 'call_' || conv_id FROM met WHERE here)"""


def tooled_arrays(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("turn", "role", "content", "calls", "tool_call_id", "name")
    return tooled(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("messages"))


def cases(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every event is a request of one of the cases, which take turns; its id is the event's."""
    some = spark.createDataFrame(rows, schema).withColumnRenamed("id", "case")
    turn = (F.pmod(F.col("event_id"), F.lit(len(rows))) + 1).cast("int")
    return table(spark, d, "events").select(F.col("event_id").cast("int").alias("id"), turn.alias("case")).join(F.broadcast(some), "case").drop("case")


def cases_sql(rows: list[tuple], names: str) -> str:
    return f"(SELECT event_id AS id, t.* EXCLUDE (id) FROM events JOIN {values_sql(rows, names)} ON t.id = event_id % {len(rows)} + 1)"


def values_sql(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


# --- planning


def query_history_split(spark, d):
    query, history = V.query_and_history(F.col("messages"))
    return gathered(spark, d).select("conv_id", query.alias("query"), F.size(history).alias("n_history"))


def _like(words, test="contains") -> str:
    return "(" + " OR ".join(f"{test}(q, '{w}')" for w in words) + ")"


INTENT_CASE = f"""CASE WHEN length(q) <= 15 AND {_like(V.CHITCHAT)} THEN 'chitchat|0.9|false|false' WHEN NOT has THEN 'knowledge_query|0.95|true|false'
  WHEN {_like(V.CLARIFICATION)} THEN 'clarification|0.8|true|true'
  WHEN (starts_with(q, '那') AND contains(q, '呢') AND length(q) > 5) OR {_like(V.TOPIC_SWITCH, 'starts_with')} THEN 'topic_switch|0.8|true|false'
  WHEN {_like(V.FOLLOW_UP)} THEN 'follow_up|0.8|true|true' WHEN length(q) > 20 AND {_like(V.QUESTION)} THEN 'knowledge_query|0.6|true|false' ELSE 'follow_up|0.5|true|true' END"""
SAYINGS = [
    (1, "谢谢", True), (2, "好的，我知道了", False), (3, "行业报告里的数据是从哪里来的呢请说明", False), (4, "数据来源有哪些", False), (5, "第一点没太懂", True), (6, "那天气预报呢", True), (7, "那呢", True),
    (8, "另外报销流程", True), (9, "它的价格", True), (10, "请问公司年度财务报告的披露时间和渠道分别是什么", True), (11, "年度财务报告", True), (12, "一二三四五六七八九十一二三四行", True),
    (13, "一二三四五六七八九十一二三四五行", True), (14, "一二三四五六七八九十一二三四五六七是否", True), (15, "一二三四五六七八九十一二三四五六七八九是否", True), (16, "  ok  ", True), (17, "", False),
]


def _intents(rows: DataFrame) -> DataFrame:
    made = V.intent(F.col("query"), F.col("has"))
    return rows.select("id", made.alias("i")).select("id", F.concat_ws("|", "i.intent", F.col("i.confidence").cast("string"), F.col("i.should_search").cast("string"), F.col("i.rewrite_needed").cast("string")).alias("plan"))


def intent_rules(spark, d):
    return _intents(cases(spark, d, SAYINGS, "id int, query string, has boolean"))


def intent_conversations(spark, d):
    query, history = V.query_and_history(F.col("messages"))
    return _intents(gathered(spark, d).select(F.col("conv_id").alias("id"), query.alias("query"), (F.size(history) > 0).alias("has")))


ANSWERS = [
    (1, '{"intent": "Chitchat", "should_search": false, "rewrite_needed": false}'), (2, '```json\n{"intent": "follow_up", "rewrite_needed": true}\n```'), (3, "no json"), (4, '{"intent": "strange"}'), (5, "{}"),
]

def intent_model(spark, d):
    rows = cases(spark, d, ANSWERS, "id int, answer string").withColumn("i", V.intent_of_answer(F.col("answer")))
    return rows.select("id", F.concat_ws("|", "i.intent", F.col("i.confidence").cast("string"), F.col("i.should_search").cast("string"), F.col("i.rewrite_needed").cast("string")).alias("plan"))


def rewrite_history(spark, d):
    return gathered(spark, d).select("conv_id", V.history_text(F.col("messages"), 4, None, ("observation",)).alias("text"), V.history_text(F.col("messages"), 4, 200).alias("short"))


REWRITES = [(1, "Cats", '"cats"'), (2, "it", " What is a cat? "), (3, "it", ""), (4, "dogs", "'Birds'")]


def query_rewrite(spark, d):
    made = V.rewritten(F.col("query"), F.col("answer"))
    return cases(spark, d, REWRITES, "id int, query string, answer string").select("id", made.alias("r")).select("id", F.col("r.query").alias("query"), F.col("r.applied").alias("applied"))


def prompt_history(spark, d):
    kept = V.prompt_history(F.col("messages"), 1)
    return gathered(spark, d).select("conv_id", F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("text"))


def _prompt(spark, d, build):
    query, history = V.query_and_history(F.col("messages"))
    context = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.concat(F.lit("hit "), F.col("conv_id").cast("string"))).otherwise("")
    return gathered(spark, d).select("conv_id", F.array_join(F.transform(build(query, history, context), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("prompt"))


def prompt_messages_generic(spark, d):
    return _prompt(spark, d, V.prompt_generic)


def prompt_messages_observation(spark, d):
    return _prompt(spark, d, V.prompt_observation)


MODELS = [(1, "GLM-4-9B"), (2, "chatGLM3"), (3, "Qwen3-4B"), (4, "deepseek-r1"), (5, "phi-4"), (6, None), (7, ""), (8, "my_qwen_glm")]


def model_family(spark, d):
    return cases(spark, d, MODELS, "id int, name string").select("id", V.family(F.col("name")).alias("family"))


# --- message algebra

ROLES = [(1, " User "), (2, "Developer"), (3, None), (4, ""), (5, "tool"), (6, "ASSISTANT")]


def role_normalize(spark, d):
    return cases(spark, d, ROLES, "id int, name string").select("id", M.role(F.col("name")).alias("role"))


def think_strip(spark, d):
    return thought(spark, d).select("conv_id", "turn", X.strip_thinking(F.col("text")).alias("text"))


def think_split(spark, d):
    reasoning, content = X.split_thinking(F.col("text"))
    return thought(spark, d).select("conv_id", "turn", reasoning.alias("reasoning"), content.alias("content"))


def token_estimate(spark, d):
    return turns(spark, d).select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens"))


def message_cost(spark, d):
    item = F.struct("role", "content", "calls", "tool_call_id", "name")
    return tooled(spark, d).select("conv_id", "turn", M.cost(item).alias("tokens"))


def tool_groups(spark, d):
    return M.tool_groups(tooled(spark, d))


BUDGET = 700


def trim_budget(spark, d):
    kept = M.trimmed(F.col("messages"), F.lit(BUDGET))
    return tooled_arrays(spark, d).select("conv_id", F.explode(kept).alias("turn"))


_COST = "(greatest(1, length(concat_ws(chr(10), role, content, calls, tool_call_id)) * 2 // 5) + 4)"
TRIM_SQL = f"""WITH RECURSIVE {TOOLED},
costed AS (SELECT *, {_COST} AS cost, sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS unit FROM tooled),
lastu AS (SELECT conv_id, max(turn) AS last_user FROM costed WHERE role = 'user' GROUP BY conv_id),
marked AS (SELECT c.*, role = 'system' OR coalesce(turn = last_user, false) AS fixed FROM costed c LEFT JOIN lastu USING (conv_id)),
base AS (SELECT conv_id, coalesce(sum(cost) FILTER (fixed), 0) AS base FROM marked GROUP BY conv_id),
units AS (SELECT conv_id, unit, sum(cost) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY unit DESC) AS k FROM marked WHERE NOT fixed GROUP BY conv_id, unit),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, 0::HUGEINT AS used, NULL::HUGEINT AS unit, false AS took FROM base
  UNION ALL
  SELECT w.conv_id, u.k, CASE WHEN w.used + u.cost <= {BUDGET} - b.base THEN w.used + u.cost ELSE w.used END, u.unit, w.used + u.cost <= {BUDGET} - b.base
  FROM walk w JOIN units u ON u.conv_id = w.conv_id AND u.k = w.k + 1 JOIN base b ON b.conv_id = w.conv_id
)
SELECT m.conv_id, m.turn FROM marked m JOIN base USING (conv_id) LEFT JOIN walk w ON w.conv_id = m.conv_id AND w.unit = m.unit AND w.took
WHERE m.fixed OR (w.took AND base < {BUDGET})"""

LIMITS = [(1, 4096, 1000, None, None), (2, 4096, 4000, 2048, 512), (3, None, 100, 2048, None), (4, None, 0, None, None), (5, 4096, 0, None, 64), (6, 8192, 100, 4096, 9000), (7, 300, 100, None, None), (8, None, 5, None, 0)]


def max_tokens(spark, d):
    rows = cases(spark, d, LIMITS, "id int, win int, prompt int, hw int, client int")
    return rows.select("id", M.max_tokens(F.col("win"), F.col("prompt"), F.col("hw"), F.col("client")).alias("max_tokens"), M.reserve(F.coalesce("win", F.lit(1000)), F.col("client")).alias("reserve"))


FINISHES = [(1, 10, 10), (2, 9, 10), (3, 11, 10), (4, 5, 0), (5, 5, None), (6, 5, -1)]


def finish_reason(spark, d):
    made = M.finish_reason(F.col("n"), F.col("most"))
    return cases(spark, d, FINISHES, "id int, n int, most int").select("id", made.alias("finish"), M.stop_reason(made).alias("stop"))


def stop_cut(spark, d):
    stops = F.array(F.lit(" the "), F.lit("\n"), F.lit(""))
    return turns(spark, d).select("conv_id", "turn", X.cut_at_stop(F.col("text"), stops).alias("text"))


CHOICES = [(1, "auto", None), (2, "any", None), (3, "tool", "look"), (4, "tool", ""), (5, "none", None)]


def tool_choice_map(spark, d):
    rows = cases(spark, d, CHOICES, "id int, kind string, name string")
    return rows.select("id", M.tool_choice(F.col("kind"), F.col("name")).alias("choice"), P.tool_choice_sentence(F.when(F.col("kind") == "any", "required").when(F.col("kind") == "tool", "function").otherwise(F.col("kind")), F.col("name")).alias("sentence"))


REQUESTS = [(1, 1, None, None), (2, 2, "json_object", False), (3, None, "text", True), (4, 3, "", None)]


def request_validation(spark, d):
    rows = cases(spark, d, REQUESTS, "id int, n int, fmt string, parallel boolean")
    return rows.select("id", F.array_join(M.violations(F.col("n"), F.col("fmt"), F.col("parallel")), ",").alias("violations"))


def user_block_split(spark, d):
    """Typed blocks of users: a text, a tool result, a text again."""
    block = "array<struct<type: string, text: string, tool_use_id: string, content: string>>"
    made = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content")),
        F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.col("conv_id").cast("string").alias("tool_use_id"), F.col("turn").cast("string").alias("content")),
        F.struct(F.lit("text").alias("type"), F.lit("after").alias("text"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content")),
    ).cast(block)
    rows = turns(spark, d).filter("role = 'user'").select("conv_id", "turn", F.posexplode(M.user_blocks(made)).alias("part", "m"))
    return rows.select("conv_id", "turn", "part", "m.role", "m.tool_call_id", "m.content")


def response_blocks(spark, d):
    reasoning, content = X.split_thinking(F.col("text"))
    none = F.lit(None).cast("array<struct<id: string, name: string, arguments: string>>")
    rows = thought(spark, d).filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(M.response_blocks(content, reasoning, none)).alias("part", "b"))
    return rows.select("conv_id", "turn", "part", "b.type", "b.text")


# --- templates

REASONING_SYSTEM = "Think first, then answer."


def _template(name: str):
    def query(spark, d):
        write = P.TEMPLATES.get(name) or (lambda m: P.separated_reasoning(m, REASONING_SYSTEM))
        return gathered(spark, d).select("conv_id", write(F.col("messages")).alias("prompt"))

    query.__name__ = f"template_{name}"
    return query


def _role(mapping: dict[str, str], other: str) -> str:
    return "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{other}' END"


_TEMPLATE_SQL = {
    "generic": ("role || ': ' || text", "chr(10)", "", "'assistant:'"),
    "chatml": ("'<|im_start|>' || role || chr(10) || text || '<|im_end|>'", "chr(10)", "", "'<|im_start|>assistant' || chr(10)"),
    "chatml_thinking": ("'<|im_start|>' || role || chr(10) || text || '<|im_end|>'", "chr(10)", "", "'<|im_start|>assistant' || chr(10) || '<think>'"),
    "tagged": (_role(P.ROLE_TAGS, "<|user|>") + " || chr(10) || text", "chr(10)", "[gMASK]<sop>", "'<|assistant|>' || chr(10)"),
    "tagged_thinking": (_role(P.ROLE_TAGS, "<|user|>") + " || chr(10) || text", "chr(10)", "[gMASK]<sop>", "'<|assistant|>' || chr(10) || '<think>'"),
    "xml": ("'<' || role || '>' || chr(10) || text || '</' || role || '>'", "chr(10)", "", "'<assistant>' || chr(10)"),
    "xml_thinking": ("'<' || role || '>' || chr(10) || text || '</' || role || '>'", "chr(10)", "", "'<assistant>' || chr(10) || '<think>'"),
    "separated": ("'<|im_start|>' || role || '<|im_sep|>' || text || '<|im_end|>'", "''", "", "'<|im_start|>assistant<|im_sep|>'"),
    "brief": (_role({"system": "<|system|>", "assistant": "<|assistant|>"}, "<|user|>") + " || text || '<|end|>'", "''", "", "'<|assistant|>'"),
    "brief_reasoning": (_role({"system": "<|system|>", "assistant": "<|assistant|>"}, "<|user|>") + " || text || '<|end|>'", "''", "", "'<|assistant|><think>' || chr(10)"),
}
TEMPLATE_ORACLE = {
    f"template_{n}": f"SELECT conv_id, '{head}' || string_agg({part}, {by} ORDER BY turn) || {by} || {tail} AS prompt FROM conversations GROUP BY conv_id" for n, (part, by, head, tail) in _TEMPLATE_SQL.items()
}
TEMPLATE_ORACLE["template_separated_reasoning"] = f"""SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN '' ELSE '<|im_start|>system<|im_sep|>{REASONING_SYSTEM}<|im_end|>' END ||
  string_agg('<|im_start|>' || role || '<|im_sep|>' || text || '<|im_end|>', '' ORDER BY turn) || '<|im_start|>assistant<|im_sep|><think>' || chr(10) AS prompt FROM conversations GROUP BY conv_id"""

STRATEGIES = [
    (1, "Qwen3_4B", "qwen3"), (2, "qwen2.5", "qwen2"), (3, "QWEN", "qwen"), (4, "glm-z1-9b", "glm4-z1"), (5, "glm4-9b", "glm4"), (6, "chatglm", "glm"), (7, "DeepSeek-R1", "deepseek-r1"), (8, "deepseek-v3", "deepseek"),
    (9, "phi-4-mini-reasoning", "phi4-mini-reasoning"), (10, "phi4_mini", "phi4-mini"), (11, "Phi-4-reasoning-plus", "phi4-reasoning"), (12, "phi-4", "phi4"), (13, None, "generic"), (14, "llama", "generic"),
]


def strategy_lookup(spark, d):
    return cases(spark, d, [s[:2] for s in STRATEGIES], "id int, name string").select("id", P.strategy(F.col("name")).alias("strategy"))


def filename_sanitize(spark, d):
    """Pages' addresses as names of files; every third ends in white space and a dot."""
    ends = F.when(F.col("page_id") % 3 == 0, F.lit(" . ")).otherwise("")
    return table(spark, d, "pages").select("page_id", X.file_name(F.concat("url", ends)).alias("file"))


# --- tool calls and streams

def called(spark: SparkSession, d: str) -> DataFrame:
    """Assistant texts with a call behind them, in a form by (conv_id + turn) modulo 4: tagged, function tags, a named line, a plain object."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    given = F.concat(F.lit('{"conv": '), conv, F.lit(', "turn": '), turn, F.lit("}"))
    stated = F.concat(F.lit('{"name": "look", "arguments": '), given, F.lit("}"))
    call = (
        F.when(kind == 0, F.concat(F.lit("<tool_call>\n"), stated, F.lit("\n</tool_call>")))
        .when(kind == 1, F.concat(F.lit("<tool_call><function=look><parameter=conv>"), conv, F.lit("</parameter><parameter=turn>"), turn, F.lit("</parameter></function></tool_call>")))
        .when(kind == 2, F.concat(F.lit("look\n```json\n"), given, F.lit("\n```")))
        .otherwise(stated)
    )
    rows = turns(spark, d).filter("role = 'assistant'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat("text", F.lit("\n"), call).alias("text"), F.array(F.lit("look")).alias("allowed"), F.lit("default").alias("style"))


def _outputs(spark, d):
    return called(spark, d).withColumn("calls", T.tool_calls("id", "text", "allowed", "style"))


def tool_call_parse(spark, d):
    return _outputs(spark, d).select("id", F.posexplode("calls").alias("n", "c")).select("id", "n", F.col("c.id").alias("call_id"), "c.name", "c.arguments")


def tool_call_strip(spark, d):
    made = called(spark, d).select("id", T.text_without_calls("text", "allowed", "style").alias("rest"), T.parse_missed(F.col("text"), F.col("allowed")).alias("looks_like_calls"))
    return made.withColumnRenamed("rest", "text")  # an alias text would be what the lambda means


def tool_events(spark, d):
    return Z.call_events(_outputs(spark, d).select(F.col("id").alias("req_id"), "calls"))


def tool_events_chunks(spark, d):
    return Z.call_events(_outputs(spark, d).select(F.col("id").alias("req_id"), "calls"), "chunks")


_TOOL = """'{"type": "function", "function": {"name": "f' || conv_id || '", "description": "' || %s || '", "parameters": {"type": "object", %s"properties": {"description": {"type": "string"%s}, "n": {"type": "integer"}}}}}'"""
TOOL, COMPACT = _TOOL % ("'about ' || role || ' ' || conv_id", '"description": "x", ', ', "description": "y"'), _TOOL % ("substr('about ' || role || ' ' || conv_id, 1, 8) || '...'", "", "")


def schema_compact(spark, d):
    """A tool definition for every turn, with descriptions at every level and a property of that name."""
    return turns(spark, d).select("conv_id", "turn", T.compact_tools(F.expr(TOOL), F.lit(8)).alias("tool"))


def pieces(spark, d, size: int = 7) -> DataFrame:
    """req_id, seq, delta: assistant texts with thinking, cut into pieces."""
    rows = thought(spark, d).filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("req_id"), "text")
    count = F.ceil(F.length("text") / size).cast("int")
    cut = rows.filter("text <> ''").select("req_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    return cut.select("req_id", F.col("i").cast("long").alias("seq"), F.substring("text", F.col("i") * size + 1, F.lit(size)).alias("delta"))


def stream_think(spark, d):
    return Z.whole(Z.split_batch(pieces(spark, d)))


def stream_blocks(spark, d):
    cut = pieces(spark, d)
    return Z.blocks(Z.split_batch(cut), cut)


def stream_stop(spark, d):
    return Z.whole(Z.split_batch(pieces(spark, d), lambda: Z.Stops((" the ", "\n\n")))).select("req_id", "content")


def event_stream(spark, d):
    """Turns as deltas, in each framing."""
    deltas = turns(spark, d).select(F.col("conv_id").alias("req_id"), F.col("turn").alias("seq"), F.col("role").alias("field"), F.lower("role").alias("text"))
    out = [Z.event_rows(deltas, f).select(F.lit(f).alias("framing"), "req_id", "seq", "event", "payload") for f in Z.FRAMINGS]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- small operators over all conversations


def intent_chosen(spark, d):
    """The rules' intent against that of a model, which always says topic_switch."""
    query, history = V.query_and_history(F.col("messages"))
    rows = gathered(spark, d).select("conv_id", query.alias("query"), (F.size(history) > 0).alias("has"))
    model = V.intent_of_answer(F.lit('{"intent": "topic_switch"}'))
    made = V.chosen_intent(V.intent(F.col("query"), F.col("has")), model)
    return rows.select("conv_id", made["intent"].alias("intent"), made["confidence"].alias("confidence"), V.chosen_intent(model, None, False, F.col("has"))["rewrite_needed"].alias("when_off"))


def rewrite_gated(spark, d):
    query, history = V.query_and_history(F.col("messages"))
    rows = gathered(spark, d).select("conv_id", query.alias("query"), (F.size(history) > 0).alias("has"))
    made = F.when(V.rewrite_gate(F.col("has"), True), V.rewritten(F.col("query"), F.concat(F.lit('"'), "query", F.lit('?"'))))
    return rows.select("conv_id", F.coalesce(made["query"], "query").alias("query"), F.coalesce(made["applied"], F.lit(False)).alias("applied"), V.rewrite_gate(F.col("has"), True, "never").alias("never"))


def message_normalize(spark, d):
    """Roles in upper case, and no content beside calls."""
    rows = tooled(spark, d).withColumn("role", F.upper("role")).withColumn("content", F.when(F.col("calls").isNull(), F.col("content")).otherwise(""))
    arrays = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "calls", "tool_call_id", "name"))).alias("m"))
    return arrays.select("conv_id", F.explode(M.normalised(F.col("m"))).alias("m")).select("conv_id", "m.turn", "m.role", "m.content")


def history_clean(spark, d):
    none = F.lit(None).cast("string")
    rows = thought(spark, d).select("conv_id", "turn", "role", F.col("text").alias("content"), none.alias("calls"), none.alias("tool_call_id"))
    arrays = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "calls", "tool_call_id"))).alias("m"))
    return arrays.select("conv_id", F.explode(M.without_thinking(F.col("m"))).alias("m")).select("conv_id", "m.turn", "m.content")


def prune_rendered(spark, d):
    """How many turns have to go until the texts' characters fit into 900."""
    sizes = gathered(spark, d).select("conv_id", F.transform("messages", lambda m: F.length(m["content"])).alias("sizes"))
    return sizes.select("conv_id", M.drop_oldest(F.col("sizes"), F.lit(900)).alias("gone"))


def tool_injection(spark, d):
    made = P.with_system_text(F.col("messages"), F.lit("\n\nTools: look"))
    return gathered(spark, d).select("conv_id", F.element_at(made, 1)["role"].alias("role"), F.element_at(made, 1)["content"].alias("content"), F.size(made).alias("n"))


def special_clean(spark, d):
    marked = F.concat(F.lit("<s>"), F.col("text"), F.lit("<|tool|><think></s>"))
    return turns(spark, d).select("conv_id", "turn", X.clean_special(marked, ["<s>", "</s>", "<|tool|>", "<think>"]).alias("text"))


def request_settings(spark, d):
    """Stop words, window and token limit of a request: each event asks for some of them."""
    e, kind, kinds, number = table(spark, d, "events"), F.pmod("event_id", F.lit(4)), F.col("event_type"), F.col("event_id").cast("int")
    one, many = F.when(kind == 0, kinds).when(kind == 1, F.lit("")), F.when(kind == 2, F.array(kinds, F.lit(""), F.lit("x"))).when(kind == 3, F.array(F.lit("")))
    window = M.context_window(F.when(number % 3 == 0, number % 5 * 1024), number % 2 * -1, (number % 7 - 1) * 512)
    most = M.client_limit(F.when(number % 2 == 0, number % 11), F.when(number % 3 != 0, number % 13))
    return e.select("event_id", F.array_join(M.stops(one, many), ",").alias("stops"), window.alias("win"), most.alias("most"))


def allowed_names(spark, d):
    """The different names of the tools that a conversation may call, one for each of its roles."""
    rows = gathered(spark, d).select("conv_id", F.transform("messages", lambda m: F.concat(F.lit('{"type":"function","function":{"name":"'), m["role"], F.lit('"}}'))).alias("tools"))
    return rows.select("conv_id", F.array_join(F.array_sort(M.tool_names(F.col("tools"))), ",").alias("names"))


def legacy_tools(spark, d):
    """Legacy function definitions and choices as tools."""
    text = lambda c: F.concat(F.lit('{"name":"'), c, F.lit('"}'))
    rows = turns(spark, d).select("conv_id", "turn", F.array(text(F.col("role"))).alias("functions"), F.when(F.col("role") == "user", "auto").otherwise(text(F.col("role"))).alias("call"))
    return rows.select("conv_id", "turn", F.element_at(M.tools_of(F.array().cast("array<string>"), F.col("functions")), 1).alias("tool"), M.legacy_choice(F.col("call")).alias("choice"))


def block_messages(spark, d):
    """A request of the second protocol for every conversation: a system field, and turns as typed blocks."""
    none = F.lit(None).cast("string")
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), none.alias("id"), none.alias("name"), none.alias("input"), none.alias("tool_use_id"), none.alias("content"))
    use = F.struct(F.lit("tool_use").alias("type"), none.alias("text"), none.alias("id"), F.lit("look").alias("name"), F.lit('{"q":1}').alias("input"), none.alias("tool_use_id"), none.alias("content"))
    result = F.struct(F.lit("tool_result").alias("type"), none.alias("text"), none.alias("id"), none.alias("name"), none.alias("input"), F.lit("t1").alias("tool_use_id"), F.lit("found").alias("content"))
    blocks = F.when(F.col("role") == "assistant", F.array(block, use)).otherwise(F.array(result, block))
    asked = turns(spark, d).filter("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", blocks.alias("blocks")))).alias("messages"))
    made = asked.select("conv_id", F.posexplode(M.request_messages(F.concat(F.lit("sys "), F.col("conv_id").cast("string")), F.col("messages"), F.col("conv_id"))).alias("at", "m"))
    return made.select("conv_id", "at", "m.role", "m.content", "m.tool_call_id", F.size("m.calls").alias("n_calls"))


def stream_delta(spark, d):
    rows = turns(spark, d).select(F.col("conv_id").alias("req_id"), F.col("turn").alias("seq"), "text")
    return Z.deltas_of(rows)


_CALLED = """called AS (SELECT conv_id * 100 + turn AS id, (conv_id + turn) % 4 AS kind, text, 'call_' || substr(sha256((conv_id * 100 + turn)::VARCHAR || '|0'), 1, 8) AS call_id,
  '{"conv": ' || conv_id || ', "turn": ' || turn || '}' AS arguments FROM conversations WHERE role = 'assistant')"""
_PIECED = f"""{THOUGHT}, pieced AS (SELECT conv_id * 100 + turn AS req_id, text, starts_with(text, '<think>') AS opened, strpos(text, '</think>') AS p FROM thought WHERE role = 'assistant' AND text <> ''),
split AS (SELECT req_id, CASE WHEN NOT opened THEN '' WHEN p > 0 THEN substring(text, 8, p - 8) ELSE substring(text, 8) END AS reasoning,
  CASE WHEN opened AND p = 0 THEN '' WHEN opened THEN ltrim(substring(text, p + 8), chr(10)) WHEN length(text) < 7 THEN ltrim(text, chr(10)) ELSE text END AS content FROM pieced)"""


_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', ''), '\n\s*\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_GATHERED = "last AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS lu, max(turn) AS lt FROM conversations GROUP BY conv_id), asked AS (SELECT c.conv_id, c.turn, c.text FROM conversations c JOIN last USING (conv_id) WHERE turn = coalesce(lu, lt))"
_RECENT = "ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)"
_NAME = "CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END"
_HISTORY = f"{_GATHERED}, past AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY c.turn DESC) AS k FROM conversations c JOIN asked a USING (conv_id) WHERE c.turn < a.turn AND role IN ('user', 'assistant')), hist AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS h FROM past WHERE k <= 6 GROUP BY conv_id)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(tail: str) -> str:
    return f"WITH {_HISTORY} SELECT conv_id, 'system:' || {_q(V.SYSTEM_PROMPT)} || chr(10) || coalesce(h || chr(10), '') || {tail} AS prompt FROM asked LEFT JOIN hist USING (conv_id)"


QUERIES = {
    f.__name__: f
    for f in (
        query_history_split, intent_rules, intent_conversations, intent_model, rewrite_history, query_rewrite, prompt_history, prompt_messages_generic, prompt_messages_observation, model_family, role_normalize,
        think_strip, think_split, token_estimate, message_cost, tool_groups, trim_budget, max_tokens, finish_reason, stop_cut, tool_choice_map, request_validation, user_block_split, response_blocks,
        *map(_template, [*P.TEMPLATES, "separated_reasoning"]), strategy_lookup, filename_sanitize, tool_call_parse, tool_call_strip, tool_events, tool_events_chunks, schema_compact, stream_think, stream_blocks, stream_stop, stream_delta, event_stream,
        intent_chosen, rewrite_gated, message_normalize, history_clean, prune_rendered, tool_injection, special_clean, request_settings, allowed_names, legacy_tools, block_messages,
    )
}

ORACLE = TEMPLATE_ORACLE | {
    "query_history_split": f"WITH {_GATHERED} SELECT a.conv_id, a.text AS query, (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn)::INT AS n_history FROM asked a",
    "intent_rules": f"SELECT id::INT AS id, {INTENT_CASE} AS plan FROM (SELECT id, trim(query) AS q, has FROM {cases_sql(SAYINGS, 'id, query, has')})",
    "intent_conversations": f"WITH {_GATHERED} SELECT id, {INTENT_CASE} AS plan FROM (SELECT conv_id AS id, trim(text) AS q, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) AS has FROM asked a)",
    "intent_model": f"""WITH a AS (SELECT id, regexp_replace(regexp_replace(answer, '^```[a-z]*\\n', ''), '\\n```$', '') AS body FROM {cases_sql(ANSWERS, 'id, answer')}),
  j AS (SELECT id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS body FROM a), n AS (SELECT *, lower(coalesce(json_extract_string(body, '$.intent'), '')) AS name FROM j)
  SELECT id::INT AS id, CASE WHEN ok THEN CASE WHEN name IN ('follow_up', 'topic_switch', 'clarification', 'chitchat') THEN name ELSE 'knowledge_query' END || '|0.8|' || coalesce(json_extract_string(body, '$.should_search'), 'true') || '|' || coalesce(json_extract_string(body, '$.rewrite_needed'), 'false')
    ELSE 'follow_up|0.3|true|true' END AS plan FROM n""",
    "rewrite_history": f"WITH {_RECENT} SELECT conv_id, string_agg({_NAME} || ': ' || text, chr(10) ORDER BY turn) AS text, string_agg({_NAME} || ': ' || substring(text, 1, 200), chr(10) ORDER BY turn) AS short FROM ranked WHERE k <= 4 GROUP BY conv_id",
    "query_rewrite": f"""WITH r AS (SELECT id, query, trim(answer) AS t FROM {cases_sql(REWRITES, 'id, query, answer')}),
  d AS (SELECT id, query, CASE WHEN length(t) > 1 AND starts_with(t, chr(34)) AND ends_with(t, chr(34)) THEN substring(t, 2, length(t) - 2) ELSE t END AS t FROM r),
  s AS (SELECT id, query, CASE WHEN length(t) > 1 AND starts_with(t, chr(39)) AND ends_with(t, chr(39)) THEN substring(t, 2, length(t) - 2) ELSE t END AS t FROM d)
  SELECT id::INT AS id, CASE WHEN t <> '' THEN t ELSE query END AS query, t <> '' AND lower(t) <> lower(query) AS applied FROM s""",
    "prompt_history": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant'))
  SELECT c.conv_id, coalesce(string_agg(r.role || ':' || r.text, chr(10) ORDER BY r.turn) FILTER (k <= 2), '') AS text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id""",
    "prompt_messages_generic": _prompt_sql(f"'user:' || CASE WHEN conv_id % 2 = 0 THEN {_q(V.FOUND_HEAD)} || 'hit ' || conv_id || {_q(V.QUESTION_HEAD)} || text || {_q(V.FOUND_TAIL)} ELSE {_q(V.NO_RESULT + V.QUESTION_HEAD)} || text END"),
    "prompt_messages_observation": _prompt_sql(f"'user:' || text || chr(10) || 'observation:' || CASE WHEN conv_id % 2 = 0 THEN 'hit ' || conv_id ELSE {_q(V.NOT_FOUND)} END"),
    "model_family": f"SELECT id::INT AS id, CASE WHEN contains(lower(name), 'glm') THEN 'glm' WHEN contains(lower(name), 'qwen') THEN 'qwen' WHEN contains(lower(name), 'deepseek') THEN 'deepseek' ELSE 'generic' END AS family FROM {cases_sql(MODELS, 'id, name')}",
    "role_normalize": f"SELECT id::INT AS id, CASE WHEN r = 'developer' THEN 'system' WHEN r = '' THEN 'user' ELSE r END AS role FROM (SELECT id, lower(trim(coalesce(name, ''))) AS r FROM {cases_sql(ROLES, 'id, name')})",
    "think_strip": f"WITH {THOUGHT} SELECT conv_id, turn, {_STRIPPED} AS text FROM thought",
    "think_split": f"""WITH {THOUGHT} SELECT conv_id, turn, CASE WHEN starts_with(text, '<think>') THEN nullif(regexp_replace(CASE WHEN p > 0 THEN substring(text, 8, p - 8) ELSE substring(text, 8) END, '^\\s+|\\s+$', '', 'g'), '') END AS reasoning,
  CASE WHEN NOT starts_with(text, '<think>') THEN text WHEN p > 0 THEN regexp_replace(substring(text, p + 8), '^\\s+|\\s+$', '', 'g') ELSE '' END AS content FROM (SELECT *, strpos(text, '</think>') AS p FROM thought)""",
    "token_estimate": "SELECT conv_id, turn, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) * 2 // 5) END)::INT AS tokens FROM conversations",
    "message_cost": f"WITH {TOOLED} SELECT conv_id, turn, {_COST}::INT AS tokens FROM tooled",
    "tool_groups": f"WITH {TOOLED}, heads AS (SELECT conv_id, turn AS head_turn FROM tooled WHERE calls IS NOT NULL) SELECT t.conv_id, t.turn, h.head_turn FROM tooled t JOIN heads h ON h.conv_id = t.conv_id AND t.turn IN (h.head_turn, h.head_turn + 1)",
    "trim_budget": TRIM_SQL,
    "max_tokens": f"""SELECT id::INT AS id, coalesce(greatest(least(CASE WHEN prompt > 0 AND win - prompt - 256 > 0 THEN win - prompt - 256 END, hw, client), CASE WHEN least(CASE WHEN prompt > 0 AND win - prompt - 256 > 0 THEN win - prompt - 256 END, hw, client) IS NOT NULL THEN 1 END), 4096)::INT AS max_tokens,
  (least(coalesce(client, 4096), coalesce(win, 1000) // 2) + 256)::INT AS reserve FROM {cases_sql(LIMITS, 'id, win, prompt, hw, client')}""",
    "finish_reason": f"SELECT id::INT AS id, CASE WHEN most > 0 AND n >= most THEN 'length' ELSE 'stop' END AS finish, CASE WHEN most > 0 AND n >= most THEN 'max_tokens' ELSE 'end_turn' END AS stop FROM {cases_sql(FINISHES, 'id, n, most')}",
    "stop_cut": "SELECT conv_id, turn, CASE WHEN least(a, b) < 1e9 THEN substring(text, 1, least(a, b)::BIGINT - 1) ELSE text END AS text FROM (SELECT *, coalesce(nullif(strpos(text, ' the '), 0), 1e9) AS a, coalesce(nullif(strpos(text, chr(10)), 0), 1e9) AS b FROM conversations)",
    "tool_choice_map": f"""SELECT id::INT AS id, CASE WHEN kind = 'any' THEN 'required' WHEN kind = 'tool' AND name <> '' THEN '{{"type":"function","function":{{"name":"' || name || '"}}}}' ELSE 'auto' END AS choice,
  CASE WHEN kind = 'none' THEN 'Important: Do NOT call any tools. Respond with text only.' WHEN kind = 'any' THEN 'Important: You MUST call at least one tool in your response.' WHEN kind = 'tool' AND name <> '' THEN 'Important: You MUST call the tool "' || name || '" in your response.' ELSE '' END AS sentence FROM {cases_sql(CHOICES, 'id, kind, name')}""",
    "request_validation": f"SELECT id::INT AS id, concat_ws(',', CASE WHEN n > 1 THEN 'n' END, CASE WHEN fmt NOT IN ('text', '') THEN 'response_format' END, CASE WHEN NOT parallel THEN 'parallel_tool_calls' END) AS violations FROM {cases_sql(REQUESTS, 'id, n, fmt, parallel')}",
    "user_block_split": """SELECT conv_id, turn, part::INT AS part, CASE WHEN part = 1 THEN 'tool' ELSE 'user' END AS role, CASE WHEN part = 1 THEN conv_id::VARCHAR END AS tool_call_id,
  CASE part WHEN 0 THEN text WHEN 1 THEN turn::VARCHAR ELSE 'after' END AS content FROM conversations, range(3) r(part) WHERE role = 'user'""",
    "response_blocks": f"""WITH {THOUGHT}, parts AS (SELECT conv_id, turn, CASE WHEN starts_with(text, '<think>') THEN regexp_replace(CASE WHEN p > 0 THEN substring(text, 8, p - 8) ELSE substring(text, 8) END, '^\\s+|\\s+$', '', 'g') ELSE '' END AS reasoning,
  CASE WHEN NOT starts_with(text, '<think>') THEN text WHEN p > 0 THEN regexp_replace(substring(text, p + 8), '^\\s+|\\s+$', '', 'g') ELSE '' END AS content FROM (SELECT *, strpos(text, '</think>') AS p FROM thought WHERE role = 'assistant')),
  blocks AS (SELECT conv_id, turn, 0 AS o, 'thinking' AS type, reasoning AS text FROM parts WHERE reasoning <> '' UNION ALL SELECT conv_id, turn, 1, 'text', content FROM parts WHERE content <> '' OR reasoning = '')
  SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1)::INT AS part, type, text FROM blocks""",
    "strategy_lookup": f"""WITH k AS (SELECT id, replace(lower(trim(coalesce(name, 'generic'))), '_', '-') AS key FROM {cases_sql([x[:2] for x in STRATEGIES], 'id, name')}),
  p AS (SELECT *, replace(key, 'phi-4', 'phi4') AS phi FROM k)
  SELECT id::INT AS id, CASE WHEN contains(key, 'qwen') THEN coalesce(nullif(regexp_extract(key, 'qwen[23]'), ''), 'qwen')
    WHEN contains(key, 'glm') THEN CASE WHEN contains(key, 'z1') THEN 'glm4-z1' WHEN contains(key, 'glm4') THEN 'glm4' ELSE 'glm' END
    WHEN contains(key, 'deepseek') THEN CASE WHEN contains(key, 'r1') THEN 'deepseek-r1' ELSE 'deepseek' END
    WHEN contains(phi, 'phi4') THEN 'phi4' || CASE WHEN contains(key, 'mini') THEN '-mini' ELSE '' END || CASE WHEN contains(key, 'reason') THEN '-reasoning' ELSE '' END ELSE 'generic' END AS strategy FROM p""",
    "filename_sanitize": """SELECT page_id, coalesce(nullif(trim(regexp_replace(coalesce(nullif(url || CASE WHEN page_id % 3 = 0 THEN ' . ' ELSE '' END, ''), 'default'), '[<>:"/\\\\|?*]+', '_', 'g'), ' .'), ''), 'default') AS file FROM pages""",
    "tool_call_parse": f"WITH {_CALLED} SELECT id, 0 AS n, call_id, 'look' AS name, arguments FROM called",
    "tool_call_strip": f"WITH {_CALLED} SELECT id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, kind <> 2 AS looks_like_calls FROM called",
    "tool_events": f"""WITH {_CALLED} SELECT id AS req_id, 0 AS call, step::INT AS step, CASE step WHEN 0 THEN 'start' WHEN 1 THEN 'delta' ELSE 'stop' END AS event,
  CASE step WHEN 0 THEN '{{"id":"' || call_id || '","name":"look"}}' WHEN 1 THEN arguments ELSE '' END AS payload FROM called, range(3) r(step)""",
    "tool_events_chunks": f"""WITH {_CALLED} SELECT id AS req_id, 0 AS call, step::INT AS step, CASE step WHEN 0 THEN 'header' ELSE 'arguments' END AS event,
  CASE step WHEN 0 THEN '{{"id":"' || call_id || '","name":"look"}}' ELSE arguments END AS payload FROM called, range(2) r(step)""",
    "schema_compact": f"SELECT conv_id, turn, {COMPACT} AS tool FROM conversations",
    "stream_think": f"WITH {_PIECED} SELECT req_id, reasoning, content FROM split WHERE reasoning <> '' OR content <> ''",
    "stream_blocks": f"""WITH {_PIECED}, parts AS (SELECT req_id, 0 AS o, 'reasoning' AS field, reasoning AS text FROM split WHERE reasoning <> '' UNION ALL SELECT req_id, 1, 'content', content FROM split WHERE content <> '' OR reasoning = '')
  SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY o) - 1 AS block, field, text FROM parts""",
    "stream_stop": f"""WITH {_PIECED}, cut AS (SELECT req_id, text, least(coalesce(nullif(strpos(text, ' the '), 0), 1e9), coalesce(nullif(strpos(text, chr(10) || chr(10)), 0), 1e9)) AS upto FROM pieced)
  SELECT req_id, content FROM (SELECT req_id, CASE WHEN upto < 1e9 THEN substring(text, 1, upto::BIGINT - 1) ELSE text END AS content FROM cut) WHERE content <> ''""",
    "event_stream": """WITH framings AS (SELECT * FROM (VALUES ('chunks', 'role', 'delta', 'done'), ('blocks', 'message_start', 'content_block_delta', 'message_stop'), ('knowledge', 'start', 'delta', 'end')) t(framing, a, b, c)),
  ends AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
  SELECT framing, conv_id AS req_id, 0::BIGINT AS seq, a AS event, '{"role":"assistant"}' AS payload FROM ends, framings
  UNION ALL SELECT framing, conv_id, row_number() OVER (PARTITION BY framing, conv_id ORDER BY turn), b, '{"field":"' || role || '","text":"' || lower(role) || '"}' FROM conversations, framings
  UNION ALL SELECT framing, conv_id, n + 1, c, '{"deltas":' || n || '}' FROM ends, framings""",
    "intent_chosen": f"""WITH {_GATHERED}, plans AS (SELECT conv_id, has, string_split({INTENT_CASE}, '|') AS p FROM (SELECT conv_id, trim(text) AS q, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) AS has FROM asked a))
  SELECT conv_id, CASE WHEN p[2]::DOUBLE < 0.7 THEN 'topic_switch' ELSE p[1] END AS intent, CASE WHEN p[2]::DOUBLE < 0.7 THEN 0.8 ELSE p[2]::DOUBLE END AS confidence, has AS when_off FROM plans""",
    "rewrite_gated": f"""WITH {_GATHERED}, h AS (SELECT conv_id, text, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) AS has FROM asked a)
  SELECT conv_id, CASE WHEN has THEN text || '?' ELSE text END AS query, has AS applied, false AS never FROM h""",
    "message_normalize": f"WITH {TOOLED} SELECT conv_id, turn, role, CASE WHEN calls IS NULL THEN content END AS content FROM tooled",
    "history_clean": f"WITH {THOUGHT} SELECT * FROM (SELECT conv_id, turn, {_STRIPPED} AS content FROM thought) WHERE content <> ''",
    "prune_rendered": """WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS behind FROM conversations)
  SELECT conv_id, (count(*) FILTER (behind > 900))::INT AS gone FROM r GROUP BY conv_id""",
    "tool_injection": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations)
  SELECT conv_id, 'system' AS role, CASE WHEN role = 'system' THEN text || chr(10) || chr(10) || 'Tools: look' ELSE 'Tools: look' END AS content, (m + CASE WHEN role = 'system' THEN 0 ELSE 1 END)::INT AS n FROM f WHERE k = 1""",
    "special_clean": "SELECT conv_id, turn, replace(replace(text, '<s>', ''), '</s>', '') || '<|tool|><think>' AS text FROM conversations",
    "request_settings": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN event_type || ',x' END AS stops,
  CASE WHEN event_id % 3 = 0 AND event_id % 5 > 0 THEN event_id % 5 * 1024 WHEN event_id % 7 > 1 THEN (event_id % 7 - 1) * 512 END::INT AS win,
  coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 11 END, CASE WHEN event_id % 3 <> 0 THEN event_id % 13 END)::INT AS most FROM events""",
    "allowed_names": "SELECT conv_id, string_agg(role, ',' ORDER BY role) AS names FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id",
    "legacy_tools": """SELECT conv_id, turn, '{"type":"function","function":{"name":"' || role || '"}}' AS tool, CASE WHEN role = 'user' THEN 'auto' ELSE '{"type":"function","function":{"name":"' || role || '"}}' END AS choice FROM conversations""",
    "block_messages": """WITH r AS (SELECT conv_id, turn, part, role, text FROM conversations, range(2) p(part) WHERE role <> 'system'),
  m AS (SELECT conv_id, turn, part, CASE WHEN role = 'assistant' THEN 'assistant' WHEN part = 0 THEN 'tool' ELSE 'user' END AS role, CASE WHEN role <> 'assistant' AND part = 0 THEN 'found' ELSE text END AS content,
    CASE WHEN role <> 'assistant' AND part = 0 THEN 't1' END AS tool_call_id, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls FROM r WHERE role <> 'assistant' OR part = 0
    UNION ALL SELECT DISTINCT conv_id, -1, 0, 'system', 'sys ' || conv_id, NULL, 0 FROM r)
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1)::INT AS at, role, content, tool_call_id, n_calls::INT AS n_calls FROM m""",
    "stream_delta": "SELECT conv_id AS req_id, turn AS seq, substring(text, seen + 1) AS delta FROM (SELECT *, coalesce(max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM conversations) WHERE length(text) > seen",
}
