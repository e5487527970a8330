"""Registered queries of tools and models: told, generated, read back; embeddings, reranking and counting over requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import calls as C
from sparkloom.functions import text as X
from sparkloom.operators import generate as G
from sparkloom.operators import messages as M
from sparkloom.operators import search as S
from sparkloom.operators import serving as R
from sparkloom.plans import dialogue as D
from sparkloom.plans import service

TOOL = '{"type": "function", "function": {"name": "%s", "description": "Finds", "parameters": {"type": "object"}}}'
DEFINED = '[{"name": "%s", "description": "Finds", "parameters": {"type": "object"}}]'


def _mod(c, n):
    return F.pmod(F.col(c), F.lit(n))


def tool_generation(spark, d):
    """Answers with calls in four forms, from a model that repeats its prompt: some requests have no tools, others don't want them called, have
    another tool, or think."""
    tool = F.when(_mod("id", 7) == 0, TOOL % "other").otherwise(TOOL % "look")
    none = F.lit(None).cast("string")
    asked = D.called(spark, d).select(
        F.col("id").alias("request"), F.col("text").alias("prompt"), F.when(_mod("id", 2) == 0, "<think>").alias("prefix"), F.when(_mod("id", 3) > 0, F.array(tool)).alias("tools"),
        F.when(_mod("id", 5) == 0, "none").when(_mod("id", 5) == 1, none).otherwise("auto").alias("choice"), "style",
    )
    made = G.executed(asked, lambda prompt: prompt)
    first = F.try_element_at("calls", F.lit(1))
    called = F.size("calls") > 0
    return made.select(
        "request", F.when(called, F.col("content")).alias("rest"), F.when(~called, F.length("content")).alias("length"), "finish_reason", F.size("calls").alias("n"), first["id"].alias("call_id"), first["arguments"].alias("arguments")
    )


def _styled(spark, d, style):
    """Assistant texts with calls in a family's own form."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    given = F.concat(F.lit('{"conv": '), conv, F.lit(', "turn": '), turn, F.lit("}"))
    if style == "array":
        calls = F.concat(F.lit('[{"name": "look", "arguments": '), given, F.lit('}, {"name": "keep", "arguments": {}}, {"name": "other"}]'))
        text = F.concat(calls, F.lit("\n"), "text")
    else:
        kind = _mod("turn", 3)
        text = F.when(kind == 0, F.concat(F.lit("Look\n"), given)).when(kind == 1, F.concat("text", F.lit("\nLook\n"), given)).otherwise(F.concat("text", F.lit("\nAction: Look\nas asked\n"), given))
    rows = D.turns(spark, d).filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), text.alias("text"))
    names = F.array(F.lit("look"), F.lit("keep")) if style == "array" else F.array(F.lit("Look"))
    made = rows.select("id", C.tool_calls("id", "text", names, F.lit(style)).alias("calls"))
    return made.select("id", F.posexplode("calls").alias("n", "c")).select("id", "n", F.col("c.id").alias("call_id"), "c.name", "c.arguments")


def calls_array(spark, d):
    return _styled(spark, d, "array")


def calls_named(spark, d):
    return _styled(spark, d, "named")


def response_tool_uses(spark, d):
    """Blocks of answers with calls; every fifth call's arguments aren't JSON."""
    made = D.called(spark, d).withColumn("calls", C.tool_calls("id", "text", "allowed", "style"))
    given = F.transform("calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), F.when(_mod("id", 5) == 0, "{conv").otherwise(c["arguments"]).alias("arguments")))
    blocks = M.response_blocks(F.when(_mod("id", 2) == 0, F.lit("Called.")), F.lit(None).cast("string"), given)
    return made.select("id", F.posexplode(blocks).alias("part", "b")).select("id", "part", "b.type", "b.text", F.col("b.id").alias("call_id"), "b.name", "b.input")


def _choice():
    kind = _mod("conv_id", 4)
    return F.when(kind == 0, "none").when(kind == 1, "required").when(kind == 2, "function").otherwise("auto"), F.lit("look")


def tools_tagged(spark, d):
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    made = D.gathered(spark, d).select("conv_id", G.tagged_tools(messages, F.array(F.lit(TOOL % "look")), *_choice()).alias("m"))
    return made.select("conv_id", F.posexplode("m").alias("at", "c")).select("conv_id", "at", "c.role", "c.content")


def tools_attached(spark, d):
    shape = "array<struct<id: string, function: struct<name: string, arguments: string>>>"
    read = lambda m: F.transform(F.from_json(m["calls"], shape), lambda c: F.struct(c["id"].alias("id"), F.coalesce(c["function"]["name"], F.lit("look")).alias("name"), F.lit('{"a": 1}').alias("arguments")))
    silent = lambda m: F.when(m["calls"].isNull(), m["content"])
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), silent(m).alias("content"), read(m).alias("calls")))
    made = D.tooled_arrays(spark, d).select("conv_id", G.attached_tools(messages, F.array(F.lit(TOOL % "look")), *_choice()).alias("m"))
    return made.select("conv_id", F.posexplode("m").alias("at", "c")).select("conv_id", "at", "c.role", "c.content", F.size("c.tools").alias("n_tools"), "c.metadata")


def embedding_usage(spark, d):
    """Turns as embedding requests: a text, a list of texts, token numbers, lists of these.  A stand-in model gives length and half length."""
    text, kind = F.col("text"), _mod("turn", 4)
    body = F.when(kind == 0, F.to_json(F.array(text, F.lit("same"), F.lit("")))).when(kind == 1, F.lit("[1, 2]")).when(kind == 2, F.lit("[[1, 2], [3]]")).otherwise(text)
    inputs = D.turns(spark, d).select("conv_id", "turn", F.posexplode(S.embedding_inputs(body)).alias("at", "input"))
    model = S.embedder(lambda texts: [[float(len(t)), len(t) / 2] for t in texts])
    met = inputs.withColumn("v", model("input"))
    return met.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_inputs"), F.count("v").alias("n_vectors"), F.sum(F.try_element_at("v", F.lit(1)) + F.try_element_at("v", F.lit(2))).alias("mass"), F.sum(X.estimate_tokens(F.col("input"))).alias("total_tokens")
    )


def rerank_listed(spark, d):
    """A conversation's turns as documents, by how near their length comes to that of the question; three of them."""
    rate = lambda q, t: F.lit(1.0) / (F.abs(F.length(q) - F.length(t)) + 1)
    asked = D.gathered(spark, d).select("conv_id", F.element_at("messages", -1)["content"].alias("query"), F.transform("messages", lambda m: m["content"]).alias("documents"))
    made = asked.select("conv_id", F.posexplode(S.rerank_records(F.col("query"), F.col("documents"), F.lit(3), rate)).alias("place", "r"))
    return made.select("conv_id", "place", "r.index", F.length("r.document").alias("length"), "r.score")


def _counted(texts):
    """A stand-in tokenizer that fails on long texts."""
    if any(len(t) > 300 for t in texts):
        raise ValueError("too long")
    return [t.count(" ") + 1 for t in texts]


def tokens_counted(spark, d):
    return D.turns(spark, d).select("conv_id", "turn", M.counted_tokens(_counted)("text").alias("tokens"))


def parameters_typed(spark, d):
    """Requests with loose parameters: two known ones, and others as extra."""
    given = F.map_from_entries(
        F.filter(F.array(
            F.when(_mod("event_id", 2) == 0, F.struct(F.lit("top_k").alias("k"), _mod("event_id", 9).cast("string").alias("v"))), F.when(_mod("event_id", 3) == 0, F.struct(F.lit("stop").alias("k"), F.col("event_type").alias("v"))),
            F.when(_mod("event_id", 5) > 1, F.struct(F.lit("user").alias("k"), F.col("user_id").cast("string").alias("v"))),
        ), lambda x: x.isNotNull())
    )
    made = service.table(spark, d, "events").select("event_id", M.parameter_record(given, ("top_k", "stop")).alias("p"))
    return made.select("event_id", "p.top_k", "p.stop", F.size("p.extra").alias("n_extra"), F.try_element_at("p.extra", F.lit("user")).alias("user"))


def system_fields(spark, d):
    """System fields as a text, as blocks with an image and an empty text between, or missing."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.when(_mod("turn", 3) == 1, F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.lit("")), block("text", F.col("role"))))
    return D.turns(spark, d).select("conv_id", "turn", M.system_text(F.when(_mod("turn", 3) == 0, F.col("text")), blocks).alias("text"))


def deployment_detail(spark, d):
    r = service.requests(spark, d)
    timed = r.groupBy("model", "replica").agg(
        F.lit(100000).cast("long").alias("capacity"), F.count("*").alias("active"), F.count(F.when(F.col("status") == 503, 1)).alias("rejected"), F.count(F.when(F.col("ms") > 900, 1)).alias("timeouts")
    )
    return R.deployment_metrics(timed).select("model", "replicas", "timeouts", "detail")


QUERIES = {
    f.__name__: f
    for f in (tool_generation, calls_array, calls_named, response_tool_uses, tools_tagged, tools_attached, embedding_usage, rerank_listed, tokens_counted, parameters_typed, system_fields, deployment_detail)
}

_ID = "conv_id * 100 + turn"
_CALL_ID = "'call_' || substr(sha256(({}) || '|{}'), 1, 8)"
_GIVEN = "'{\"conv\": ' || conv_id || ', \"turn\": ' || turn || '}'"
_SENTENCE = """CASE conv_id % 4 WHEN 0 THEN 'Important: Do NOT call any tools. Respond with text only.' WHEN 1 THEN 'Important: You MUST call at least one tool in your response.'
  WHEN 2 THEN 'Important: You MUST call the tool "look" in your response.' ELSE '' END"""
_TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) * 2 // 5) END"
ORACLE = {
    "tool_generation": f"""WITH {D._CALLED}, a AS (SELECT *, CASE WHEN id % 2 = 0 THEN '<think>' ELSE '' END AS prefix, id % 3 > 0 AND id % 5 <> 0 AND id % 7 > 0 AS met, CASE kind WHEN 0 THEN '<tool_call>' || chr(10) || '{{"name": "look", "arguments": ' || arguments || '}}' || chr(10) || '</tool_call>'
    WHEN 1 THEN '<tool_call><function=look><parameter=conv>' || id // 100 || '</parameter><parameter=turn>' || id % 100 || '</parameter></function></tool_call>' WHEN 2 THEN 'look' || chr(10) || '```json' || chr(10) || arguments || chr(10) || '```' ELSE '{{"name": "look", "arguments": ' || arguments || '}}' END AS told FROM called)
  SELECT id AS request, CASE WHEN met THEN regexp_replace(prefix || text, '^\\s+|\\s+$', '', 'g') END AS rest, CASE WHEN NOT met THEN length(prefix || text || chr(10) || told)::INT END AS length, CASE WHEN met THEN 'tool_calls' ELSE 'stop' END AS finish_reason, met::INT AS n,
  CASE WHEN met THEN call_id END AS call_id, CASE WHEN met THEN arguments END AS arguments FROM a""",
    "calls_array": f"""SELECT {_ID} AS id, n::INT AS n, CASE n WHEN 0 THEN {_CALL_ID.format(_ID, 0)} ELSE {_CALL_ID.format(_ID, 1)} END AS call_id, CASE n WHEN 0 THEN 'look' ELSE 'keep' END AS name, CASE n WHEN 0 THEN {_GIVEN} ELSE '{{}}' END AS arguments
  FROM conversations, range(2) r(n) WHERE role = 'assistant'""",
    "calls_named": f"SELECT {_ID} AS id, 0::INT AS n, {_CALL_ID.format(_ID, 0)} AS call_id, 'Look' AS name, {_GIVEN} AS arguments FROM conversations WHERE role = 'assistant'",
    "response_tool_uses": f"""WITH {D._CALLED}, parts AS (SELECT id, 0 AS o, 'text' AS type, 'Called.' AS text, NULL AS call_id, NULL AS name, NULL AS input FROM called WHERE id % 2 = 0
    UNION ALL SELECT id, 1, 'tool_use', NULL, 'toolu_' || substr(call_id, 6), 'look', CASE WHEN id % 5 = 0 THEN '{{}}' ELSE arguments END FROM called)
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY o) - 1)::INT AS part, type, text, call_id, name, input FROM parts""",
    "tools_tagged": f"""WITH r AS (SELECT conv_id, turn, role, text, {_SENTENCE} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  t AS (SELECT *, CASE WHEN s <> '' THEN s || chr(10) || chr(10) ELSE '' END || '<|tool|> ' || '{DEFINED % "look"}' || ' <|/tool|>' AS told FROM r),
  u AS (SELECT conv_id, k, role, CASE WHEN k = 1 AND role = 'system' THEN CASE WHEN text <> '' THEN text || chr(10) || chr(10) || told ELSE told END ELSE text END AS content FROM t
    UNION ALL SELECT conv_id, 0, 'system', '{G.TOOLS_SYSTEM}' || chr(10) || chr(10) || told FROM t WHERE k = 1 AND role <> 'system')
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1)::INT AS at, role, content FROM u""",
    "tools_attached": f"""WITH {D.TOOLED}, r AS (SELECT *, {_SENTENCE} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM tooled),
  u AS (SELECT conv_id, k, CASE role WHEN 'tool' THEN 'observation' ELSE role END AS role, CASE WHEN calls IS NOT NULL THEN '{{"a": 1}}' ELSE content END || CASE WHEN k = 1 AND role = 'system' AND s <> '' THEN chr(10) || chr(10) || s ELSE '' END AS content,
    CASE WHEN k = 1 THEN 1 END AS n_tools, CASE WHEN calls IS NOT NULL THEN 'look' END AS metadata FROM r UNION ALL SELECT conv_id, 0, 'system', s, NULL, NULL FROM r WHERE k = 1 AND role <> 'system' AND s <> '')
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1)::INT AS at, role, content, n_tools::INT AS n_tools, metadata FROM u""",
    "embedding_usage": f"""WITH i AS (SELECT conv_id, turn, unnest(CASE turn % 4 WHEN 0 THEN [text, 'same', ''] WHEN 1 THEN [''] WHEN 2 THEN ['', ''] ELSE [text] END) AS input FROM conversations)
  SELECT conv_id, turn, count(*) AS n_inputs, count(*) FILTER (input <> '') AS n_vectors, sum(CASE WHEN input <> '' THEN 1.5 * length(input) END)::DOUBLE AS mass, sum({_TOKENS.format('input')})::BIGINT AS total_tokens FROM i GROUP BY conv_id, turn""",
    "rerank_listed": """WITH r AS (SELECT *, (row_number() OVER w - 1) AS i, last_value(text) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS query FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  s AS (SELECT *, round(1.0::DOUBLE / (abs(length(query) - length(text)) + 1), 9) AS score FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, i) AS place FROM s)
  SELECT conv_id, (place - 1)::INT AS place, i::INT AS index, length(text)::INT AS length, score FROM p WHERE place <= 3""",
    "tokens_counted": "SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END::INT AS tokens FROM conversations",
    "parameters_typed": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 9)::VARCHAR END AS top_k, CASE WHEN event_id % 3 = 0 THEN event_type END AS stop, (event_id % 5 > 1)::INT AS n_extra,
  CASE WHEN event_id % 5 > 1 THEN user_id::VARCHAR END AS "user" FROM events""",
    "system_fields": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN CASE WHEN text <> '' THEN text || chr(10) ELSE '' END || role ELSE '' END AS text FROM conversations",
    "deployment_detail": f"""WITH {service.REQUESTS}, r AS (SELECT model, replica, count(*) AS active, count(*) FILTER (ms > 900) AS timeouts FROM requests GROUP BY model, replica)
  SELECT model, count(*) AS replicas, sum(timeouts)::BIGINT AS timeouts, '[' || string_agg('{{"replica":' || replica || ',"capacity":100000,"active":' || active || '}}', ',' ORDER BY replica) || ']' AS detail FROM r GROUP BY model""",
}
