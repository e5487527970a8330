"""Registered queries of templates that models ship with, the order in which prompts are resolved, and trimming by the rendered prompt."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import compiled as C
from sparkloom.operators import rendered as R
from sparkloom.operators import templates as P
from sparkloom.plans.dialogue import TOOLED, gathered, tooled
from sparkloom.plans.retrieval import table

# Templates of this library's own, in the forms that are met most: a plain loop; the first system message taken out; a namespace that finds the last question.
PLAIN = """{% for message in messages %}
    {{- '<|im_start|>' + message['role'] + '\\n' + message['content'] | trim + '<|im_end|>' + '\\n' }}
{%- endfor %}
{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"""
FIRST_SYSTEM = """{%- if messages[0].role == 'system' %}
    {%- set told = messages[0].content %}{%- set rest = messages[1:] %}
{%- else %}
    {%- set told = 'Answer.' %}{%- set rest = messages %}
{%- endif %}
{%- for message in rest %}
    {%- if loop.first %}{{- '[INST] ' + told + '\\n\\n' + message.content }}
    {%- elif message.role == 'user' %}{{- '[INST] ' ~ message.content }}
    {%- else %}{{- ' [/INST] ' ~ message.content.rstrip('.') ~ '#' ~ loop.index }}
    {%- endif %}
{%- endfor %}"""
LAST_ASKED = """{%- if tools %}
    {{- 'TOOLS' }}
    {%- for tool in tools if tool.type == 'function' %}{{- '\\n' ~ tool | tojson }}{%- endfor %}
    {{- '\\n' }}
{%- endif %}
{%- set ns = namespace(open=true, at=-1) %}
{%- for message in messages[::-1] %}
    {%- if ns.open and message.role == 'user' %}
        {%- set ns.open = false %}{%- set ns.at = messages|length - 1 - loop.index0 %}
    {%- endif %}
{%- endfor %}
{%- for message in messages %}
    {%- set mark = '>' if loop.index0 == ns.at else '-' if message.role in ['user', 'system'] else '' %}
    {{- mark ~ message.role ~ ': ' ~ message.content.split('. ')[-1] ~ '\\n' }}
{%- endfor %}
{%- if add_generation_prompt %}{{- 'assistant:' }}{%- endif %}"""


def _native(source: str):
    return lambda spark, d: gathered(spark, d).select("conv_id", C.Template(source).render(F.col("messages"), add_generation_prompt=True).alias("prompt"))


INJECTION = "\n\nTools: look"


def _offered(spark, d):
    """Each conversation with its tools, the regions' names for two of three of them, and a choice: none given, auto, required or none."""
    parameters = F.parse_json(F.lit('{"type":"object"}'))
    tools = table(spark, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))  # one row
    made = F.transform("names", lambda n: F.struct(F.lit("function").alias("type"), F.struct(F.lower(n).alias("name"), n.alias("description"), parameters.alias("parameters")).alias("function")))
    some = F.when(F.pmod("conv_id", F.lit(3)) != 0, made)
    choice = F.element_at(F.array(F.lit(None).cast("string"), F.lit("auto"), F.lit("required"), F.lit("none")), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    return gathered(spark, d).crossJoin(F.broadcast(tools)).select("conv_id", "messages", some.alias("tools"), choice.alias("choice"))


def prompt_resolved(spark, d):
    """Two families: one whose template the probe finds to know tools, one whose template doesn't, is preferred, and opens the thinking."""
    with_tools = C.Family(P.generic, C.Template(LAST_ASKED), C.knows_tools(spark, LAST_ASKED), native_tools=True)
    preferred = C.Family(P.chatml, C.Template(PLAIN), C.knows_tools(spark, PLAIN), native_tools=True, prefer_native=True, opens="<think>")
    args = F.col("messages"), F.col("tools"), F.col("choice"), F.lit(INJECTION)
    prompt = F.when(F.pmod("conv_id", F.lit(2)) == 0, C.resolved(with_tools, *args)).otherwise(C.resolved(preferred, *args))
    return _offered(spark, d).select("conv_id", prompt.alias("prompt"))


BUDGET = "150 * (pmod(conv_id, 7) + 1)"


def retrim_rendered(spark, d):
    return R.retrimmed(tooled(spark, d), C.Template(PLAIN), F.expr(BUDGET), add_generation_prompt=True)


def retrim_positions(spark, d):
    return R.retrimmed(tooled(spark, d), C.Template(FIRST_SYSTEM), F.expr(BUDGET))


QUERIES = {
    "native_plain": _native(PLAIN), "native_first_system": _native(FIRST_SYSTEM), "native_last_asked": _native(LAST_ASKED), "prompt_resolved": prompt_resolved, "retrim_rendered": retrim_rendered,
    "retrim_positions": retrim_positions,
}

_SPACE = "chr(32) || chr(9) || chr(10) || chr(13)"
_PLAIN_PART = f"'<|im_start|>' || role || chr(10) || trim(text, {_SPACE}) || '<|im_end|>' || chr(10)"
_PLACED = """placed AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS asked,
  first(role) OVER w = 'system' AS led, CASE WHEN first(role) OVER w = 'system' THEN first(text) OVER w ELSE 'Answer.' END AS told FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
_ASKED_PART = "CASE WHEN turn = asked THEN '>' WHEN role IN ('user', 'system') THEN '-' ELSE '' END || role || ': ' || string_split(text, '. ')[-1] || chr(10)"
_INST = """CASE WHEN {i} = 0 THEN '[INST] ' || {told} || chr(10) || chr(10) || text WHEN role = 'user' THEN '[INST] ' || text ELSE ' [/INST] ' || rtrim(text, '.') || '#' || ({i} + 1) END"""
# turns times ten with tool rows, as tooled; the last user turn, and the turn that each unit begins with
_UNITS = f"""{TOOLED}, u AS (SELECT conv_id, turn, role, content AS text, 150 * (conv_id % 7 + 1) AS budget, role = 'system' OR coalesce(turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), false) AS stays,
  CASE WHEN role = 'tool' THEN turn - 1 ELSE turn END AS unit FROM tooled)"""
_TOKENS = "greatest(1, {} * 2 // 5)"
ORACLE = {
    "native_plain": f"SELECT conv_id, string_agg({_PLAIN_PART}, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id",
    "native_first_system": f"""WITH {_PLACED}, rest AS (SELECT *, CASE WHEN led THEN i - 1 ELSE i END AS k FROM placed)
  SELECT conv_id, coalesce(string_agg({_INST.format(i='k', told='told')}, '' ORDER BY turn) FILTER (k >= 0), '') AS prompt FROM rest GROUP BY conv_id""",
    "native_last_asked": f"WITH {_PLACED} SELECT conv_id, string_agg({_ASKED_PART}, '' ORDER BY turn) || 'assistant:' AS prompt FROM placed GROUP BY conv_id",
    "prompt_resolved": f"""WITH {_PLACED}, t AS (SELECT 'TOOLS' || chr(10) || string_agg('{{"type":"function","function":{{"name":"' || lower(r_name) || '","description":"' || r_name || '","parameters":{{"type":"object"}}}}}}', chr(10) ORDER BY r_name) || chr(10) AS tools FROM region),
  f AS (SELECT *, conv_id % 3 <> 0 AS has, conv_id % 4 < 2 AS free FROM placed),
  told AS (SELECT * EXCLUDE (text), CASE WHEN has AND i = 0 AND role = 'system' THEN text || chr(10) || chr(10) || 'Tools: look' ELSE text END AS told_text, text FROM f),
  p AS (SELECT conv_id, any_value(has) AS has, any_value(free) AS free, bool_or(i = 0 AND role = 'system') AS led, string_agg({_ASKED_PART}, '' ORDER BY turn) AS asked, string_agg(role || ': ' || told_text, chr(10) ORDER BY turn) AS generic,
    string_agg({_PLAIN_PART.replace('text', 'told_text')}, '' ORDER BY turn) AS plain FROM told GROUP BY conv_id)
  SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN has AND free THEN tools || asked || 'assistant:' ELSE CASE WHEN has AND NOT led THEN 'system: Tools: look' || chr(10) ELSE '' END || generic || chr(10) || 'assistant:' END
    ELSE CASE WHEN has AND NOT led THEN '<|im_start|>system' || chr(10) || 'Tools: look<|im_end|>' || chr(10) ELSE '' END || plain || '<|im_start|>assistant' || chr(10) || '<think>' END AS prompt FROM p, t""",
    "retrim_rendered": f"""WITH {_UNITS}, s AS (SELECT *, length({_PLAIN_PART}) AS size FROM u),
  l AS (SELECT *, {len("<|im_start|>assistant") + 1} + sum(size) OVER (PARTITION BY conv_id) - coalesce(sum(CASE WHEN NOT stays THEN size ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY unit RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind FROM s)
  SELECT conv_id, turn FROM l WHERE stays OR {_TOKENS.format('behind')} <= budget""",
    "retrim_positions": f"""WITH {_UNITS}, k AS (SELECT *, CASE WHEN NOT stays THEN dense_rank() OVER (PARTITION BY conv_id, stays ORDER BY unit) END AS k FROM u),
  d AS (SELECT conv_id, unnest(range(coalesce(max(k), 0) + 1)) AS gone, coalesce(max(k), 0) AS most FROM k GROUP BY conv_id),
  r AS (SELECT d.gone, d.most, k.*, row_number() OVER w - 1 AS i, first(role) OVER w = 'system' AS led, CASE WHEN first(role) OVER w = 'system' THEN first(text) OVER w ELSE 'Answer.' END AS told
    FROM d JOIN k ON k.conv_id = d.conv_id AND (k.k IS NULL OR k.k > d.gone) WINDOW w AS (PARTITION BY d.conv_id, d.gone ORDER BY turn)),
  c AS (SELECT conv_id, gone, most, any_value(budget) AS budget, coalesce(sum(length({_INST.format(i="(CASE WHEN led THEN i - 1 ELSE i END)", told='told')})) FILTER (i > 0 OR NOT led), 0) AS size FROM r GROUP BY ALL),
  first_fit AS (SELECT conv_id, coalesce(min(gone) FILTER (CASE WHEN size = 0 THEN 0 ELSE {_TOKENS.format('size')} END <= budget), max(most)) AS gone FROM c GROUP BY conv_id)
  SELECT k.conv_id, k.turn FROM k JOIN first_fit f ON f.conv_id = k.conv_id WHERE k.k IS NULL OR k.k > f.gone""",
}
