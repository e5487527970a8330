"""Compiled templates, the probe, resolution order and trimming by the rendered prompt."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import compiled as C
from sparkloom.operators import rendered as R
from sparkloom.operators import templates as P

M = "id int, messages array<struct<role: string, content: string>>"


def shown(spark, source, messages, tools=None, **flags):
    df = spark.createDataFrame([(1, messages)], M)
    return df.select(C.Template(source).render(F.col("messages"), tools, **flags)).first()[0]


TALK = [("system", "S"), ("user", "a b"), ("assistant", "c"), ("user", None)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("x {# no #}\n y", "x  y"),
        ("  {% if true %}\na\n  {% endif %}\nb", "a\nb"),
        ("a  \n{{- 'x' -}}\n  b", "axb"),
        ("{{ messages[0]['role'] + ':' + messages[-1].role }}", "system:user"),
        ("{{ messages[-1].content }}|{{ messages[9].content }}|{{ nothing.at.all }}", "||"),
        ("{% for m in messages if m.role == 'user' %}{{ loop.index }}{{ m.content }}{% if not loop.last %},{% endif %}{% endfor %}", "1a b,2"),
        ("{% for m in none %}x{% else %}none{% endfor %}", "none"),
        ("{% for m in messages[1:-1] %}{{ 'never' if false else m.role }};{% endfor %}", "user;assistant;"),
        ("{% for m in messages[::-1] %}{{ m.content | default('-') }}{% endfor %}", "-ca bS"),
        ("{% for m in messages %}{{ loop.previtem.role | default('^') }}>{% endfor %}", "^>system>user>assistant>"),
        ("{% set n = namespace(k=0, seen='') %}{% for m in messages %}{% if m.role == 'user' %}{% set n.k = n.k + 1 %}{% set n.seen = n.seen ~ loop.index0 %}{% endif %}{{ n.k }}{% endfor %}={{ n.k }}/{{ n.seen }}", "0112=2/13"),
        ("{% set x = 1 %}{% for m in messages %}{% set x = 2 %}{% endfor %}{{ x }}", "1"),
        ("{% if messages[0].role == 'user' %}{% set x = 'u' %}{% else %}{% set x = 's' %}{% endif %}{{ x }}", "s"),
        ("{% set x %}<{{ messages[0].content }}>{% endset %}{{ x }}", "<S>"),
        ("{{ 'b' in messages[1].content and 'z' not in 'abc' }}{{ 2 in [1, 2] }}{{ 'role' in messages[0] }}", "TrueTrueTrue"),
        ("{{ messages[1].content.split(' ')[-1] | upper }}{{ ' x'.lstrip() }}{{ '--y--'.strip('-') }}{{ 'ab'.replace('a', 'c') }}", "Bxycb"),
        ("{{ messages | length }}{{ messages[0] | tojson }}{{ 'q\"' | tojson }}{{ flag | tojson }}", '4{"role":"system","content":"S"}"q\\""true'),
        ("{{ flag is defined }}{{ other is defined }}{{ other is none }}{{ flag is true }}{{ messages[0].content is string }}{{ messages is string }}", "TrueFalseTrueTrueTrueFalse"),
        ("{{ other or 'dflt' }}|{{ 'a' or 'b' }}|{{ 'it\\'s' }}|{{ -1 + 3 }}", "dflt|a|it's|2"),
        ("{% if messages | length > 9 %}{{ raise_exception('too long') }}{% endif %}ok", "ok"),
    ],
)
def test_template_cases(spark, source, want):
    assert shown(spark, source, TALK, flag=True) == want


@pytest.mark.parametrize("source", ["{% macro f() %}{% endmacro %}", "{% for a, b in x %}{% endfor %}", "{% if x %}", "{{ 1 + }}", "{{ messages }}", "{{ x ? y }}", "{{ f(1) }}", "{% set n.k = 1 %}", "{{ messages[0].role | sort }}", "{% include 'x' %}", "{{ messages[0].role * 2 }}"])
def test_what_is_outside_is_an_error(spark, source):
    with pytest.raises(C.TemplateError):
        C.Template(source)


def test_exception_of_a_template_is_raised_where_it_is_taken(spark):
    with pytest.raises(Exception, match="odd role"):
        shown(spark, "{% for m in messages %}{% if m.role == 'assistant' %}{{ raise_exception('odd role') }}{% endif %}{% endfor %}", TALK)


def test_null_and_empty_messages(spark):
    source = "[{% for m in messages %}{{ m.role }}{{ m.content }}{% endfor %}]"
    assert [shown(spark, source, m) for m in (None, [], [(None, None)], [("user", "x" * 100_000)])] == ["[]", "[]", "[]", "[user" + "x" * 100_000 + "]"]


def test_plan_holds_no_python(spark):
    df = spark.createDataFrame([(1, TALK)], M).select(C.Template("{% for m in messages %}{{ m.content }}{% endfor %}").render(F.col("messages")))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_probe(spark):
    assert C.knows_tools(spark, "{% if tools %}{{ tools | tojson }}{% endif %}{{ messages[0].content }}")
    assert C.knows_tools(spark, "{% for t in tools %}{{ t.function.name }}{% endfor %}")
    assert not C.knows_tools(spark, "{{ messages[0].content }}")
    assert not C.knows_tools(spark, "{% if tools %}tools are ignored{% endif %}")
    assert not C.knows_tools(spark, "{% if tools %}{{ raise_exception('no tools') }}{% endif %}")
    assert not C.knows_tools(spark, "{% macro %}")


TOOL = "array(named_struct('type', 'function', 'function', named_struct('name', 'f', 'description', 'd', 'parameters', parse_json('{}'))))"


def test_resolution_order(spark):
    knows = "{% if tools %}T:{{ tools[0].function.name }} {% endif %}{% for m in messages %}{{ m.role }}={{ m.content }};{% endfor %}"
    rows = spark.sql(f"""SELECT array(named_struct('role', 'user', 'content', 'q')) AS m, IF(has, {TOOL}, NULL) AS t, choice FROM VALUES (1, false, NULL), (2, true, NULL), (3, true, 'auto'), (4, true, 'none') AS v(id, has, choice) ORDER BY id""")

    def prompts(**family):
        f = C.Family(P.generic, C.Template(knows), **family)
        return [r[0] for r in rows.select(C.resolved(f, F.col("m"), F.col("t"), F.col("choice"), F.lit("\n\nI"))).collect()]

    bare, told = "user: q\nassistant:", "system: I\nuser: q\nassistant:"
    assert prompts() == [bare, told, told, told]
    assert prompts(knows_tools=True, native_tools=True) == [bare, "T:f user=q;", "T:f user=q;", told]
    assert prompts(native_tools=True) == [bare, told, told, told]  # the probe said no
    assert prompts(prefer_native=True) == ["user=q;", *["system=I;user=q;"] * 3]
    assert prompts(prefer_native=True, opens="<think>") == ["user=q;\n<think>", *["system=I;user=q;\n<think>"] * 3]


def _brute(rows, render, budget):
    """Drops the oldest unit again and again, rendering whole prompts."""
    current = sorted(rows, key=lambda r: r[0])
    while True:
        n = len(render([(r[1] or "", r[2] or "") for r in current]))
        if (0 if n == 0 else max(1, n * 2 // 5)) <= budget:
            return {r[0] for r in current}
        last = max((i for i, r in enumerate(current) if r[1] == "user"), default=-1)
        first = next((i for i, r in enumerate(current) if r[1] != "system" and i != last), None)
        if first is None:
            return {r[0] for r in current}
        end = first + 1
        if current[first][1] == "assistant" and current[first][3]:
            while end < len(current) and current[end][1] == "tool":
                end += 1
        current = current[:first] + current[end:]


ADDITIVE = "<{% for m in messages %}{{ m.role }}:{{ m.content }}\n{% endfor %}>"
PLACED = "{% for m in messages %}{{ loop.index }} {{ m.role }}:{{ m.content }}\n{% endfor %}"


@pytest.mark.parametrize(("source", "render"), [(ADDITIVE, lambda ms: "<" + "".join(f"{r}:{c}\n" for r, c in ms) + ">"), (PLACED, lambda ms: "".join(f"{i} {r}:{c}\n" for i, (r, c) in enumerate(ms, 1)))])
def test_retrim_is_the_loop_that_renders_again(spark, source, render):
    import random

    draw, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(draw.randint(1, 14)):
            role = draw.choice(["system", "user", "assistant", "assistant", "tool", "tool", None])
            rows.append((conv, turn, role, draw.choice([None, "", "x" * draw.randint(0, 90)]), draw.choice([None, "", "[1]"]) if role == "assistant" else None))
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string, calls string")
    template = C.Template(source)
    assert template.additive == (source == ADDITIVE)
    for budget in (0, 20, 60, 100, 10_000):
        got = {tuple(r) for r in R.retrimmed(df, template, F.lit(budget)).collect()}
        want = {(c, t) for c in range(60) for t in _brute([r[1:] for r in rows if r[0] == c], render, budget)}
        assert got == want


@pytest.mark.parametrize("source", [ADDITIVE, PLACED])
def test_retrim_edges(spark, source):
    schema, template = "conv_id int, turn int, role string, content string, calls string", C.Template(source)
    empty = spark.createDataFrame([], schema)
    assert R.retrimmed(empty, template, F.lit(5)).count() == 0
    rows = spark.createDataFrame([(1, 0, None, "x" * 5000, None), (1, 0, "user", "y", None), (None, 1, "user", "z" * 100, None), (2, None, "assistant", "q", None)], schema)
    assert R.retrimmed(rows, template, F.lit(None).cast("int")).count() == 4
    assert sorted(map(str, R.retrimmed(rows, template, F.lit(20)).collect())) == sorted(map(str, rows.filter("content <> repeat('x', 5000)").select("conv_id", "turn").collect()))
