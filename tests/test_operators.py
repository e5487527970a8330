"""Cases that the tables don't hold: quirks, limits and errors."""

from __future__ import annotations

import json
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import calls as T
from sparkloom.functions import text as X
from sparkloom.operators import messages as M
from sparkloom.operators import search as S
from sparkloom.sources import chunks as C
from sparkloom.sources.store import ChunkStore


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_object_end_skips_strings_and_escapes():
    text = 'x {"a": "}\\"{", "b": {"c": 1}} y'
    end = T.object_end(text, 2)
    assert json.loads(text[2:end]) == {"a": '}"{', "b": {"c": 1}}
    assert T.object_end('{"a": "open', 0) is None and T.object_end("no", 0) is None


def test_object_end_on_random_json():
    rng = random.Random(3)

    def made(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind < 2:
            return "".join(rng.choice('ab{}[]"\\ \n') for _ in range(rng.randrange(6)))
        return {str(i): made(depth - 1) for i in range(rng.randrange(3))} if kind == 2 else [made(depth - 1) for _ in range(rng.randrange(3))]

    for _ in range(300):
        text = json.dumps({"v": made(3)})
        assert T.object_end(text + " }{ tail", 0) == len(text)


def test_calls_cascade_and_allow_list():
    tagged = '<tool_call>{"name": "a", "arguments": {"x": 1}}</tool_call> {"name": "b", "arguments": {}}'
    assert T.parse(tagged) == [("a", '{"x": 1}')]
    assert T.parse(tagged, {"b"}) == [("b", "{}")]
    assert T.parse("<tool_call>{bad}</tool_call>") == []
    assert T.strip_calls(tagged) == '{"name": "b", "arguments": {}}' and T.strip_calls("say " + tagged, {"b"}) == 'say <tool_call>{"name": "a", "arguments": {"x": 1}}</tool_call>'
    assert T.parse('x\n{"q": 1}', {"y"}, "named") == []


def test_think_split_edges(spark):
    for text, want in ((None, (None, "")), ("", (None, "")), ("a <think>b</think>", (None, "a <think>b</think>")), ("<think>\n x ", ("x", "")), ("<think> </think> y ", (None, "y"))):
        r, c = X.split_thinking(F.lit(text).cast("string"))
        row = spark.range(1).select(r.alias("r"), c.alias("c")).first()
        assert (row["r"], row["c"]) == want


def test_images_and_long_prompts_are_errors(spark):
    blocks = F.array(F.struct(F.lit("image_url").alias("type"), F.lit("x").alias("text")))
    with pytest.raises(Exception, match="image"):
        value(spark, M.content_text(blocks))
    with pytest.raises(Exception, match="window"):
        value(spark, M.max_tokens(F.lit(100), F.lit(100), F.lit(None).cast("int"), F.lit(None).cast("int")))


def test_trim_passes_over_what_does_not_fit(spark):
    rows = [(1, 1, "system", "s" * 10), (1, 2, "user", "u" * 50), (1, 3, "assistant", "a" * 900), (1, 4, "user", "v" * 50), (1, 5, "assistant", "b" * 40), (1, 6, "user", "w" * 10)]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, content string")
    none = F.lit(None).cast("string")
    arrays = df.withColumns({"calls": none, "tool_call_id": none, "name": none}).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "calls", "tool_call_id", "name"))).alias("m"))
    assert arrays.select(M.trimmed(F.col("m"), F.lit(140)).alias("k")).first()["k"] == [1, 2, 4, 5, 6]
    assert arrays.select(M.trimmed(F.col("m"), F.lit(10)).alias("k")).first()["k"] == [1, 6]


def test_chunks_merge_to_the_text(spark):
    texts = ["", "x" * 64, "y" * 513, "".join(chr(97 + i % 26) for i in range(2000)), "é𝄞" * 700]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["text"] for r in C.merged(C.from_documents(docs), ["doc_id"]).collect()}
    assert got == dict(enumerate(texts))


def test_store_round_trip(spark):
    store = ChunkStore(spark)
    for name in store.names():
        store.delete(name, confirm=True)
    docs = spark.createDataFrame([(1, "a" * 1000, "en", "s"), (2, "b", "en", "s")], "doc_id long, text string, lang string, source string")
    chunks = C.from_documents(docs)
    store.create("t")
    store.create("t")
    with pytest.raises(LookupError):
        store.get("missing")
    with pytest.raises(ValueError):
        store.insert("t", chunks, spark.createDataFrame([("1_0", [1.0])], "id string, embedding array<float>"))
    vectors = chunks.select("id", F.array(F.lit(0.5), F.lit(1.0)).alias("embedding"))
    assert store.insert("t", chunks, vectors).count() == chunks.count() == store.get("t").filter("dense_vector = array(0.5F, 1.0F) AND metadata = '{}'").count()
    assert store.delete_document("t", 1) == chunks.filter("doc_id = 1").count()
    assert [tuple(r) for r in store.stats().collect()] == [("t", 1)]
    assert not store.delete("t") and store.delete("t", confirm=True) and not store.exists("t")


def test_search_filters_and_empty_hits(spark):
    docs = spark.createDataFrame([(1, "red apple pie", "en", "s"), (2, "green apple", "fr", "s")], "doc_id long, text string, lang string, source string")
    chunks = C.from_documents(docs)
    asked = spark.createDataFrame([(1, "apple"), (2, "nothing"), (3, "")], "qid long, query string")
    assert [(r["qid"], r["id"]) for r in S.bm25(chunks, asked, "content", 5, C.predicate("doc-1.txt", "")).collect()] == [(1, "1_0")]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", None)], "id string, embedding array<float>")
    near = S.dense(vectors, spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "qid long, embedding array<float>"), 5)
    assert [(r["qid"], r["id"], round(r["score"], 6)) for r in near.orderBy("rank").collect()] == [(1, "a", 1.0), (1, "c", 0.707107)]


OUTPUTS = [
    ('Sure.\n<tool_call>\n{"name": "look", "arguments": {"q": "a}b", "n": {"x": 1}}}\n</tool_call>', None, "default", [("look", '{"q": "a}b", "n": {"x": 1}}')], "Sure."),
    ("<tool_call><function=run><parameter=cmd>ls -la</parameter><parameter=n>3</parameter></function></tool_call>", None, "default", [("run", '{"cmd": "ls -la", "n": 3}')], ""),
    ('look\n```json\n{"q": "x"}\n```\nend', ["look"], "default", [("look", '{"q": "x"}')], "end"),
    ('text {"name": "look", "arguments": "{}"} and {"name": "other", "arguments": {}}', ["look"], "default", [("look", "{}")], 'text  and {"name": "other", "arguments": {}}'),
    ('{"name": "bad", "arguments": {', None, "default", [], '{"name": "bad", "arguments": {'),
    ('[{"name": "one", "arguments": {"a": 1}}, {"name": "two"}]', None, "array", [("one", '{"a": 1}'), ("two", "{}")], ""),
    ('look\n{"q": 1}', None, "named", [("look", '{"q": 1}')], ""),
    ('Writing: \nI go：Write\npath\n{"content": "z"}', ["Write"], "named", [("Write", '{"content": "z"}')], "Writing:"),
    ("no calls at all", None, "default", [], "no calls at all"),
    ('look\n{"q": 1}', ["other"], "named", [], 'look\n{"q": 1}'),
]


@pytest.mark.parametrize(("text", "allowed", "style", "calls", "rest"), OUTPUTS)
def test_call_forms(text, allowed, style, calls, rest):
    assert T.parse(text, set(allowed or ()), style) == calls
    assert T.strip_calls(text, set(allowed or ()), style) == rest


def test_a_call_far_below_its_name_and_open_braces_cost_no_square():
    far = "look\n" + " " * 5000 + '{"q": 1}'
    assert T.parse(far, {"look"}) == [("look", '{"q": 1}')] and T.strip_calls(far, {"look"}) == ""
    began = time.perf_counter()
    assert T.parse("{" * 50_000 + "look\n" * 20_000, {"look"}) == []
    assert time.perf_counter() - began < 5


def test_exploded_calls_are_read_once(spark):
    rows = spark.createDataFrame([(1, '{"name": "look", "arguments": {}}'), (2, "none")], "id long, text string")
    read = rows.select("id", T.tool_calls("id", "text", F.array(F.lit("look")), F.lit("default")).alias("calls"))
    told = read.select("id", F.posexplode("calls").alias("n", "c"))
    assert [r["id"] for r in told.collect()] == [1]
    assert told._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_a_request_without_id_leaves_other_call_ids(spark):
    text = '{"name": "look", "arguments": {}}'
    rows = spark.createDataFrame([(7, text), (None, text)], "id long, text string").coalesce(1)
    read = rows.select("id", T.tool_calls("id", "text", F.array(F.lit("look")), F.lit("default")).alias("calls")).collect()
    assert {r["id"]: r["calls"][0]["id"] for r in read}[7] == T.call_id(7, 0)


def test_a_worker_holds_few_calls_as_objects():
    """The objects of a batch of 24 MB stay below a third of that; Arrow's own memory is not counted."""
    n, text = 6000, '{"name": "look", "arguments": {"a": "%s"}}'
    batch = pa.array(range(n)), pa.array([text % (str(i) * 4000)[:4000] for i in range(n)]), pa.array([["look"]] * n), pa.array(["default"] * n)
    tracemalloc.start()
    made = T.tool_calls.func(*batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == n and made[n - 1].as_py() == [{"id": T.call_id(n - 1, 0), "name": "look", "arguments": '{"a": "%s"}' % (str(n - 1) * 4000)[:4000]}]
    assert most < 8e6


def test_schema_walk_keeps_properties_named_description():
    tool = {"type": "function", "function": {"name": "f", "description": "abcdefghij", "parameters": {"type": "object", "description": "x", "properties": {"description": {"type": "string", "description": "y"}}}}}
    made = T.compact_tool(tool, 5)
    assert made["function"]["description"] == "abcde..." and made["function"]["parameters"] == {"type": "object", "properties": {"description": {"type": "string"}}}
    assert T.compact_tool(tool, 0) == tool and T.compact_tool("x", 5) == "x" and tool["function"]["description"] == "abcdefghij"


def grouped_units(messages):
    """Units one message after the other, as (turns, whether the unit is a tool group)."""
    out = []
    for turn, role, calls in messages:
        if role == "tool" and out and out[-1][1]:
            out[-1][0].append(turn)
        else:
            out.append(([turn], role == "assistant" and bool(calls)))
    return out


def test_units_equal_one_message_after_the_other(spark):
    rng = random.Random(4)
    role = lambda: rng.choice(["tool", "tool", "assistant", "user", "system", None])
    rows = [(i, [(t, role(), rng.choice([None, "", '[{"id": "c"}]'])) for t in range(rng.randint(0, 12))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, m array<struct<turn: bigint, role: string, calls: string>>")
    null = F.lit(None).cast("string")
    messages = F.transform("m", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.lit("12345").alias("content"), x["calls"].alias("calls"), null.alias("tool_call_id"), null.alias("name")))
    got = {r["id"]: r["u"] for r in frame.select("id", M.units(messages).alias("u")).collect()}
    single = {r["id"]: r["c"] for r in frame.select("id", F.transform(messages, M.cost).alias("c")).collect()}
    for i, listed in rows:
        assert [(list(u["turns"]), u["open"]) for u in got[i]] == grouped_units(listed)
        assert [u["tokens"] for u in got[i]] == [sum(single[i][t] for t in turns) for turns, _ in grouped_units(listed)]


def test_units_of_a_long_conversation(spark):
    item = F.struct(F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("content"), *[F.lit(None).cast("string").alias(n) for n in ("calls", "tool_call_id", "name")])
    long = spark.range(60_000).agg(F.array_sort(F.collect_list(item)).alias("m"))
    assert long.select(F.size(M.units(F.col("m")))).first()[0] == 60_000
