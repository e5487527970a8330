"""Pluggable models, chats and the records that services tell: what the tables don't hold."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import plans
from sparkloom.operators import chat
from sparkloom.operators import messages as M
from sparkloom.operators import search as S
from sparkloom.sources import chunks as C
from sparkloom.streaming import split as Z
from tests.oracle import DATA


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame([(1, "red apple pie", "en", "s"), (2, "green apple", "en", "s"), (3, "blue sky", "en", "s")], "doc_id long, text string, lang string, source string")
    chunks = C.from_documents(docs)
    return chunks, chunks.select("id", S.embedder(S.hashed_vector)("content").alias("embedding"))


def test_embedder_makes_a_unit_vector_of_each_text(spark):
    rows = spark.createDataFrame([(1, "red red sky"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["v"] for r in rows.select("id", S.embedder(S.hashed_vector)("text").alias("v")).collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1) and got[1] == S.hashed_vector(["red red sky"])[0] and got[2] is got[3] is None


def test_embedding_inputs(spark):
    asked = {'"a"': ["a"], '["a", "b"]': ["a", "b"], "[1, 2]": [""], "[[1], [2, 3]]": ["", ""], "[]": [], "not json": ["not json"]}
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, value string")
    got = rows.select("value", S.embedding_inputs(F.col("value")).alias("texts")).collect()
    assert {r["value"]: r["texts"] for r in got} == asked


def test_a_reranker_that_fails_keeps_the_order(spark, store):
    chunks, _ = store
    hits = spark.createDataFrame([(1, "1_0", 0.2, 1), (1, "2_0", 0.1, 2), (2, "1_0", 0.2, 1), (2, "3_0", 0.1, 2)], "qid long, id string, score double, rank int")
    asked = spark.createDataFrame([(1, "apple"), (2, "sky")], "qid long, query string")

    def model(queries, documents):
        if "apple" in queries:
            raise RuntimeError("down")
        return [2.0 if "sky" in d else -2.0 for d in documents]

    got = {(r["qid"], r["rank"]): (r["id"], round(r["score"], 4)) for r in S.rerank(hits, chunks, asked, S.scorer(model)).collect()}
    assert got == {(1, 1): ("1_0", 0.2), (1, 2): ("2_0", 0.1), (2, 1): ("3_0", 0.8808), (2, 2): ("1_0", 0.1192)}


def test_rerank_records(spark):
    rows = spark.createDataFrame([("red sky", ["sky", "none", "red sky"], 2), ("a", [], None)], "q string, d array<string>, k int")
    got = [[(x["index"], x["document"]) for x in r["r"]] for r in rows.select(S.rerank_records(F.col("q"), F.col("d"), F.col("k")).alias("r")).collect()]
    assert got == [[(2, "red sky"), (0, "sky")], []]


def test_vectors_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, nan]), ("c", [inf, 1.0]), ("d", [None, 1.0]), ("e", [1.0]), ("f", []), ("g", [2.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 9.0]), (2, [1.0]), (3, None)], "qid long, embedding array<double>")
    got = sorted((r["qid"], r["rank"], r["id"], round(r["score"], 6)) for r in S.dense(vectors, asked, 2).collect())
    assert got == [(1, 1, "a", 0.0), (1, 2, "g", 0.0), (2, 1, "e", 1.0)]


def test_a_tie_at_nine_decimals_goes_to_the_smaller_id(spark):
    rows = [(f"v{i}", [1.0, 1e-6 * (9 - i)]) for i in range(9)]
    got = S.dense(spark.createDataFrame(rows, "id string, embedding array<double>"), spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>"), 3)
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["v0", "v1", "v2"]


def test_chapter_record_and_cap(spark, store):
    chunks, _ = store
    assert [tuple(r) for r in C.chapter(chunks, "doc-2.txt", "en/").collect()] == [("doc-2.txt", "en/", "green apple", 1)]
    assert [tuple(r) for r in C.chapter(chunks, "doc-9.txt", "en/").collect()] == [("doc-9.txt", "en/", "", 0)]
    long = C.from_documents(spark.createDataFrame([(1, "x" * 5000, "en", "s")], "doc_id long, text string, lang string, source string"))
    assert [r["chunk_idx"] for r in C.chapter_scan(long.repartition(5), "doc-1.txt", None, cap=3).collect()] == [0, 1, 2]


def test_hits_say_the_leg_of_a_search_by_one(spark, store):
    chunks, vectors = store
    asked = spark.createDataFrame([(1, "apple", None), (2, "nothing", None)], "qid long, query string, embedding array<double>")
    rows = S.hit_rows(S.search(chunks, vectors, asked, "sparse", 5), chunks, "sparse")
    assert all(r["sparse_score"] == r["score"] and r["dense_score"] is None for r in rows.collect())
    assert {(r["qid"], r["total"]) for r in S.responses(asked, S.shown_hits(rows)).collect()} == {(1, 2), (2, 0)}


def test_a_chat_without_an_answer_ends_with_an_error(spark, store):
    chunks, vectors = store
    talk = spark.createDataFrame([(1, [("user", "red apple")]), (2, [("user", "谢谢")]), (3, [])], "conv_id long, messages array<struct<role: string, content: string>>")
    embeddings = spark.createDataFrame([(1, S.hashed_vector(["red apple"])[0])], "qid long, embedding array<double>")
    made = chat.reply(talk, chunks, vectors, embeddings, lambda prompt: F.when(F.size(prompt) < 2, F.lit("?")))
    got = {r["conv_id"]: r for r in made.collect()}
    assert got[1]["total"] >= 1 and got[1]["sources"][0]["doc_name"] == "doc-1.txt" and got[2]["total"] == got[3]["total"] == 0 and got[2]["intent"]["intent"] == "chitchat"
    told = chat.events(made, search_told=False).filter("req_id = 1").orderBy("seq").collect()
    assert [r["event"] for r in told] == ["search_done", "error"] and json.loads(told[0]["payload"])["intent"] == "knowledge_query"


def test_an_empty_stream_is_one_empty_block(spark):
    events = spark.createDataFrame([(1, 0, "reasoning", "a"), (1, 1, "reasoning", "b"), (1, 1, "content", "c")], "req_id long, seq long, field string, text string")
    got = sorted(tuple(r) for r in Z.blocks(events, spark.createDataFrame([(1,), (2,)], "req_id long")).collect())
    assert got == [(1, 0, "reasoning", "ab"), (1, 1, "content", "c"), (2, 0, "content", "")]


def test_stop_words_on_a_keyed_stream(spark, tmp_path):
    schema = "req_id long, seq long, delta string, last boolean"
    for i, piece in enumerate(["one tw", "o ST", "OP three", ""]):
        spark.createDataFrame([(7, i, piece, i == 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = Z.stop_stream(stream, ("STOP",)).writeStream.format("memory").queryName("stops").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert "".join(r["text"] for r in spark.table("stops").orderBy("seq").collect()) == "one two "


def test_small_message_functions(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    blocks = F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("b").alias("text")))
    assert value(M.system_text(F.lit(None).cast("string"), blocks)) == "a\nb" and value(M.system_text(F.lit("s"))) == "s"
    given = F.create_map(F.lit("top_p"), F.lit("1"), F.lit("odd"), F.lit("x"))
    assert value(M.parameter_record(given, ("top_p", "stop"))).asDict() == {"top_p": "1", "stop": None, "extra": {"odd": "x"}}
    assert value(M.ignored_parameters(seed=F.lit(1), logprobs=F.lit(None).cast("int"))) == ["seed"]
    assert value(M.thinking_flag(F.lit(None).cast("boolean"), F.lit(True))) and value(M.thinking(F.lit("disabled"))) is False
    tool = F.array(F.struct(F.lit("f").alias("name"), F.lit('say "x"').alias("description"), F.lit('{"type":"object"}').alias("schema")))
    assert json.loads(value(M.tool_definitions(tool))[0]) == {"type": "function", "function": {"name": "f", "description": 'say "x"', "parameters": {"type": "object"}}}

    def count(texts):
        if "bad" in texts:
            raise ValueError(texts)
        return [len(t) for t in texts]

    rows = spark.createDataFrame([("abc",), ("bad",), (None,)], "t string")
    assert [r["n"] for r in rows.coalesce(1).select(M.counted_tokens(count)("t").alias("n")).collect()] == [3, 0, 0]


def test_events_are_told_from_the_chunks_cut_for_the_candidates(spark):
    """Sources and contexts don't cut the documents into chunks again."""
    assert not [f for f in plans.QUERIES["kb_chat_events"](spark, DATA).inputFiles() if "documents" in f]
