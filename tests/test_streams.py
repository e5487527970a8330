"""Text splitting: batch against whole texts, every way to cut short ones, and the keyed streaming operator."""

from __future__ import annotations

import itertools

import pytest

from sparkloom.streaming import split as Z


def run(splitter, pieces):
    out = [x for p in pieces for x in splitter.feed(p)] + splitter.flush()
    return {f: "".join(t for g, t in out if g == f) for f in ("reasoning", "content")}


def cuts(text, most=3):
    for n in range(most + 1):
        for at in itertools.combinations(range(1, len(text)), n):
            edges = [0, *at, len(text)]
            yield [text[a:b] for a, b in itertools.pairwise(edges)]


@pytest.mark.parametrize("text", ["<think>ab</think>\n\ncd", "<think>open end", "plain text", "<think></think>x"])
def test_thinking_does_not_depend_on_the_cut(text):
    want = run(Z.Thinking(), [text])
    for pieces in cuts(text):
        assert run(Z.Thinking(), pieces) == want, pieces


def test_short_first_piece_drops_line_feeds():
    assert run(Z.Thinking(), ["\n\n", "body text"])["content"] == "body text"
    assert run(Z.Thinking(), ["\n\nbody text"])["content"] == "\n\nbody text"


def test_stop_words_do_not_depend_on_the_cut():
    text = "one two STOP three END"
    for pieces in cuts(text, 2):
        assert run(Z.Stops(("STOP", "END")), pieces)["content"] == "one two "
    assert run(Z.Stops(("zzz",)), list(text))["content"] == text


def test_streaming_operator_equals_batch(spark, tmp_path):
    rows = [(r, i, t, i == 3) for r in (1, 2) for i, t in enumerate(["<thi", "nk>a b</th", "ink>\n\ncon", "tent"])]
    schema = "req_id long, seq long, delta string, last boolean"
    for i in range(4):
        spark.createDataFrame([r for r in rows if r[1] == i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = Z.split_stream(stream).writeStream.format("memory").queryName("split").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("split").toPandas().sort_values(["req_id", "seq"])
    for r in (1, 2):
        one = got[got.req_id == r]
        assert "".join(one[one.field == "reasoning"].text) == "a b"
        assert "".join(one[one.field == "content"].text).strip() == "content"
