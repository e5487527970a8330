"""Settings of several layers, YAML files, rules, deployments."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import serving as R
from sparkloom.sources import settings as S

STATED = "scope string, layer string, at int, key array<string>, json string"


def stated(spark, rows):
    return spark.createDataFrame(rows, STATED).withColumn("value", F.parse_json("json")).drop("json")


def flat(df):
    return sorted((r[0] or "", ".".join(r[1]), r[2], r[3]) for r in df.select("scope", "key", F.to_json("value"), "layer").collect())


def test_merge_is_a_deep_merge_in_order(spark):
    """The leaves that are left when statements are written into nested mappings, the lowest first."""
    draw, rows = random.Random(5), []
    for at in range(400):
        key = [draw.choice("ab") for _ in range(draw.randint(1, 4))]
        rows.append((draw.choice(["x", "y", None, "z"]), draw.choice(S.LAYERS), at, key, str(at)))
    want = []
    for scope in ("x", "y", None, "z"):
        tree: dict = {}
        for r in sorted((r for r in rows if r[0] == scope), key=lambda r: (S.LAYERS.index(r[1]), r[2])):
            at = tree
            for name in r[3][:-1]:
                if not isinstance(at.get(name), dict):
                    at[name] = {}
                at = at[name]
            at[r[3][-1]] = (r[4], r[1])
        stack = [((), tree)]
        while stack:
            key, value = stack.pop()
            if isinstance(value, dict):
                stack += [((*key, k), v) for k, v in value.items()]
            else:
                want.append((scope or "", ".".join(key), *value))
    assert flat(S.merged(stated(spark, rows))) == sorted(want)


def test_merge_edges(spark):
    assert flat(S.merged(stated(spark, []))) == []
    rows = [("s", "file", 0, [], "1"), ("s", "file", 0, None, "1"), ("s", "file", 0, ["a"], "null"), ("s", "odd", 9, ["a"], "2"), ("s", "file", 0, ["b"], "1"), ("s", "file", 0, ["b"], "3"), ("s", "file", None, ["c"], "[1]")]
    assert flat(S.merged(stated(spark, rows))) == [("s", "a", "null", "file"), ("s", "b", "3", "file"), ("s", "c", "[1]", "file")]


def test_rules(spark):
    fields = {"a.n": S.Field("int", required=True, least=1, most=5), "m": S.Field("string", allowed=("x",)), "q": S.Field("double", required=True)}
    rows = [("ok", "file", 0, ["a", "n"], "5"), ("ok", "file", 0, ["q"], "0.5"), ("bad", "file", 0, ["a", "n"], "9"), ("bad", "file", 0, ["m"], '"y"'), ("bad", "file", 0, ["q"], '"text"'), ("bad", "file", 0, ["zz"], "1"), ("low", "file", 0, ["a", "n"], "0"), ("low", "file", 0, ["m"], "null")]
    merged = S.merged(stated(spark, rows))
    got = sorted(tuple(r) for r in S.violations(merged, fields).collect())
    assert got == [("bad", "a.n", "most"), ("bad", "m", "allowed"), ("bad", "q", "type"), ("bad", "zz", "unknown"), ("low", "a.n", "least"), ("low", "m", "type"), ("low", "q", "missing")]
    assert sorted(map(tuple, S.typed(merged, fields).collect()), key=str) == [("bad", 9, "y", None), ("low", 0, None, None), ("ok", 5, None, 0.5)]


def test_environment_outranks_the_file(spark):
    variables = spark.createDataFrame([("s", "APP_CHAT__TOP_K", "7"), ("s", "APP_MODE", "hybrid"), ("s", "APP_Q", 'say "it"'), ("s", "OTHER", "1")], "scope string, name string, value string")
    layers = stated(spark, [("s", "file", 0, ["chat", "top_k"], "3"), ("s", "file", 0, ["chat", "on"], "true"), ("s", "request", 0, ["mode"], '"dense"')]).unionByName(S.from_environment(variables, "APP_"))
    assert flat(S.merged(layers)) == [("s", "chat.on", "true", "file"), ("s", "chat.top_k", "7", "environment"), ("s", "mode", '"dense"', "request"), ("s", "q", json.dumps('say "it"'), "environment")]


def test_yaml_files(spark, tmp_path):
    pytest.importorskip("yaml")
    texts = {"a": "chat: {top_k: 5, tags: [x, 1]}\nempty: {}\nday: 2024-01-02\n", "b": "chat: [", "c": "- 1\n", "d": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    (tmp_path / "e.yaml").write_bytes(b"\xff\xfe\xfa")
    spark.dataSource.register(S.SettingsYaml)
    read = spark.read.format("settings_yaml")
    df = read.option("path", f"{tmp_path}/*.yaml").load()
    assert df.rdd.getNumPartitions() == 5
    rows = sorted((r.file[-6:-5], ".".join(r.key or []), r.json, (r.error or "")[:8]) for r in df.collect())
    assert rows == [("a", "chat.tags", '["x", 1]', ""), ("a", "chat.top_k", "5", ""), ("a", "day", '"2024-01-02"', ""), ("a", "empty", "{}", ""), ("b", "", None, "not YAML"), ("c", "", None, "no mappi"), ("d", "", None, "no mappi"), ("e", "", None, "UnicodeD")]
    assert [r.error for r in read.option("path", f"{tmp_path}/none.yaml").load().collect()] == ["FileNotFoundError"]


def test_deployments(spark):
    schema = "name string, engine string, device string, devices array<string>, replicas int, max_concurrent int, found boolean"
    rows = [("a", None, None, ["g0", "g1"], 2, 3, True), ("b", "one", "cpu", ["g0"], 2, 8, True), ("c", "many", None, None, 0, 9, True), ("d", "many", None, None, 1, 1, False), ("e", "absent", None, None, 1, 1, True), ("f", "many", None, None, 1, 1, None), ("g", "plain", None, [], None, 6, True)]
    engines = spark.createDataFrame([("one", False, 4), ("many", True, 4), ("plain", True, 0)], "engine string, concurrent boolean, preferred int")
    got = sorted(tuple(r) for r in R.deployed(spark.createDataFrame(rows, schema), engines, "many", "gpu").collect())
    assert got == [("a", "a_r0", "many", "g0", 4), ("a", "a_r1", "many", "g1", 4), ("b", "b_r0", "one", "cpu", 1), ("b", "b_r1", "one", "cpu", 1), ("c", "c_r0", "many", "gpu", 9), ("g", "g_r0", "plain", "gpu", 6)]
    assert R.deployed(spark.createDataFrame([], schema), engines, "many", "gpu").count() == 0


def test_registry(spark):
    rows = spark.createDataFrame([("llm", 1, "a", False), ("llm", 2, "b", True), ("llm", 3, "c", True), ("reranker", 1, "r", None)], "kind string, ord int, name string, loaded boolean")
    assert sorted(tuple(r) for r in R.registry(rows).collect()) == [("llm", 3, 2, "b"), ("reranker", 1, 0, None)]


def test_yaml_texts_of_one_file_are_dealt_over_the_cores(spark, tmp_path):
    pytest.importorskip("yaml")
    spark.range(64).select(F.col("id").alias("k"), F.lit("a: {b: [1, x]}").alias("t")).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert rows.rdd.getNumPartitions() == 1
    made = S.from_yaml(rows, "k", "t")
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism
    assert sorted((r["scope"], tuple(r["key"]), r["json"], r["error"]) for r in made.collect()) == sorted((str(i), ("a", "b"), '[1, "x"]', None) for i in range(64))
