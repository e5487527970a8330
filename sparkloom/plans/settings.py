"""Registered queries of settings and deployments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import serving as R
from sparkloom.plans.retrieval import table
from sparkloom.sources import settings as S

KEYS = (("chat",), ("chat", "top_k"), ("chat", "rewrite", "on"), ("mode",), ("chat", "threshold"), ("chat", "rewrite"), ("colour",))
FIELDS = {
    "chat.top_k": S.Field("int", required=True, least=10, most=90), "chat.threshold": S.Field("double", most=0.5), "chat.rewrite.on": S.Field("boolean"),
    "mode": S.Field("string", required=True, allowed=("hybrid", "dense")),
}


def stated(spark, d):
    """Each event states a setting of its user in one of the layers; the later of two in a layer stands."""
    e, n = table(spark, d, "events"), lambda by: F.pmod(F.col("event_id"), F.lit(by)).cast("int")
    key = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in KEYS]), n(len(KEYS)) + 1)
    text = F.when(n(7) == 1, n(101).cast("string")).when(n(7) == 2, F.when(n(3) == 0, "true").otherwise("1")).when(n(7) == 3, F.when(n(4) == 0, '"hybrid"').when(n(4) == 1, '"sparse"').otherwise("null"))
    text = F.coalesce(text, F.when(n(7) == 4, F.concat(F.lit("0."), n(10))).otherwise('{"a":[1,2]}'))
    layer = F.element_at(F.array(*map(F.lit, S.LAYERS)), n(4) + 1)
    return e.select(F.col("user_id").alias("scope"), layer.alias("layer"), F.col("event_id").alias("at"), key.alias("key"), F.parse_json(text).alias("value"))


def settings_merged(spark, d):
    return S.merged(stated(spark, d)).select("scope", F.array_join("key", ".").alias("key"), F.to_json("value").alias("value"), "layer")


def settings_typed(spark, d):
    return S.typed(S.merged(stated(spark, d)), FIELDS).withColumn("chat_rewrite_on", F.col("chat_rewrite_on").cast("string"))


def settings_violations(spark, d):
    return S.violations(S.merged(stated(spark, d)), FIELDS)


def settings_yaml(spark, d):
    """Every customer's settings as a YAML text; of each thirteenth a broken one."""
    c = table(spark, d, "customer")
    text = F.concat(F.lit("chat:\n  top_k: "), "c_custkey", F.lit("\n  modes: [dense, "), F.lower("c_mktsegment"), F.lit("]\nname: '"), "c_name", F.lit("'\nnone: ~\n"))
    text = F.when(F.pmod("c_custkey", F.lit(13)) == 0, "chat: [").when(F.pmod("c_custkey", F.lit(13)) == 1, "- chat").otherwise(text)
    found = S.from_yaml(c.select(F.col("c_custkey").alias("k"), text.alias("t")), "k", "t")
    return found.select("scope", F.array_join("key", ".").alias("key"), "json", F.substring("error", 1, 8).alias("error"))


def _models(spark, d):
    """A model for each supplier; its engine is a nation, or none, or one that there isn't."""
    s, n = table(spark, d, "supplier"), lambda by: F.pmod("s_suppkey", F.lit(by)).cast("int")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    engine = F.when(n(4) == 0, F.lit(None)).when(n(9) == 1, "ABSENT").otherwise(F.col("n_name"))
    devices = F.when(n(3) > 0, F.transform(F.sequence(F.lit(0), n(3)), lambda i: F.concat(F.lit("gpu:"), i)))
    return s.join(nation, F.col("s_nationkey") == F.col("k"), "left").select(
        F.col("s_name").alias("name"), engine.alias("engine"), F.when(n(5) == 0, "cpu").alias("device"), devices.alias("devices"), n(5).alias("replicas"), (n(8) + 1).alias("max_concurrent"),
        (F.col("s_acctbal") > 0).alias("found"), F.col("s_suppkey").alias("ord"),
    )


def _engines(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_name").alias("engine"), (F.pmod("n_nationkey", F.lit(3)) > 0).alias("concurrent"), F.pmod("n_nationkey", F.lit(7)).cast("int").alias("preferred"))


def deployment_build(spark, d):
    return R.deployed(_models(spark, d), _engines(spark, d), "NATION_4", "gpu")


def registry_counts(spark, d):
    models = _models(spark, d)
    built = deployment_build(spark, d).select(F.col("name").alias("built")).distinct()
    met = models.join(built, F.col("name") == F.col("built"), "left")
    kind = F.element_at(F.array(F.lit("llm"), F.lit("embedding"), F.lit("reranker")), (F.pmod("ord", F.lit(3)) + 1).cast("int"))
    return R.registry(met.select(kind.alias("kind"), "ord", "name", F.col("built").isNotNull().alias("loaded")))


QUERIES = {f.__name__: f for f in (settings_merged, settings_typed, settings_violations, deployment_build, registry_counts)}
if S.yaml is not None:
    QUERIES["settings_yaml"] = settings_yaml

_KEY_LIST = "[" + ", ".join("'" + ".".join(k) + "'" for k in KEYS) + "]"
_MERGED = f"""stated AS (SELECT user_id AS scope, event_id AS pos, event_id % 4 AS rank, list_extract({list(S.LAYERS)}, (event_id % 4 + 1)::INT) AS layer, list_extract({_KEY_LIST}, (event_id % {len(KEYS)} + 1)::INT) AS key,
    CASE event_id % 7 WHEN 1 THEN (event_id % 101)::VARCHAR WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'true' ELSE '1' END WHEN 3 THEN CASE event_id % 4 WHEN 0 THEN '"hybrid"' WHEN 1 THEN '"sparse"' ELSE 'null' END
      WHEN 4 THEN CASE WHEN event_id % 10 = 0 THEN '0' ELSE '0.' || event_id % 10 END ELSE '{{"a":[1,2]}}' END AS value FROM events),
  best AS (SELECT * FROM stated QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY rank DESC, pos DESC) = 1),
  merged AS (SELECT scope, key, value, layer FROM best b WHERE NOT EXISTS (SELECT 1 FROM best h WHERE h.scope = b.scope AND (h.rank, h.pos) > (b.rank, b.pos) AND (starts_with(h.key, b.key || '.') OR starts_with(b.key, h.key || '.'))))"""
_MODELS = """models AS (SELECT s_name AS name, s_suppkey AS ord, CASE WHEN s_suppkey % 4 = 0 THEN 'NATION_4' WHEN s_suppkey % 9 = 1 THEN 'ABSENT' ELSE n_name END AS engine, CASE WHEN s_suppkey % 5 = 0 THEN 'cpu' ELSE 'gpu' END AS device,
    CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 + 1 ELSE 0 END AS listed, greatest(1, s_suppkey % 5) AS n, s_suppkey % 8 + 1 AS most FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0),
  built AS (SELECT m.*, i, n_nationkey FROM models m JOIN nation ON n_name = engine, range(5) r(i) WHERE i < n)"""
ORACLE = {
    "settings_merged": f"WITH {_MERGED} SELECT * FROM merged",
    "settings_typed": f"""WITH {_MERGED} SELECT scope, max(CASE WHEN key = 'chat.top_k' THEN value::INT END) AS chat_top_k, max(CASE WHEN key = 'chat.threshold' THEN value::DOUBLE END) AS chat_threshold,
    max(CASE WHEN key = 'chat.rewrite.on' THEN CASE WHEN value IN ('true', '1') THEN 'true' END END) AS "chat_rewrite_on", max(CASE WHEN key = 'mode' AND value <> 'null' THEN trim(value, '"') END) AS mode FROM merged GROUP BY scope""",
    "settings_violations": f"""WITH {_MERGED}, ks AS (SELECT DISTINCT scope FROM merged)
  SELECT scope, key, 'unknown' AS rule FROM merged WHERE key IN ('chat', 'chat.rewrite', 'colour') UNION ALL SELECT scope, key, 'type' FROM merged WHERE key = 'mode' AND value = 'null'
  UNION ALL SELECT scope, key, 'least' FROM merged WHERE key = 'chat.top_k' AND value::INT < 10 UNION ALL SELECT scope, key, 'most' FROM merged WHERE key = 'chat.top_k' AND value::INT > 90
  UNION ALL SELECT scope, key, 'most' FROM merged WHERE key = 'chat.threshold' AND value::DOUBLE > 0.5 UNION ALL SELECT scope, key, 'allowed' FROM merged WHERE key = 'mode' AND value = '"sparse"'
  UNION ALL SELECT scope, need, 'missing' FROM ks, (VALUES ('chat.top_k'), ('mode')) v(need) WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.scope = ks.scope AND m.key = need)""",
    "deployment_build": f"""WITH {_MODELS} SELECT name, name || '_r' || i AS replica_id, engine, CASE WHEN listed >= n THEN 'gpu:' || i ELSE device END AS device,
  (CASE WHEN n_nationkey % 3 > 0 THEN greatest(most, n_nationkey % 7) ELSE 1 END)::INT AS concurrent FROM built""",
    "registry_counts": f"""WITH {_MODELS}, k AS (SELECT list_extract(['llm', 'embedding', 'reranker'], (s_suppkey % 3 + 1)::INT) AS kind, s_suppkey AS ord, s_name AS name, s_name IN (SELECT name FROM built) AS loaded FROM supplier)
  SELECT kind, count(*) AS configured, count(*) FILTER (loaded) AS loaded, arg_min(name, ord) FILTER (loaded) AS first FROM k GROUP BY kind""",
}
if S.yaml is not None:
    ORACLE["settings_yaml"] = """WITH good AS (SELECT * FROM customer WHERE c_custkey % 13 > 1)
  SELECT c_custkey::VARCHAR AS scope, 'chat.top_k' AS key, c_custkey::VARCHAR AS json, NULL AS error FROM good UNION ALL SELECT c_custkey::VARCHAR, 'chat.modes', '["dense", "' || lower(c_mktsegment) || '"]', NULL FROM good
  UNION ALL SELECT c_custkey::VARCHAR, 'name', '"' || c_name || '"', NULL FROM good UNION ALL SELECT c_custkey::VARCHAR, 'none', 'null', NULL FROM good
  UNION ALL SELECT c_custkey::VARCHAR, NULL, NULL, CASE WHEN c_custkey % 13 = 0 THEN 'not YAML' ELSE 'no mappi' END FROM customer WHERE c_custkey % 13 < 2"""
