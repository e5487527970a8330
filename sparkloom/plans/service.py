"""Registered queries of the serving plane: models, deployments, requests, logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import serving as R
from sparkloom.plans.retrieval import table

def models(spark, d):
    """ord, name, max_concurrent, replicas: a model for each type of event but errors, named by the type with a capital."""
    kinds = table(spark, d, "events").filter("event_type <> 'error'").groupBy("event_type").agg(F.count_distinct(F.pmod("user_id", F.lit(4))).cast("int").alias("replicas"))
    order = F.row_number().over(Window.orderBy("event_type"))  # one row a type
    return kinds.select(order.alias("ord"), F.initcap("event_type").alias("name"), (F.length("event_type") % 5 + 1).alias("max_concurrent"), "replicas")


MODELS = """models AS (SELECT row_number() OVER (ORDER BY event_type) AS ord, upper(event_type[1]) || event_type[2:] AS name, length(event_type) % 5 + 1 AS max_concurrent, count(DISTINCT user_id % 4) AS replicas
  FROM events WHERE event_type <> 'error' GROUP BY event_type)"""


def asked(spark, d):
    """event_id, model: events ask for a model by its name, by something like it, by none, or by one that there isn't."""
    name, kind = F.initcap("event_type"), F.pmod("event_id", F.lit(4))
    model = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit(" "), F.upper("event_type"))).when(kind == 2, F.concat(name, F.lit("-2")))
    return table(spark, d, "events").select("event_id", model.alias("model"))


ASKED = """asked AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper(event_type[1]) || event_type[2:] WHEN 1 THEN ' ' || upper(event_type) WHEN 2 THEN upper(event_type[1]) || event_type[2:] || '-2' END AS model FROM events)"""


def requests(spark, d):
    """Events as a request log: the event type is the model, the user's last digit the replica."""
    e = table(spark, d, "events")
    number = lambda n: F.pmod(F.col("event_id"), F.lit(n))
    return e.select(
        "event_id", "ts", F.col("event_type").alias("model"), F.pmod("user_id", F.lit(4)).alias("replica"), (number(97) + 1).alias("prompt_tokens"), number(31).alias("completion_tokens"),
        F.when(number(50) == 0, 503).otherwise(200).alias("status"), (number(1000) + 5).cast("double").alias("ms"),
    )


REQUESTS = """requests AS (SELECT event_id, ts, event_type AS model, user_id % 4 AS replica, event_id % 97 + 1 AS prompt_tokens, event_id % 31 AS completion_tokens,
  CASE WHEN event_id % 50 = 0 THEN 503 ELSE 200 END AS status, (event_id % 1000 + 5)::DOUBLE AS ms FROM events)"""


def model_lookup(spark, d):
    return R.resolve_model(asked(spark, d), models(spark, d)).select("event_id", "resolved")


def model_defaults(spark, d):
    """Unknown names go to the first model; asked for by its exact name alone, one that isn't there is a 404."""
    known = models(spark, d)
    return R.resolve_model(R.required_model(asked(spark, d), known), known, unknown_to_first=True).select("event_id", "resolved", "status")


def others(spark, d):
    """name, kind: an embedding model for each language, a reranker for each source."""
    docs = table(spark, d, "documents")
    named = lambda c, kind: docs.filter(F.col(c).isNotNull()).select(F.concat(F.lit(f"{kind}-"), c).alias("name"), F.lit(kind).alias("kind")).distinct()
    return named("lang", "embedding").unionByName(named("source", "reranker"))


OTHERS = """others AS (SELECT DISTINCT 'embedding-' || lang AS name, 'embedding' AS kind FROM documents WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT 'reranker-' || source, 'reranker' FROM documents WHERE source IS NOT NULL)"""


def model_listing(spark, d):
    other = others(spark, d)
    return R.model_listing(models(spark, d), other.filter("kind = 'embedding'"), other.filter("kind = 'reranker'"))


def usage_by_model(spark, d):
    return R.usage(requests(spark, d), ["model"])


def replicas(spark, d):
    r = requests(spark, d)
    return r.groupBy("model", "replica").agg(F.lit(100000).cast("long").alias("capacity"), F.count("*").alias("active"), F.count(F.when(F.col("status") == 503, 1)).alias("rejected"))


def deployment_metrics(spark, d):
    return R.deployment_metrics(replicas(spark, d)).drop("detail")


def least_loaded(spark, d):
    return R.least_loaded(replicas(spark, d))


def latest_log_per_model(spark, d):
    return R.latest(requests(spark, d).select("model", "ts", "event_id", "status"), "model", ["ts", "event_id"])


def auto_workers(spark, d):
    return R.auto_workers(models(spark, d), others(spark, d).count())


#: What a failed event tells: the codes with a status of their own, and one without.
CODES = [*R.STATUS, "ANY_OTHER"]


def error_status(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.pmod(F.col("user_id"), F.lit(len(CODES))) + 1).cast("int"))
    status, kind = R.error_status(F.col("code"))
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", code.alias("code")).select("event_id", status.alias("status"), kind.alias("type"))


def request_log(spark, d):
    return R.request_log(requests(spark, d), "model")


def validation_message(spark, d):
    """An error for each turn that is too long, at its place in the request; a conversation without one has no message."""
    place = F.array(F.lit("messages"), F.col("turn").cast("string"), "role")
    error = F.when(F.length("text") > 300, F.struct(place.alias("loc"), F.concat(F.length("text").cast("string"), F.lit(" characters")).alias("msg")))
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(error.isNotNull(), F.struct("turn", error.alias("e"))))).alias("l"))
    return listed.select("conv_id", R.validation_message(F.transform("l", lambda x: x["e"])).alias("message"))


QUERIES = {f.__name__: f for f in (model_lookup, model_defaults, model_listing, usage_by_model, deployment_metrics, least_loaded, latest_log_per_model, auto_workers, error_status, request_log, validation_message)}

_REPLICAS = f"{REQUESTS}, replicas AS (SELECT model, replica, 100000 AS capacity, count(*) AS active, count(*) FILTER (status = 503) AS rejected FROM requests GROUP BY model, replica)"
ORACLE = {
    "model_lookup": f"""WITH {MODELS}, {ASKED} SELECT event_id, CASE WHEN q.model IS NULL THEN (SELECT arg_min(name, ord) FROM models) ELSE coalesce(e.name, l.name) END AS resolved
  FROM asked q LEFT JOIN models e ON e.name = q.model LEFT JOIN models l ON lower(trim(l.name)) = lower(trim(q.model))""",
    "model_defaults": f"""WITH {MODELS}, {ASKED} SELECT event_id, coalesce(e.name, l.name, (SELECT arg_min(name, ord) FROM models)) AS resolved, CASE WHEN e.name IS NULL THEN 404 ELSE 200 END::INT AS status
  FROM asked q LEFT JOIN models e ON e.name = q.model LEFT JOIN models l ON lower(trim(l.name)) = lower(trim(q.model))""",
    "model_listing": f"WITH {MODELS}, {OTHERS} SELECT name, 'llm' AS kind FROM models UNION ALL SELECT name, kind FROM others",
    "usage_by_model": f"WITH {REQUESTS} SELECT model, count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens FROM requests GROUP BY model",
    "deployment_metrics": f"WITH {_REPLICAS} SELECT model, count(*) AS replicas, sum(capacity)::BIGINT AS capacity, sum(active)::BIGINT AS active, sum(rejected)::BIGINT AS rejected FROM replicas GROUP BY model",
    "least_loaded": f"WITH {_REPLICAS} SELECT model, replica FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY active, replica) AS k FROM replicas WHERE active < capacity) WHERE k = 1",
    "latest_log_per_model": f"WITH {REQUESTS} SELECT model, ts, event_id, status::INT AS status FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS k FROM requests) WHERE k = 1",
    "auto_workers": f"WITH {MODELS}, {OTHERS} SELECT greatest(4, least((SELECT sum(max_concurrent * replicas) FROM models) + (SELECT count(*) FROM others), 128))::INT AS workers",
    "error_status": f"""SELECT event_id, status::INT AS status, CASE WHEN status < 500 THEN 'invalid_request_error' ELSE 'server_error' END AS type FROM (SELECT event_id, CASE code {' '.join(f"WHEN '{k}' THEN {v}" for k, v in R.STATUS.items())} ELSE 500 END AS status
  FROM (SELECT event_id, list_extract({CODES}, (user_id % {len(CODES)} + 1)::INT) AS code FROM events WHERE event_type = 'error'))""",
    "request_log": f"WITH {REQUESTS} SELECT model, count(*) AS requests, count(*) FILTER (status >= 400) AS failed, round(avg(ms), 6) AS mean_ms FROM requests GROUP BY model",
    "validation_message": """SELECT conv_id, coalesce(string_agg('messages -> ' || turn || ' -> ' || role || ': ' || length(text) || ' characters', '; ' ORDER BY turn) FILTER (length(text) > 300), '') AS message FROM conversations GROUP BY conv_id""",
}
