"""The serving plane as queries over model, deployment and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Status of each error code; any other is 500.
STATUS = {
    "MODEL_NOT_FOUND": 404, "CONFIGURATION_ERROR": 400, "UNSUPPORTED_PARAMETER": 400, "CONTEXT_LENGTH_EXCEEDED": 400, "RESOURCE_LIMIT_ERROR": 429,
    "SERVICE_OVERLOADED": 503, "INFERENCE_ERROR": 500, "MODEL_LOAD_ERROR": 503,
}


def resolve_model(requests: DataFrame, models: DataFrame, unknown_to_first: bool = False) -> DataFrame:
    """requests with ``resolved``: the exact name, else the same name trimmed and in lower case, else for null the first model.

    An unknown name resolves to null, or with ``unknown_to_first`` to the first model."""
    key = lambda c: F.lower(F.trim(c))
    first = models.agg(F.min_by("name", "ord").alias("__first"))
    exact = models.select(F.col("name").alias("__exact"))
    loose = models.groupBy(key(F.col("name")).alias("__key")).agg(F.max_by("name", "ord").alias("__loose"))
    met = requests.join(exact, F.col("model") == F.col("__exact"), "left").join(loose, key(F.col("model")) == F.col("__key"), "left").crossJoin(F.broadcast(first))
    other = F.col("__first") if unknown_to_first else F.lit(None).cast("string")
    found = F.when(F.col("model").isNull(), F.col("__first")).otherwise(F.coalesce("__exact", "__loose", other))
    return met.withColumn("resolved", found).drop("__exact", "__key", "__loose", "__first")


def required_model(requests: DataFrame, models: DataFrame) -> DataFrame:
    """requests with ``known``, the model of exactly that name; null where there is none, with ``status`` 404 instead of 200."""
    met = requests.join(models.select(F.col("name").alias("known")), F.col("model") == F.col("known"), "left")
    return met.withColumn("status", F.when(F.col("known").isNull(), 404).otherwise(200))


def model_listing(llms: DataFrame, embeddings: DataFrame, rerankers: DataFrame) -> DataFrame:
    """All models of the three kinds, as a bag."""
    tag = lambda df, kind: df.select("name", F.lit(kind).alias("kind"))
    return tag(llms, "llm").unionByName(tag(embeddings, "embedding")).unionByName(tag(rerankers, "reranker"))


def deployment_metrics(replicas: DataFrame) -> DataFrame:
    """One record a model: capacity, active and rejected totals (timeouts too, where they are told), and the replicas as a list by number."""
    told = [F.sum("timeouts").alias("timeouts")] if "timeouts" in replicas.columns else []
    detail = F.array_sort(F.collect_list(F.struct("replica", "capacity", "active")))
    return replicas.groupBy("model").agg(
        F.count("*").alias("replicas"), F.sum("capacity").alias("capacity"), F.sum("active").alias("active"), F.sum("rejected").alias("rejected"), *told, F.to_json(detail).alias("detail")
    )


def least_loaded(replicas: DataFrame) -> DataFrame:
    """The replica of each model with most room by active count; ties by number; full ones don't take part."""
    free = replicas.filter(F.col("active") < F.col("capacity"))
    return free.groupBy("model").agg(F.min_by("replica", F.struct("active", "replica")).alias("replica"))


def usage(requests: DataFrame, by: list[str]) -> DataFrame:
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def latest(logs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, as an aggregate with partial maxima."""
    rest = [c for c in logs.columns if c != key]
    return logs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def auto_workers(llms: DataFrame, others: int) -> DataFrame:
    """Worker threads: all slots and one for each other model, between 4 and 128."""
    total = F.coalesce(F.sum(F.col("max_concurrent") * F.col("replicas")), F.lit(0)) + others
    return llms.agg(F.greatest(F.lit(4), F.least(total, F.lit(128))).cast("int").alias("workers"))


def error_status(code: Column) -> tuple[Column, Column]:
    """(status, type) of an error code."""
    status = F.lit(500)
    for name, number in STATUS.items():
        status = F.when(code == name, number).otherwise(status)
    return status, F.when(status < 500, "invalid_request_error").otherwise("server_error")


def validation_message(errors: Column) -> Column:
    """``a -> b: message; ...`` from array<struct<loc array<string>, msg>>."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.array_join(e["loc"], " -> "), F.lit(": "), e["msg"])), "; ")


def request_log(events: DataFrame, by: str) -> DataFrame:
    """Requests, errors and the mean time of each ``by``."""
    failed = F.count(F.when(F.col("status") >= 400, 1))
    return events.groupBy(by).agg(F.count("*").alias("requests"), failed.alias("failed"), F.round(F.avg("ms"), 6).alias("mean_ms"))




def deployed(models: DataFrame, engines: DataFrame, engine: str, device: str) -> DataFrame:
    """One row a replica of each model that can be built: name, replica_id, engine, device, concurrent.

    ``models`` has name, engine, device, devices, replicas, max_concurrent and found, whether its files are there; ``engines`` has engine, concurrent and preferred. A model
    without engine or device takes the given ones. The device list counts if it is long enough for all replicas.  An engine that takes one request at a time gets one; any
    other the model's number, or its preferred one if that is larger.  Models whose files or engine are missing have no replica."""
    known = engines.select(F.col("engine").alias("__engine"), F.col("concurrent").alias("__many"), F.col("preferred").alias("__preferred"))
    number = F.greatest(F.lit(1), F.coalesce("replicas", F.lit(1)))
    met = models.filter(F.coalesce("found", F.lit(False))).withColumn("engine", F.coalesce("engine", F.lit(engine))).join(known, F.col("engine") == F.col("__engine"))
    each = met.withColumn("__n", number).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    own = F.when(F.size("devices") >= F.col("__n"), F.get("devices", F.col("__i"))).otherwise(F.coalesce("device", F.lit(device)))
    many = F.greatest("max_concurrent", F.when(F.col("__preferred") > 0, F.col("__preferred")))
    return each.select("name", F.concat("name", F.lit("_r"), "__i").alias("replica_id"), "engine", own.alias("device"), F.when(F.col("__many"), many).otherwise(1).alias("concurrent"))


def registry(models: DataFrame) -> DataFrame:
    """kind, configured, loaded and the default of each kind, its first loaded model, from models (kind, ord, name, loaded)."""
    loaded = F.coalesce("loaded", F.lit(False))
    return models.groupBy("kind").agg(F.count("*").alias("configured"), F.count_if(loaded).alias("loaded"), F.min(F.when(loaded, F.struct("ord", "name")))["name"].alias("first"))
