"""Chat over a collection: plan, search, pack, ask, and the events that a client sees.

Models are functions of columns: ``answer(prompt)`` of array<struct<role, content>>, ``rewrite(query, history)`` and a reranker's
``score(query, document)``.  Any of them may be a pandas UDF; the plans use deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import converse as V
from sparkloom.operators import search as S
from sparkloom.sources.tables import written

Model = Callable[..., Column]


@dataclass(frozen=True)
class Settings:
    """What a request may set."""

    mode: str = "hybrid"
    k: int = 5
    threshold: float | None = 0.3
    rerank: bool = True
    rewrite: str = "auto"
    budget: int = 6000
    style: str = "generic"


def search_plan(conversations: DataFrame, settings: Settings = Settings(), rewrite: Model | None = None) -> DataFrame:
    """conv_id, query, history, intent, search_query, rewritten from ``conversations(conv_id, messages)``.

    A query is rewritten where its intent says so, there is a history, and a model to do it; without an answer it stays."""
    query, history = V.query_and_history(F.col("messages"))
    base = conversations.select("conv_id", query.alias("query"), history.alias("history")).withColumn("intent", V.intent(F.col("query"), F.size("history") > 0))
    gate = V.rewrite_gate(F.size("history") > 0, rewrite is not None, settings.rewrite) & F.col("intent.rewrite_needed")
    asked = F.lit(None).cast("string") if rewrite is None else rewrite(F.col("query"), F.col("history"))
    kept = F.struct(F.col("query").alias("query"), F.lit(False).alias("applied"))
    made = base.withColumn("r", F.when(gate & asked.isNotNull(), V.rewritten(F.col("query"), asked)).otherwise(kept))
    return made.select("conv_id", "query", "history", "intent", F.col("r.query").alias("search_query"), F.col("r.applied").alias("rewritten"))


def _candidates(plan: DataFrame, chunks: DataFrame, vectors: DataFrame | S.SharedVectors, embeddings: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries of the conversations that search, their hits before reranking, and the chunks among those, cut out of their documents once for
    all that reads them."""
    asked = plan.filter("intent.should_search").select(F.col("conv_id").alias("qid"), F.col("search_query").alias("query"))
    queries = written(asked.join(embeddings, "qid", "left"), "chat-queries")
    hits = written(S.search(chunks, vectors, queries, settings.mode, S.overfetch(settings.k) if settings.rerank else settings.k), "chat-candidates")
    return queries, hits, written(chunks.join(hits.select("id").distinct(), "id", "left_semi"), "chat-chunks")


def _chosen(queries: DataFrame, hits: DataFrame, chunks: DataFrame, settings: Settings, score: Model) -> DataFrame:
    return S.cut(S.rerank(hits, chunks, queries, score) if settings.rerank else hits, settings.k, settings.threshold)


def found(plan: DataFrame, chunks: DataFrame, vectors: DataFrame | S.SharedVectors, embeddings: DataFrame, settings: Settings = Settings(), score: Model = S.overlap_score) -> DataFrame:
    """qid, id, score, rank for the conversations that search; ``embeddings(qid, embedding)`` are those of their queries."""
    return _chosen(*_candidates(plan, chunks, vectors, embeddings, settings), settings, score)


def reply(conversations: DataFrame, chunks: DataFrame, vectors: DataFrame | S.SharedVectors, embeddings: DataFrame, answer: Model, settings: Settings = Settings(),
          rewrite: Model | None = None, score: Model = S.overlap_score) -> DataFrame:
    """conv_id, intent, search_query, rewritten, total, sources, context, answer: one row a conversation.

    Sources are those of all hits, the context holds the relevant ones alone.  A conversation that doesn't search, or finds nothing, is
    answered without."""
    plan = written(search_plan(conversations, settings, rewrite), "chat-plan")
    queries, candidates, met = _candidates(plan, chunks, vectors, embeddings, settings)
    hits = written(_chosen(queries, candidates, met, settings, score), "chat-hits")
    source = F.struct("index", "doc_name", "chapter", "content_preview", "score")
    sources = S.citations(hits, met).groupBy("qid").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    contexts = S.packed(S.relevant(hits), met, settings.style, settings.budget).withColumnRenamed("qid", "c_qid")
    told = plan.join(sources, F.col("conv_id") == F.col("qid"), "left").join(contexts, F.col("conv_id") == F.col("c_qid"), "left")
    build = V.prompt_observation if settings.style == "observation" else V.prompt_generic
    told = told.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("prompt", build(F.col("query"), F.col("history"), F.col("context")))
    return told.select(
        "conv_id", "intent", "search_query", "rewritten", F.coalesce(F.size("sources"), F.lit(0)).alias("total"),
        F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources"), "context", answer(F.col("prompt")).alias("answer"),
    )


def events(replies: DataFrame, search_told: bool = True, piece: int = 64) -> DataFrame:
    """req_id, seq, event, payload: search_start, search_done, content ..., done; an answer that is missing ends with error.

    ``search_told`` False leaves out the first event alone, as a request without a search does."""
    event = lambda name, payload: F.array(F.struct(F.lit(name).alias("event"), payload.alias("payload")))
    pieces = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(f"(?s).{{1,{piece}}}+"), F.lit(0))
    none = F.array().cast("array<struct<event: string, payload: string>>")
    start = event("search_start", F.col("search_query")) if search_told else none
    done = event("search_done", F.to_json(F.struct(F.col("intent.intent").alias("intent"), "total")))
    content = F.transform(pieces, lambda p: F.struct(F.lit("content").alias("event"), p.alias("payload")))
    last = F.when(F.col("answer").isNull(), event("error", F.lit("no answer"))).otherwise(event("done", F.lit("stop")))
    return replies.select(F.col("conv_id").alias("req_id"), F.posexplode(F.concat(start, done, content, last)).alias("seq", "e")).select("req_id", "seq", "e.event", "e.payload")
