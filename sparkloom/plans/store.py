"""Registered queries of collections that change, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import vectors as V
from sparkloom.plans import retrieval as R
from sparkloom.sources import chunks as C
from sparkloom.sources.store import ChunkStore
from sparkloom.sources.tables import written


def with_store(spark: SparkSession, work: Callable[[ChunkStore, str], DataFrame], fields: tuple[str, ...] = ()) -> DataFrame:
    """What ``work`` makes of a collection of its own, which goes afterwards."""
    store, name = ChunkStore(spark, fields=fields), f"q{uuid.uuid4().hex}"
    store.create(name)
    try:
        return written(work(store, name), "store-result")
    finally:
        store.delete(name, confirm=True)


def filled(store: ChunkStore, name: str, spark: SparkSession, d: str) -> None:
    """All documents in two inserts."""
    docs = R.table(spark, d, "documents")
    for rest in (0, 1):
        store.insert(name, C.from_documents(docs.filter(F.col("doc_id") % 2 == rest)))


def changed(store: ChunkStore, name: str, spark: SparkSession, d: str) -> None:
    """Every seventh document goes; then every fifth comes, with one word more, whether it was there or not."""
    filled(store, name, spark, d)
    docs = R.table(spark, d, "documents")
    store.delete_documents(name, docs.filter("doc_id % 7 = 0").select("doc_id"))
    store.upsert(name, C.from_documents(docs.filter("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" again")))))


def chunk_stats(spark, d):
    """A collection for each language."""
    docs = R.table(spark, d, "documents")
    store, names = ChunkStore(spark, fields=()), {}
    for row in docs.filter("lang IS NOT NULL").select("lang").distinct().collect():  # languages, for whom collections are made
        names[f"q{uuid.uuid4().hex}"] = row["lang"]
    try:
        for name, lang in names.items():
            store.create(name)
            store.insert(name, C.from_documents(docs.filter(F.col("lang") == lang)))
        told = spark.createDataFrame(list(names.items()), "name string, lang string")
        counts = store.stats().join(told, F.col("collection") == F.col("name")).select(F.col("lang").alias("collection"), "n_chunks")
        return written(counts, "store-result")
    finally:
        for name in names:
            store.delete(name, confirm=True)


def chunk_delete_doc(spark, d):
    def work(store, name):
        filled(store, name, spark, d)
        store.delete_document(name, 7)
        return store.get(name).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))

    return with_store(spark, work)


def store_changes(spark, d):
    def work(store, name):
        changed(store, name, spark, d)
        store.compact(name)
        return store.get(name).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), F.max("end_pos").alias("end_pos"))

    return with_store(spark, work)


def index_topk(spark, d):
    """Found by an index that grew with two inserts."""

    def work(store, name):
        filled(store, name, spark, d)
        return R.shown(store.search_text(name, R.queries(spark, d), "content", R.K).hits)

    return with_store(spark, work, ("content",))


def index_changed_topk(spark, d):
    """Found after deletes and upserts, with a filter, by an index that nothing has been taken out of yet."""

    def work(store, name):
        changed(store, name, spark, d)
        return R.shown(store.search_text(name, R.queries(spark, d), "content", R.K, C.predicate(None, "en/")).hits)

    return with_store(spark, work, ("content",))


def vector_topk(spark, d):
    """Found by an inverted file that grew with two inserts, all cells probed: what exact search finds, but for what its residuals leave out."""
    rows = R.vectors(spark, d).select(F.col("vec_id").cast("string").alias("id"), "embedding")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    index = V.build(rows.filter(half))
    V.insert(index, rows.filter(~half))
    return R.shown(V.search(index, R.query_vectors(spark, d), R.K, len(index.centroids)))


_CHANGED = """changed AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' again' ELSE '' END AS text, lang, source FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0)"""
_CHANGED_CHUNKS = f"{_CHANGED}, {R.CHUNKS.replace('FROM documents', 'FROM changed')}"

QUERIES = {f.__name__: f for f in (chunk_stats, chunk_delete_doc, store_changes, index_topk, index_changed_topk, vector_topk)}

ORACLE = {
    "chunk_stats": f"WITH {R.CHUNKS} SELECT lang AS collection, count(*) AS n_chunks FROM chunks GROUP BY lang",
    "chunk_delete_doc": f"WITH {R.CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM chunks WHERE doc_id <> 7 GROUP BY doc_id",
    "store_changes": f"WITH {_CHANGED_CHUNKS} SELECT doc_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars, max(end_pos)::INT AS end_pos FROM chunks GROUP BY doc_id",
    "index_topk": f"WITH {R.CHUNKS}, {R.QUERIES_SQL}, {R._bm25('content', 'content')} {R.SHOW} content",
    "vector_topk": R.ORACLE["dense_topk_multi"],
    "index_changed_topk": f"WITH {_CHANGED_CHUNKS}, {R.QUERIES_SQL}, {R._bm25('content', 'content', R.K, "starts_with(chapter_path, 'en/')")} {R.SHOW} content",
}
