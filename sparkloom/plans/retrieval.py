"""Registered queries of the chunk store and of retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import search as S
from sparkloom.sources import chunks as C

K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_documents(table(spark, sf_dir, "documents"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query: the whole text of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").join(vectors(spark, sf_dir), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), "embedding")


def shared_vectors(spark: SparkSession, sf_dir: str) -> S.SharedVectors:
    """A chunk's vector is that of number (doc_id * 31 + chunk_idx) modulo the number of vectors."""
    v = vectors(spark, sf_dir)
    total = v.agg(F.count("*").alias("n"))
    numbered = chunks(spark, sf_dir).select("id", "doc_id", "chunk_idx").crossJoin(F.broadcast(total))
    return S.SharedVectors(numbered.select("id", F.pmod(F.col("doc_id") * 31 + F.col("chunk_idx"), F.col("n")).alias("vec_id")), v)


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding: each chunk with its vector."""
    shared = shared_vectors(spark, sf_dir)
    return shared.holders.join(shared.vectors, "vec_id").select("id", "embedding")


def full_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).join(query_vectors(spark, sf_dir), "qid")


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", "id", F.round("score", 6).alias("score"))


CHUNKS = """chunks AS (
  SELECT doc_id::VARCHAR || '_' || i AS id, doc_id, 'doc-' || doc_id || '.txt' AS doc_name, 'part ' || (i // 4) AS chapter,
         lang || '/' || source || '/part ' || (i // 4) AS chapter_path, i::INT AS chunk_idx,
         substring(text, 448 * i + 1, least(448 * i + 512, n) - 448 * i) AS content, 'doc-' || doc_id || '.txt part ' || (i // 4) AS title,
         (448 * i)::INT AS start_pos, least(448 * i + 512, n)::INT AS end_pos, CASE WHEN i = 0 THEN 0 ELSE 64 END AS overlap_prev,
         CASE WHEN i = m - 1 THEN 0 ELSE 64 END AS overlap_next, 1704067200000 + doc_id AS created_at, lang
  FROM (SELECT *, unnest(range(m)) AS i FROM (
    SELECT *, length(text) AS n, greatest(1, ceil((length(text) - 64) / 448.0))::BIGINT AS m FROM documents WHERE text IS NOT NULL))
)"""


def _tokens(field: str) -> str:
    return f"list_filter(string_split_regex(lower({field}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


QUERIES_SQL = f"""queries AS (SELECT item_id AS qid, text AS query FROM benchmark),
terms AS (SELECT DISTINCT qid, unnest({_tokens('query')}) AS term FROM queries)"""


def _bm25(name: str, field: str, k: int = K, where: str = "true") -> str:
    """CTEs that end in ``name(qid, id, score, rank)``."""
    return f"""{name}_tok AS (SELECT id, {_tokens(field)} AS t, ({where}) AS keep FROM chunks),
{name}_all AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_tok),
{name}_tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl, any_value(keep) AS keep FROM (SELECT id, len(t) AS dl, keep, unnest(t) AS term FROM {name}_tok)
  WHERE term IN (SELECT term FROM terms) GROUP BY id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_sc AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN terms USING (term), {name}_all WHERE keep GROUP BY qid, id),
{name} AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT AS rank FROM {name}_sc) WHERE rank <= {k})"""


def _dense(name: str, source: str, k: int = K) -> str:
    return f"""{name}_sc AS (SELECT q.qid, v.id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM query_vectors q, {source} v),
{name} AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT AS rank FROM {name}_sc) WHERE rank <= {k})"""


QUERY_VECTORS = "query_vectors AS (SELECT item_id AS qid, embedding FROM benchmark JOIN embeddings ON item_id = vec_id)"
CHUNK_VECTORS = "chunk_vectors AS (SELECT id, embedding FROM (SELECT id, (doc_id * 31 + chunk_idx) % (SELECT count(*) FROM embeddings) AS vec_id FROM chunks) JOIN embeddings USING (vec_id))"


def _fused(rrf: bool, k: int) -> str:
    if rrf:
        parts = " UNION ALL ".join(f"SELECT qid, id, 1.0 / (60 + rank) AS part FROM {leg}" for leg in ("dense", "content", "title"))
    else:
        parts = (
            "SELECT qid, id, (1 + score) / 2 AS part FROM dense UNION ALL SELECT qid, id, 2 * atan(score) / pi() * 0.8 FROM content UNION ALL SELECT qid, id, 2 * atan(score) / pi() * 0.5 FROM title"
        )
    return f"""fused AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT AS rank FROM
  (SELECT qid, id, sum(part) AS score FROM ({parts}) GROUP BY qid, id)) WHERE rank <= {k})"""


def _hybrid(k: int, rrf: bool = False) -> str:
    return f"WITH {CHUNKS}, {QUERIES_SQL}, {QUERY_VECTORS}, {CHUNK_VECTORS}, {_dense('dense', 'chunk_vectors', k)}, {_bm25('content', 'content', k)}, {_bm25('title', 'title', k)}, {_fused(rrf, k)}"


SHOW = "SELECT qid, rank, id, round(score, 6) AS score FROM"


def chunk_build(spark, d):
    return chunks(spark, d)


def chunk_title(spark, d):
    return chunks(spark, d).select("id", "title")


def chapter_scan(spark, d):
    return C.chapter_scan(chunks(spark, d), "doc-0.txt", "fr/", ["id", "chunk_idx", "content"])


def chapter_merge(spark, d):
    return C.merged(chunks(spark, d), ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_chunks")


def chapter_parts(spark, d):
    """Chapters merged one by one: the first chunk of a chapter keeps the overlap with the one before."""
    return C.merged(chunks(spark, d), ["doc_id", "chapter_path"]).select("doc_id", "chapter_path", F.length("text").alias("n_chars"), "n_chunks")


def bm25_content_topk(spark, d):
    return shown(S.bm25(chunks(spark, d), queries(spark, d), "content", K))


def title_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth document asks for its own first part."""
    docs = table(spark, d, "documents").filter(F.col("doc_id") % 50 == 0)
    return docs.select(F.col("doc_id").alias("qid"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".txt part 0")).alias("query"))


def bm25_title_topk(spark, d):
    return shown(S.bm25(chunks(spark, d), title_queries(spark, d), "title", K))


def bm25_filtered_topk(spark, d):
    return shown(S.bm25(chunks(spark, d), queries(spark, d), "content", K, C.predicate(None, "fr/")))


def dense_topk(spark, d):
    v = vectors(spark, d)
    one = v.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return shown(S.dense(v.select(F.col("vec_id").cast("string").alias("id"), "embedding"), one, K))


def dense_topk_multi(spark, d):
    return shown(S.dense(vectors(spark, d).select(F.col("vec_id").cast("string").alias("id"), "embedding"), query_vectors(spark, d), K))


def hybrid_hits(spark, d, k=K, rrf=False):
    return S.search(chunks(spark, d), chunk_vectors(spark, d), full_queries(spark, d), "hybrid", k, rrf=rrf)


def hybrid_weighted(spark, d):
    return shown(hybrid_hits(spark, d))


def hybrid_rrf(spark, d):
    return shown(hybrid_hits(spark, d, rrf=True))


def rerank_cut_threshold(spark, d):
    hits = hybrid_hits(spark, d, S.overfetch(5))
    return shown(S.cut(S.rerank(hits, chunks(spark, d), queries(spark, d)), 5, 0.3))


def hit_filter(spark, d):
    return shown(S.relevant(hybrid_hits(spark, d)))


def citations(spark, d):
    return S.citations(hybrid_hits(spark, d), chunks(spark, d)).withColumn("score", F.round("score", 6))


def context_pack(spark, d):
    return S.packed(S.relevant(hybrid_hits(spark, d)), chunks(spark, d))


def context_pack_overflow(spark, d):
    return S.packed(hybrid_hits(spark, d), chunks(spark, d), "observation", 1700)


def search_modes(spark, d):
    """Events ask for a mode in any case, for none, or for one that there isn't."""
    kind = F.pmod("event_id", F.lit(5))
    asked = F.when(kind == 0, "Dense").when(kind == 1, "SPARSE").when(kind == 2, "hybrid").when(kind == 3, F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.mode_of(asked).alias("mode"))


def _packed_sql(source: str, style: str, budget: int) -> str:
    if style == "observation":
        head = "'【' || rank || '†' || chapter || '†' || doc_name || '】'"
    else:
        head = "'[来源' || rank || ': ' || doc_name || ' - ' || chapter || ']'"
    return f"""entries AS (SELECT qid, rank, content, {head} AS head FROM {source} JOIN chunks USING (id)),
sized AS (SELECT *, length(head) + 1 + length(content) AS size FROM entries),
run AS (SELECT *, coalesce(sum(size + 2) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sized),
cutat AS (SELECT *, min(CASE WHEN used + size > {budget} THEN rank END) OVER (PARTITION BY qid) AS first FROM run),
texts AS (SELECT qid, rank, CASE WHEN first IS NULL OR rank < first THEN head || chr(10) || content
  WHEN {budget} - used - length(head) - 10 > 100 THEN head || chr(10) || substring(content, 1, ({budget} - used - length(head) - 10)::BIGINT) || '...' END AS text
  FROM cutat WHERE first IS NULL OR rank <= first)
SELECT qid, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '') AS context FROM texts GROUP BY qid"""


_BODY = "'【' || chapter || '】' || chr(10) || content"
_RERANKED = f"""asked AS (SELECT qid, list_distinct({_tokens('query')}) AS a FROM queries),
scored AS (SELECT f.qid, f.id, f.rank AS before, 1 / (1 + exp(-(4 * (len(list_intersect(a, {_tokens(_BODY)})) / greatest(len(a), 1)) - 2))) AS score FROM fused f JOIN chunks USING (id) JOIN asked USING (qid)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, before)::INT AS rank FROM scored)"""
_KEPT = """kept AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM fused)
  WHERE CASE WHEN best < 0.6 THEN rank = 1 ELSE score >= best * 0.85 END) WHERE n <= 3)"""
_TITLE_QUERIES = f"""queries AS (SELECT doc_id AS qid, 'doc ' || doc_id || '.txt part 0' AS query FROM documents WHERE doc_id % 50 = 0),
terms AS (SELECT DISTINCT qid, unnest({_tokens('query')}) AS term FROM queries)"""

QUERIES = {
    f.__name__: f
    for f in (
        chunk_build, chunk_title, chapter_scan, chapter_merge, chapter_parts, bm25_content_topk, bm25_title_topk, bm25_filtered_topk, dense_topk,
        dense_topk_multi, hybrid_weighted, hybrid_rrf, rerank_cut_threshold, hit_filter, citations, context_pack, context_pack_overflow, search_modes,
    )
}

ORACLE = {
    "chunk_build": f"WITH {CHUNKS} SELECT * EXCLUDE (lang) FROM chunks",
    "chunk_title": f"WITH {CHUNKS} SELECT id, title FROM chunks",
    "chapter_scan": f"WITH {CHUNKS} SELECT id, chunk_idx, content FROM chunks WHERE doc_name = 'doc-0.txt' AND starts_with(chapter_path, 'fr/') ORDER BY chunk_idx",
    "chapter_merge": f"WITH {CHUNKS} SELECT doc_id, sha256(any_value(text)) AS text_sha256, count(*)::INT AS n_chunks FROM chunks JOIN documents USING (doc_id) GROUP BY doc_id",
    "chapter_parts": f"""WITH {CHUNKS} SELECT doc_id, chapter_path, (max(end_pos) - min(start_pos))::INT AS n_chars, count(*)::INT AS n_chunks FROM chunks GROUP BY doc_id, chapter_path""",
    "bm25_content_topk": f"WITH {CHUNKS}, {QUERIES_SQL}, {_bm25('content', 'content')} {SHOW} content",
    "bm25_title_topk": f"WITH {CHUNKS}, {_TITLE_QUERIES}, {_bm25('title', 'title')} {SHOW} title",
    "bm25_filtered_topk": f"WITH {CHUNKS}, {QUERIES_SQL}, {_bm25('content', 'content', K, "starts_with(chapter_path, 'fr/')")} {SHOW} content",
    "dense_topk": f"WITH query_vectors AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id::VARCHAR AS id, embedding FROM embeddings), {_dense('dense', 'v')} {SHOW} dense",
    "dense_topk_multi": f"WITH {QUERY_VECTORS}, v AS (SELECT vec_id::VARCHAR AS id, embedding FROM embeddings), {_dense('dense', 'v')} {SHOW} dense",
    "hybrid_weighted": f"{_hybrid(K)} {SHOW} fused",
    "hybrid_rrf": f"{_hybrid(K, True)} {SHOW} fused",
    "rerank_cut_threshold": f"{_hybrid(15)}, {_RERANKED} {SHOW} reranked WHERE rank <= 5 AND score >= 0.3",
    "hit_filter": f"{_hybrid(K)}, {_KEPT} {SHOW} kept",
    "citations": f"""{_hybrid(K)} SELECT qid, rank AS index, doc_name, chapter, CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '...' ELSE content END AS content_preview,
  round(score, 6) AS score FROM fused JOIN chunks USING (id)""",
    "context_pack": f"{_hybrid(K)}, {_KEPT}, {_packed_sql('kept', 'generic', 6000)}",
    "context_pack_overflow": f"{_hybrid(K)}, {_packed_sql('fused', 'observation', 1700)}",
    "search_modes": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'dense' WHEN 1 THEN 'sparse' ELSE 'hybrid' END AS mode FROM events",
}
