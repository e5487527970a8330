"""Registered queries of chats over the chunks, with their SQL.

Every conversation asks; its query's vector is the one of number conv_id modulo the number of vectors, and the answer is a deterministic
stand-in that tells the length of the prompt's last message."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import chat
from sparkloom.operators import converse as V
from sparkloom.operators import search as S
from sparkloom.plans import dialogue as D
from sparkloom.plans import retrieval as R


def answered(prompt):
    return F.concat(F.lit("Answer to "), F.length(F.element_at(prompt, -1)["content"]).cast("string"), F.lit(" characters."))


def asked_again(query, history):
    """A stand-in for a model that rewrites: the question between quotes, with a mark."""
    return F.concat(F.lit('"'), query, F.lit(' (again)"'))


def embeddings(spark, d):
    """qid, embedding of the conversations' queries."""
    v = R.vectors(spark, d)
    asked = D.turns(spark, d).select(F.col("conv_id").alias("qid")).distinct().crossJoin(F.broadcast(v.agg(F.count("*").alias("n"))))
    return asked.withColumn("vec_id", F.col("qid") % F.col("n")).join(v, "vec_id").select("qid", "embedding")


def replies(spark, d):
    return chat.reply(D.gathered(spark, d), R.chunks(spark, d), R.shared_vectors(spark, d), embeddings(spark, d), answered, rewrite=asked_again)


def chat_plan(spark, d):
    return chat.search_plan(D.gathered(spark, d), rewrite=asked_again).select("conv_id", F.col("intent.intent").alias("intent"), "search_query", "rewritten")


def kb_chat(spark, d):
    named = F.transform("sources", lambda s: F.concat_ws(":", s["index"].cast("string"), s["doc_name"], s["chapter"], F.length(s["content_preview"]).cast("string")))
    return replies(spark, d).select("conv_id", F.col("intent.intent").alias("intent"), "rewritten", "total", F.array_join(named, ";").alias("sources"), "context", "answer")


def kb_chat_events(spark, d):
    return chat.events(replies(spark, d), piece=8)


def search_responses(spark, d):
    """A record for every benchmark item: the hits of a sparse search as a service tells them."""
    asked = R.queries(spark, d)
    hits = S.search(R.chunks(spark, d), None, asked, "sparse", 3)
    rows = S.hit_rows(hits, R.chunks(spark, d), "sparse")
    made = S.responses(asked, S.shown_hits(rows))
    return made.select("qid", "total", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["rank"].cast("string"), h["id"], h["doc_name"], h["chapter"], F.length(h["content"]).cast("string"))), ";").alias("hits"))


QUERIES = {f.__name__: f for f in (chat_plan, kb_chat, kb_chat_events, search_responses)}

_PLAN = f"""{D._GATHERED}, heard AS (SELECT conv_id, text, trim(text) AS q, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) AS has FROM asked a),
ruled AS (SELECT conv_id, text, has, string_split({D.INTENT_CASE}, '|') AS p FROM heard),
plan AS (SELECT conv_id, text, p[1] AS intent, p[3] = 'true' AS looks, has AND p[4] = 'true' AS rewritten, CASE WHEN has AND p[4] = 'true' THEN text || ' (again)' ELSE text END AS search_query FROM ruled)"""
_ASKED = f"""queries AS (SELECT conv_id AS qid, search_query AS query FROM plan WHERE looks), terms AS (SELECT DISTINCT qid, unnest({R._tokens('query')}) AS term FROM queries),
query_vectors AS (SELECT q.qid, embedding FROM queries q JOIN embeddings ON vec_id = q.qid % (SELECT count(*) FROM embeddings))"""
_HITS = f"""{R._dense('dense', 'chunk_vectors', 15)}, {R._bm25('content', 'content', 15)}, {R._bm25('title', 'title', 15)}, {R._fused(False, 15)}, {R._RERANKED.replace('asked AS', 'worded AS').replace('JOIN asked', 'JOIN worded')},
final AS (SELECT qid, id, score, rank FROM reranked WHERE rank <= 5 AND score >= 0.3), {R._KEPT.replace('FROM fused', 'FROM final')}"""
_CHAT = f"""WITH {R.CHUNKS}, {_PLAN}, {_ASKED}, {R.CHUNK_VECTORS}, {_HITS}, packed AS (WITH {R._packed_sql('kept', 'generic', 6000)}),
cited AS (SELECT qid, count(*) AS total, string_agg(rank || ':' || doc_name || ':' || chapter || ':' || CASE WHEN length(content) > 100 THEN 103 ELSE length(content) END, ';' ORDER BY rank) AS sources FROM final JOIN chunks USING (id) GROUP BY qid),
replies AS (SELECT conv_id, intent, rewritten, search_query, coalesce(total, 0)::INT AS total, coalesce(sources, '') AS sources, coalesce(context, '') AS context,
  'Answer to ' || (length(text) + CASE WHEN coalesce(context, '') <> '' THEN length(context) + {len(V.FOUND_HEAD + V.QUESTION_HEAD + V.FOUND_TAIL)} ELSE {len(V.NO_RESULT + V.QUESTION_HEAD)} END) || ' characters.' AS answer
  FROM plan LEFT JOIN cited ON cited.qid = conv_id LEFT JOIN packed ON packed.qid = conv_id)"""

ORACLE = {
    "chat_plan": f"WITH {_PLAN} SELECT conv_id, intent, search_query, rewritten FROM plan",
    "kb_chat": f"{_CHAT} SELECT conv_id, intent, rewritten, total, sources, context, answer FROM replies",
    "kb_chat_events": f"""{_CHAT}, told AS (SELECT *, ceil(length(answer) / 8.0)::BIGINT AS n FROM replies)
  SELECT conv_id AS req_id, 0 AS seq, 'search_start' AS event, search_query AS payload FROM told
  UNION ALL SELECT conv_id, 1, 'search_done', '{{"intent":"' || intent || '","total":' || total || '}}' FROM told
  UNION ALL SELECT conv_id, (2 + i)::INT, 'content', substring(answer, 8 * i + 1, 8) FROM (SELECT *, unnest(range(n)) AS i FROM told)
  UNION ALL SELECT conv_id, (2 + n)::INT, 'done', 'stop' FROM told""",
    "search_responses": f"""WITH {R.CHUNKS}, {R.QUERIES_SQL}, {R._bm25('content', 'content', 3)}
  SELECT q.qid, count(id)::INT AS total, coalesce(string_agg(rank || ':' || id || ':' || doc_name || ':' || chapter || ':' || length(chunks.content), ';' ORDER BY rank), '') AS hits
  FROM queries q LEFT JOIN content h ON h.qid = q.qid LEFT JOIN chunks USING (id) GROUP BY q.qid""",
}
