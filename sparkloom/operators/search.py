"""Retrieval: BM25, exact cosine neighbours, fusion, reranking, cuts, citations and context packing.

All operators take many queries at once, as rows of (qid, ...), and rank with ``score desc, id asc``.

What several steps read (tokens, hits) is written once.  Joins with such a table are broadcast or shuffled by Spark's
threshold on its bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from sparkloom.functions import text as X
from sparkloom.operators import scoring
from sparkloom.sources.tables import written

K1, B = 1.2, 0.75
WEIGHTS = {"dense": 1.0, "content": 0.8, "title": 0.5}
RRF_K = 60
#: Queries that go to every task in one block, and those whose vectors do.
QUERY_BLOCK, VECTOR_BLOCK = 1 << 15, 8192


def ranked(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best of each query; Spark limits the groups before the shuffle too.  Scores tie at nine decimals: sums differ by
    the order of their terms beyond that."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): the distinct tokens of each query."""
    return queries.select("qid", F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term"))


@dataclass
class TextIndex:
    """The tokens of some fields by chunk, written once, and the collection's statistics.

    ``tokens``: id, keep, and for each field its tokens and ``<field>_size``; ``chunks`` and ``lengths``: number of chunks, and the mean length of
    each field.  Ids are unique."""

    tokens: DataFrame
    chunks: int
    lengths: dict[str, float]


def text_index(chunks: DataFrame, fields: tuple[str, ...] = ("content", "title"), where: Column | None = None) -> TextIndex:
    """Index the chunks: texts are cut into tokens once.

    Statistics are those of the whole collection.  ``where`` marks the chunks that a search may find."""
    keep = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    cut = chunks.select("id", keep.alias("keep"), *[X.tokens(F.col(f)).alias(f) for f in fields])
    tokens = written(cut.select("id", "keep", *fields, *[F.size(f).alias(f"{f}_size") for f in fields]), "tokens")
    told = tokens.agg(F.count("*").alias("n"), *[F.avg(f"{f}_size").alias(f) for f in fields]).first()
    return TextIndex(tokens, told["n"], {f: told[f] or 0.0 for f in fields})


def bm25_leg(index: TextIndex, terms: DataFrame, field: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, score, rank by one field of an index, for ``terms(qid, term)``.

    A block of queries goes to every task, which scores its chunks and hands on the best (``operators/scoring.py``)."""
    spark = terms.sparkSession
    asked = written(terms.groupBy("qid").agg(F.collect_set("term").alias("terms")), "asked-terms")  # a query's own terms
    out = None
    for block in query_blocks(asked):
        part = _block_leg(index, block, asked.schema["qid"], field, k, k1, b)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "qid long, id string, score double, rank int") if out is None else out


def query_blocks(asked: DataFrame) -> Iterator[list]:
    """The rows of ``asked`` in blocks, in the order of qid."""
    last = None
    while True:
        ahead = asked if last is None else asked.filter(F.col("qid") > last)
        block = ahead.orderBy("qid").limit(QUERY_BLOCK).collect()
        if block:
            yield block
        if len(block) < QUERY_BLOCK:
            return
        last = block[-1]["qid"]


def _block_leg(index: TextIndex, block: list, qid, field: str, k: int, k1: float, b: float) -> DataFrame:
    spark = index.tokens.sparkSession
    words = sorted({t for r in block for t in r["terms"]})
    number = {w: i for i, w in enumerate(words)}
    shared = spark.sparkContext.broadcast(words)
    tokens = index.tokens.filter(F.col(f"{field}_size") > 0).select("id", "keep", field, f"{field}_size")
    forward = written(tokens.mapInArrow(scoring.numbered(shared, field), scoring.NUMBERED), "asked-chunks")
    df = np.zeros(len(words))
    for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        df[row["term"]] = row["count"]
    queries = [(r["qid"], np.array(sorted(number[t] for t in r["terms"]), int)) for r in block]
    return scored_block(forward, queries, qid, df, index.chunks, index.lengths[field] or 1.0, k, k1, b)


def scored_block(forward: DataFrame, queries: list, qid, df: np.ndarray, chunks: int, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """qid, id, score, rank for a block of queries (qid, numbers of its terms) over numbered chunks."""
    spark = forward.sparkSession
    asked = scoring.asked_block([q for _, q in queries], df, chunks, mean, k, k1, b)
    members = [(int(s), who) for s, (who, _) in zip(asked.set_of, queries, strict=True) if s >= 0] + [(asked.n_sets + i, who) for i, (who, _) in enumerate(queries)]
    found = forward.filter("keep").mapInArrow(scoring.scored(spark.sparkContext.broadcast(asked)), scoring.HITS)
    best = ranked(found.withColumnRenamed("no", "qid"), k).select(F.col("qid").alias("no"), "id", "score")
    named = spark.createDataFrame(members, StructType([StructField("no", IntegerType()), qid]))
    return ranked(best.join(F.broadcast(named), "no").groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def bm25(chunks: DataFrame, queries: DataFrame, field: str, k: int, where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, score, rank.  Statistics are those of the whole collection; ``where`` narrows the hits alone."""
    return bm25_leg(text_index(chunks, (field,), where), query_terms(queries), field, k, k1, b)


def directed(vectors: DataFrame, key: str) -> DataFrame:
    """key, embedding (array<double>) of the vectors that have a direction: none that is null, empty or zero, or has a component that is null
    or not finite."""
    v = F.col("embedding")
    rows = vectors.select(key, v.cast("array<double>").alias("embedding"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.coalesce(sound, F.lit(False)))


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank by exact cosine in double precision.

    ``vectors`` has (id, embedding), ``queries`` (qid, embedding); vectors of different lengths don't meet, and a qid that rows repeat
    asks with its smallest vector.  A block of queries goes to every task; a batch of rows is a matrix product for each part
    of the block, and hands on its own best ``k`` for each query."""
    spark = vectors.sparkSession
    rows = directed(vectors.select(F.col("id").cast("string").alias("id"), "embedding"), "id")
    asked = directed(queries, "qid").groupBy("qid").agg(F.min("embedding").alias("embedding"))
    out, last = None, None
    while True:
        ahead = asked if last is None else asked.filter(F.col("qid") > last)
        block = ahead.orderBy("qid").limit(VECTOR_BLOCK).collect()
        if block:
            shared = spark.sparkContext.broadcast([(r["qid"], np.array(r["embedding"])) for r in block])
            part = ranked(rows.mapInPandas(_nearest(shared, k), "qid long, id string, score double"), k)
            out = part if out is None else out.unionByName(part)
        if len(block) < VECTOR_BLOCK:
            return spark.createDataFrame([], "qid long, id string, score double, rank int") if out is None else out
        last = block[-1]["qid"]


@dataclass
class SharedVectors:
    """Vectors that several chunks have: ``holders(id, vec_id)`` and ``vectors(vec_id, embedding)``."""

    holders: DataFrame
    vectors: DataFrame


def dense_shared(shared: SharedVectors, queries: DataFrame, k: int) -> DataFrame:
    """As ``dense``, for vectors that are scored once, whoever has them.

    The smallest id stands for all that have a vector: the ``k`` best chunks have vectors among the ``k`` best, and are among the ``k`` smallest
    ids of theirs."""
    smallest = Window.partitionBy("vec_id").orderBy("id")
    held = shared.holders.select(F.col("id").cast("string").alias("id"), "vec_id").withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k)
    held = written(held.withColumn("head", F.min("id").over(Window.partitionBy("vec_id"))), "holders")
    near = dense(held.filter("n = 1").join(shared.vectors, "vec_id").select("id", "embedding"), queries, k)
    return ranked(near.select("qid", F.col("id").alias("head"), "score").join(held.select("head", "id"), "head").select("qid", "id", "score"), k)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; the largest component's power of two goes first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _nearest(shared, k: int, at_a_time: int = 256, rows_at_a_time: int = 4096):
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, tuple[list, list]] = {}
        for qid, vector in shared.value:
            held = asked.setdefault(len(vector), ([], []))
            held[0].append(qid)
            held[1].append(unit_rows(vector[None])[0])
        by_length = {n: (np.array(qids), np.stack(vectors), scoring.Best(len(qids), k)) for n, (qids, vectors) in asked.items()}
        for part in filter(len, parts):
            for n, same in part.groupby(part["embedding"].map(len)):
                if n not in by_length:
                    continue
                _, q, best = by_length[n]
                for first in range(0, len(same), rows_at_a_time):
                    some = same.iloc[first : first + rows_at_a_time]
                    x, ids = unit_rows(np.stack(some["embedding"].to_numpy())), some["id"].to_numpy()
                    take = min(k, len(ids))
                    for at in range(0, len(q), at_a_time):
                        near, floor = q[at : at + at_a_time] @ x.T, best.floor[at : at + at_a_time]
                        if take and np.isinf(floor).any():  # nothing to beat yet: the best of these rows
                            floor = np.maximum(floor, np.partition(near, len(ids) - take, axis=1)[:, len(ids) - take] - scoring.NEAR)
                        who, what = np.nonzero(near >= floor[:, None])
                        best.add(at + who, ids[what], near[who, what])
        for qids, _, best in by_length.values():
            who, ids, score = best.rows()
            yield pd.DataFrame({"qid": qids[who], "id": ids, "score": score})

    return work


def unit(leg: str, score: Column) -> Column:
    """A leg's score on the scale from 0 to 1."""
    return (1 + score) / 2 if leg == "dense" else 2 * F.atan(score) / F.lit(np.pi)


def fuse_weighted(legs: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """qid, id, score, rank: the weighted sum of unit scores; a leg that lacks a hit gives 0."""
    weights = weights or WEIGHTS
    parts = [df.select("qid", "id", (unit(leg, F.col("score")) * weights[leg]).alias("part")) for leg, df in legs.items()]
    return ranked(_union(parts).groupBy("qid", "id").agg(F.sum("part").alias("score")), k)


def fuse_rrf(legs: dict[str, DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """qid, id, score, rank by reciprocal ranks."""
    parts = [df.select("qid", "id", (1.0 / (F.lit(constant) + F.col("rank"))).alias("part")) for df in legs.values()]
    return ranked(_union(parts).groupBy("qid", "id").agg(F.sum("part").alias("score")), k)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mode_of(mode: Column) -> Column:
    """dense, sparse or hybrid; anything else is hybrid."""
    low = F.lower(mode)
    return F.when(low.isin("dense", "sparse"), low).otherwise("hybrid")


def search(chunks: DataFrame, vectors: DataFrame | SharedVectors, queries: DataFrame, mode: str = "hybrid", k: int = 10, where: Column | None = None, rrf: bool = False) -> DataFrame:
    """qid, id, score, rank.  ``queries`` has (qid, query, embedding), ``vectors`` (id, embedding).  Each leg of a hybrid search is cut to
    ``k`` first.  Sparse search looks at contents alone, a hybrid one at titles too."""
    mode = mode if mode in ("dense", "sparse") else "hybrid"
    fields = {"dense": (), "sparse": ("content",), "hybrid": ("content", "title")}[mode]
    legs: dict[str, DataFrame] = {}
    if mode != "sparse":
        of_scope = lambda rows: rows if where is None else rows.join(chunks.filter(where).select("id"), "id", "left_semi")
        asked = queries.select("qid", "embedding")
        if isinstance(vectors, SharedVectors):
            legs["dense"] = dense_shared(SharedVectors(of_scope(vectors.holders), vectors.vectors), asked, k)
        else:
            legs["dense"] = dense(of_scope(vectors), asked, k)
    if fields:
        terms = query_terms(queries.select("qid", "query"))
        index = text_index(chunks, fields, where)
        legs |= {f: bm25_leg(index, terms, f, k) for f in fields}
    if mode != "hybrid":
        return next(iter(legs.values()))
    return fuse_rrf(legs, k) if rrf else fuse_weighted(legs, k)


def hit_rows(hits: DataFrame, chunks: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Hits with their chunks' fields, missing ones as '', 0 or {}; a search by one leg says which leg's score it is."""
    defaults = {"string": "", "int": 0, "bigint": 0}
    fields = [F.coalesce(F.col(n), F.lit("{}" if n == "metadata" else defaults[t])).alias(n) for n, t in chunks.dtypes if n not in ("id", "dense_vector")]
    met = chunks.select("id", *fields).join(written(hits.select("qid", "id", "rank", "score"), "hits"), "id")
    leg = lambda name: (F.col("score") if mode == name else F.lit(None).cast("double")).alias(f"{name}_score")
    return met.select("qid", "rank", *[c for c in chunks.columns if c != "dense_vector"], "score", leg("dense"), leg("sparse"))


def shown_hits(rows: DataFrame) -> DataFrame:
    """What a service tells of a hit."""
    return rows.select("qid", "rank", "id", "doc_name", "chapter", "content", "score")


def responses(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """qid, total, hits: a record for every query of ``asked(qid)``, with no hits too."""
    hit = F.struct("rank", "id", "doc_name", "chapter", "content", "score")
    listed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    empty = F.array().cast(listed.schema["hits"].dataType)
    return asked.select("qid").distinct().join(listed, "qid", "left").select("qid", F.coalesce(F.size("hits"), F.lit(0)).alias("total"), F.coalesce("hits", empty).alias("hits"))


def overlap_score(query: Column, document: Column) -> Column:
    """A stand-in reranker: the share of query tokens in the document, through a sigmoid."""
    asked = F.array_distinct(X.tokens(query))
    share = F.size(F.array_intersect(asked, X.tokens(document))) / F.greatest(F.size(asked), F.lit(1))
    return 1 / (1 + F.exp(-(4 * share - 2)))


def scorer(model) -> object:
    """A reranker from a batched model: ``model(queries, documents)`` gives raw scores for two lists of texts; a sigmoid puts them
    between 0 and 1.  For ``rerank``; a row whose text the model fails on has no score."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, documents: pd.Series) -> pd.Series:
        try:
            raw = np.asarray(model(queries.tolist(), documents.tolist()), float)
        except Exception:  # a model may fail in any way; each row is then tried by itself
            raw = np.array([_or_nan(model, q, d) for q, d in zip(queries, documents, strict=True)])
        return pd.Series(1 / (1 + np.exp(-raw))).where(~np.isnan(raw), None)

    return lambda query, document: run(query, document)


def _or_nan(model, query: str, document: str) -> float:
    try:
        return float(model([query], [document])[0])
    except Exception:  # told as a missing score
        return float("nan")


def embedder(model) -> object:
    """A column function from a batched model: ``model(texts)`` gives a vector for each text of a batch; an empty text has none."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        asked = texts.fillna("")
        made = iter(model([t for t in asked if t]))
        return pd.Series([[float(x) for x in next(made)] if t else None for t in asked], dtype=object)

    return run


def hashed_vector(texts: list[str], width: int = 64) -> list[list[float]]:
    """A stand-in embedder: counts of tokens by their CRC-32, of unit length."""
    out = []
    for text in texts:
        counts = np.zeros(width)
        for token in re.findall(r"[^\W_]+", text.lower()):
            counts[zlib.crc32(token.encode()) % width] += 1
        norm = np.linalg.norm(counts)
        out.append((counts / norm if norm else counts).tolist())
    return out


def embedding_inputs(value: Column) -> Column:
    """array<string> of a request's input as JSON: a text, or a list of texts; token numbers have no text, so that a list of them is
    one empty text and each list in a list is one."""
    some = F.try_parse_json(value)
    listed = F.try_variant_get(some, "$", "array<variant>")
    texts = F.transform(listed, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).otherwise(""))
    numbers = F.exists(listed, lambda x: ~F.schema_of_variant(x).isin("STRING", "VOID") & ~F.startswith(F.schema_of_variant(x), F.lit("ARRAY")))
    return F.when(listed.isNull(), F.array(F.coalesce(F.try_variant_get(some, "$", "string"), value))).when(numbers, F.array(F.lit(""))).otherwise(texts)


def rerank_records(query: Column, documents: Column, most: Column, score=None) -> Column:
    """array<struct<index, document, score>>, the best first, ``most`` of them at most (null: all); ties by index."""
    rate = score or overlap_score
    scored = F.transform(documents, lambda d, i: F.struct((-F.round(rate(query, d), 9)).alias("o"), i.alias("index"), d.alias("document"), F.round(rate(query, d), 9).alias("score")))
    best = F.transform(F.array_sort(scored), lambda r: F.struct(r["index"].alias("index"), r["document"].alias("document"), r["score"].alias("score")))
    return F.slice(best, F.lit(1), F.greatest(F.coalesce(most, F.size(documents)), F.lit(0)))


def rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, score=overlap_score) -> DataFrame:
    """Hits with the reranker's score of chapter and content, in its order; equal scores keep the order they had.

    Where the reranker gives no score for one of a query's hits, that query keeps the scores and the order it had."""
    body = F.when(F.coalesce("chapter", F.lit("")) != "", F.concat(F.lit("【"), F.col("chapter"), F.lit("】\n"), F.coalesce("content", F.lit("")))).otherwise(F.coalesce("content", F.lit("")))
    asked = written(hits.select("qid", "id", "rank", F.col("score").alias("old")).join(queries.select("qid", "query"), "qid"), "candidates")
    joined = chunks.select("id", body.alias("body")).join(asked, "id")
    rescored = joined.select("qid", "id", F.col("rank").alias("before"), "old", score(F.col("query"), F.col("body")).alias("new"))
    failed = F.max(F.col("new").isNull()).over(Window.partitionBy("qid"))
    decided = rescored.withColumn("failed", failed).withColumn("score", F.when(F.col("failed"), F.col("old")).otherwise(F.col("new")))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("failed"), F.lit(0.0)).otherwise(-F.round("new", 9)), "before")
    return decided.withColumn("rank", F.row_number().over(order)).select("qid", "id", "score", "rank")


def overfetch(k: int) -> int:
    """Candidates for a reranker."""
    return min(3 * k, 100)


def cut(hits: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The first ``k``, then those at the threshold or above; in that order."""
    first = hits.filter(F.col("rank") <= k)
    return first if threshold is None else first.filter(F.col("score") >= threshold)


def relevant(hits: DataFrame, ratio: float = 0.85, most: int = 3, weak: float = 0.6) -> DataFrame:
    """Hits for the model: the first alone if the best score is weak; else those near the best, at most ``most``."""
    best = F.max("score").over(Window.partitionBy("qid"))
    scored = hits.withColumn("best", best)
    kept = scored.filter(F.when(F.col("best") < weak, F.col("rank") == 1).otherwise(F.col("score") >= F.col("best") * ratio))
    order = Window.partitionBy("qid").orderBy("rank")
    return kept.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n", "best")


def citations(hits: DataFrame, chunks: DataFrame, preview: int = 100) -> DataFrame:
    """qid, index from 1, doc_name, chapter, content_preview, score."""
    met = chunks.select("id", "doc_name", "chapter", "content").join(written(hits.select("qid", "id", "rank", "score"), "hits"), "id")
    text = F.when(F.length("content") > preview, F.concat(F.substring("content", 1, preview), F.lit("..."))).otherwise(F.col("content"))
    return met.select("qid", F.col("rank").alias("index"), "doc_name", "chapter", text.alias("content_preview"), "score")


def packed(hits: DataFrame, chunks: DataFrame, style: str = "generic", budget: int = 6000) -> DataFrame:
    """qid, context: entries with headers until the character budget.  The first that doesn't fit is shortened if over
    100 characters of it would remain, and nothing follows it."""
    met = chunks.select("id", "doc_name", "chapter", "content").join(written(hits.select("qid", "id", "rank"), "hits"), "id")
    number, has = F.col("rank").cast("string"), F.coalesce("chapter", F.lit("")) != ""
    if style == "observation":
        head = F.concat(F.lit("【"), number, F.lit("†"), F.when(has, F.concat("chapter", F.lit("†"))).otherwise(""), "doc_name", F.lit("】"))
    else:
        head = F.concat(F.lit("[来源"), number, F.lit(": "), "doc_name", F.when(has, F.concat(F.lit(" - "), "chapter")).otherwise(""), F.lit("]"))
    entries = met.withColumn("head", head).withColumn("size", F.length("head") + 1 + F.length("content"))
    order = Window.partitionBy("qid").orderBy("rank")
    used = F.coalesce(F.sum(F.col("size") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = entries.withColumn("used", used).withColumn("over", F.col("used") + F.col("size") > budget)
    first = F.min(F.when(F.col("over"), F.col("rank"))).over(Window.partitionBy("qid"))
    over = over.withColumn("first", first).filter(F.col("first").isNull() | (F.col("rank") <= F.col("first")))
    room = F.lit(budget) - F.col("used") - F.length("head") - 10
    whole = F.concat("head", F.lit("\n"), "content")
    part = F.when(room > 100, F.concat("head", F.lit("\n"), F.substring("content", F.lit(1), room.cast("int")), F.lit("...")))
    text = F.when(F.col("over"), part).otherwise(whole)
    lines = over.withColumn("text", text).groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("rank", "text")))).alias("l"))
    return lines.select("qid", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("context"))
