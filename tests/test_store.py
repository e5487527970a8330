"""Collections that change, their text index, and the inverted file of vectors."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import postings as P
from sparkloom.operators import search as S
from sparkloom.operators import vectors as V
from sparkloom.plans import retrieval as R
from sparkloom.sources import chunks as C
from sparkloom.sources.store import BUCKETS, ChunkStore, bucket_of
from tests.oracle import DATA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture()
def store(spark):
    made = ChunkStore(spark)
    yield made
    for name in made.names():
        made.delete(name, confirm=True)


def files_of(store, collection, kind="kb"):
    return set(store._table(collection, kind).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def rows_of(df):
    return sorted(map(tuple, df.select("id", "doc_id", "chunk_idx", "content").collect()))


def hits_of(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def test_changes_equal_a_fresh_collection(spark, store, docs):
    """Insert, delete, upsert, compact: rows and hits are those of a collection that never saw anything else."""
    store.create("a")
    store.create("b")
    store.insert("a", C.from_documents(docs))
    assert store.delete_documents("a", docs.filter("doc_id % 7 = 0").select("doc_id")) == C.from_documents(docs.filter("doc_id % 7 = 0")).count()
    assert store.delete_document("a", 10**9) == 0
    new = docs.filter("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" again")))
    store.upsert("a", C.from_documents(new))
    store.insert("b", C.from_documents(docs.filter("doc_id % 7 <> 0 AND doc_id % 5 <> 0").unionByName(new)))
    want, queries = rows_of(store.get("b")), R.queries(spark, DATA)
    best = hits_of(store.search_text("b", queries).hits)
    assert rows_of(store.get("a")) == want and hits_of(store.search_text("a", queries).hits) == best
    assert store.compact("a") == sorted({r[0] for r in docs.filter("doc_id % 7 = 0 OR doc_id % 5 = 0").select(bucket_of(F.col("doc_id"))).collect()})
    assert store._table("a", "kbd").isEmpty()
    assert rows_of(store.get("a")) == want and hits_of(store.search_text("a", queries).hits) == best
    blocks = store._table("a", "kbp").agg(F.sum("n")).first()[0]
    store.compact_index("a")
    assert store._table("a", "kbp").agg(F.sum("n")).first()[0] < blocks
    assert hits_of(store.search_text("a", queries).hits) == best
    assert sorted(map(tuple, store.stats().collect())) == [("a", len(want)), ("b", len(want))]


def test_compaction_leaves_other_buckets_files(spark, store, docs):
    store.create("c")
    store.insert("c", C.from_documents(docs))
    before = files_of(store, "c")
    assert store.delete_document("c", 3) > 0
    assert files_of(store, "c") == before  # nothing was rewritten
    touched = store.compact("c")
    assert len(touched) == 1 and BUCKETS > 1
    other = {f for f in before if f"bucket={touched[0]}/" not in f}
    assert other and other == {f for f in files_of(store, "c") if f"bucket={touched[0]}/" not in f}
    assert store.get("c", 3).isEmpty() and store.get("c").filter("doc_id = 3").isEmpty()


def test_bucket_that_loses_all_rows(spark, store, docs):
    store.create("d")
    store.insert("d", C.from_documents(docs.filter("doc_id = 4")))
    store.delete_document("d", 4)
    assert store.compact("d") and store.get("d").isEmpty() and store._table("d").isEmpty()


def test_an_operation_that_stops_half_way_is_not_seen(spark, store, docs, monkeypatch):
    store.create("e")
    store.insert("e", C.from_documents(docs.filter("doc_id < 20")))
    want, queries = rows_of(store.get("e")), R.queries(spark, DATA)
    best = hits_of(store.search_text("e", queries).hits)
    monkeypatch.setattr(ChunkStore, "_close", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert("e", C.from_documents(docs.filter("doc_id BETWEEN 10 AND 40")))
    monkeypatch.undo()
    assert rows_of(store.get("e")) == want and hits_of(store.search_text("e", queries).hits) == best
    store.insert("e", C.from_documents(docs.filter("doc_id = 50")))
    assert rows_of(store.get("e").filter("doc_id <> 50")) == want


def test_documents_without_id_and_repeated_chunks(spark, store):
    store.create("f")
    chunks = spark.createDataFrame([("x", None, "n", "c", 0, "one two"), ("x", None, "n", "c", 0, "one two"), ("y", 1, None, None, None, None)], "id string, doc_id long, doc_name string, chapter string, chunk_idx int, content string")
    store.insert("f", chunks)
    assert store.get("f").count() == 3
    assert store.delete_documents("f", spark.createDataFrame([(None,)], "doc_id long")) == 2
    assert [r.id for r in store.get("f").collect()] == ["y"]


def test_one_document_is_read_from_its_bucket(spark, store, docs):
    store.create("g")
    store.insert("g", C.from_documents(docs))
    plan = store.get("g", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and store.get("g", 3).count() == C.from_documents(docs.filter("doc_id = 3")).count()


def test_index_search_reads_no_text(spark, store, docs):
    """A second search after an insert finds the rows of a fresh index, and no scan of it has a chunk's content."""
    store.create("h")
    queries = R.queries(spark, DATA)
    for rest in (0, 1):
        store.insert("h", C.from_documents(docs.filter(F.col("doc_id") % 2 == rest)))
        found = store.search_text("h", queries)
        assert "content#" not in found.hits._jdf.queryExecution().optimizedPlan().toString()
        assert "content#" not in found.read._jdf.queryExecution().optimizedPlan().toString()
        want = S.bm25(C.from_documents(docs.filter(F.col("doc_id") % 2 <= rest)) if rest else C.from_documents(docs.filter("doc_id % 2 = 0")), queries, "content", 10)
        assert hits_of(found.hits) == hits_of(want)


def test_bounds_skip_postings(spark, store, docs):
    """All postings of the queries' terms against those that were met."""
    store.create("i")
    store.insert("i", C.from_documents(docs))
    queries = R.queries(spark, DATA).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 6), " "))
    found = store.search_text("i", queries)
    all_of_them = store._table("i", "kbp").filter("field = 'content'").join(P.query_terms(queries), "term").agg(F.sum("n")).first()[0]
    assert hits_of(found.hits) == hits_of(S.bm25(C.from_documents(docs), queries, "content", 10))
    assert found.read.count() < all_of_them


@pytest.mark.parametrize("plenty", [0, 1 << 40])
def test_plenty_of_postings_are_scored_in_place_at_once(spark, store, docs, monkeypatch, plenty):
    """No step over postings comes first then; with room for all, the bounds decide which postings are met; the hits are the same."""
    monkeypatch.setattr(P, "PLENTY", plenty)
    store.create("p")
    store.insert("p", C.from_documents(docs))
    queries = R.queries(spark, DATA).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 6), " "))
    found = store.search_text("p", queries)
    assert hits_of(found.hits) == hits_of(S.bm25(C.from_documents(docs), queries, "content", 10))
    assert (found.first.count() > 0) == (found.read.count() > 0) == (plenty > 0)


def test_forward_rows_and_sums_count_terms(spark):
    """No, empty, short and long texts; terms come in the order of their first places and aren't compared with each other."""
    texts = {"a": None, "b": "", "c": "--", "d": "B a b, A b!", "e": " ".join(f"w{i % 4000}" for i in range(9000)), "f": "a"}
    rows = spark.createDataFrame([(i, 1, t, i) for i, t in texts.items()], "id string, doc_id long, content string, title string").repartition(2)
    made = P.forward_rows(rows, ("content", "title"))
    assert "array_distinct" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, f): list(terms.items()) for i, t in texts.items() for f, terms in (("content", Counter(re.findall(r"\w+", (t or "").lower()))), ("title", Counter([i])))}
    got = {(r["id"], r["field"]): (r["dl"], [(c["term"], c["tf"]) for c in r["counts"]]) for r in made.collect()}
    assert got == {at: (sum(n for _, n in counts), counts) for at, counts in want.items()}
    sums = {(r["field"], r["term"]): (r["n"], r["tokens"]) for r in P.sums(made, -1).collect()}
    held = Counter((f, t) for (_, f), counts in want.items() for t, _ in counts)
    assert sums == {at: (-n, 0) for at, n in held.items()} | {("content", None): (-6, -9006), ("title", None): (-6, -6)}


def test_many_meetings_are_not_shuffled(spark, store, docs, monkeypatch):
    """Whole texts as queries meet more postings than there are chunks: no plan of an insert's postings or of the search shuffles postings or forward rows."""
    store.create("j")
    store.insert("j", C.from_documents(docs))
    store.delete_documents("j", docs.filter("doc_id % 7 = 0").select("doc_id"))
    queries = R.queries(spark, DATA)
    where = C.predicate(None, "en/")
    hits = store.search_text("j", queries, where=where).hits
    assert "entries" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert hits_of(hits) == hits_of(S.bm25(C.from_documents(docs.filter("doc_id % 7 <> 0")), queries, "content", 10, where))
    for plan in (P.blocks(store.index("j").forward), store.index("j").forward):
        assert " Exchange hashpartitioning(bucket" not in plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(term" not in plan._jdf.queryExecution().executedPlan().toString()


def test_cuts_stay_below_the_threshold():
    import pandas as pd

    rows = [("a", 1.0, 1000), ("a", 2.0, 10), ("b", 0.5, 500), ("b", 4.0, 5), ("c", 9.0, 1)]
    got = P._cuts(pd.DataFrame([(1, t, b, n, 4.0) for t, b, n in rows], columns=["qid", "term", "bound", "n", "threshold"])).set_index("term")
    assert got.cut.to_dict() == {"a": 1.0, "b": 0.5, "c": 0.0} and set(got.cuts) == {1.5}
    none = P._cuts(pd.DataFrame([(1, "a", 1.0, 5, 0.0)], columns=["qid", "term", "bound", "n", "threshold"]))
    assert none.cut.tolist() == [0.0]


def scanned_files(df) -> int:
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_inverted_file(spark):
    rows = R.vectors(spark, DATA).select(F.col("vec_id").cast("string").alias("id"), "embedding")
    odd = spark.createDataFrame([("zero", [0.0] * 64), ("none", None), ("nan", [float("nan")] * 64), ("far", [1e300] * 64)], "id string, embedding array<double>")
    index = V.build(rows.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(odd), cells=12)
    queries = R.query_vectors(spark, DATA)
    truth = S.dense(index.whole, queries, 10)
    probes = V.tuned(index, queries, 10)
    assert V.recall(V.search(index, queries, 10, probes), truth) >= 0.95
    every = hits_of(V.search(index, queries, 10, 12))
    assert len({(q, i) for q, _, i, _ in every} ^ {(q, i) for q, _, i, _ in hits_of(truth)}) <= len(every) // 50
    one = queries.limit(1)
    cells = [r.cell for r in V.probed(index, one, 2).collect()]
    assert len(cells) == 2
    assert scanned_files(index.codes.filter(F.col("cell").isin(cells))) < scanned_files(index.codes)
    assert {r.id for r in index.whole.filter("id IN ('zero', 'none', 'nan', 'far')").collect()} == {"far"}
    empty = V.build(rows.filter("false"))
    assert V.search(empty, queries, 10, 4).count() == 0


def test_extreme_vectors_have_a_direction(spark):
    rows = spark.createDataFrame([("a", [1e170, 1e169]), ("b", [1e-170, 1e-171]), ("c", [-1e300, 1.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1e-200, 1e-201])], "qid long, embedding array<double>")
    assert [(r.id, round(r.score, 9)) for r in S.dense(rows, asked, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("c", round(-1 / 1.01**0.5, 9))]


def test_the_sample_of_cells_is_dealt_over_the_cores(spark):
    rows = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(200)], "id string, embedding array<double>")
    made = V.sampled(rows)
    assert made.count() == 200
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism
