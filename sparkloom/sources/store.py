"""Collections of chunks that change: rows in buckets of doc_id, deletes that are merged on read, a text index that grows with each insert.

An operation has a number.  A log row opens it, and one closes it when all its files are written; rows of an operation that isn't closed are never seen, so that
a crash leaves the collection as it was.  A delete is a row (doc_id, number): it hides the document's rows of smaller numbers.  An upsert deletes and inserts
under one number.  Compaction folds the deletes in, by rewriting the buckets that they touch and no other.  One writer at a time.

A collection's tables, all of the session's catalog:

- ``kb_<name>``: chunks, by bucket, sorted by document name and chapter path within a bucket's files, with Bloom filters on doc_id;
- ``kbd_<name>``: deletes, by bucket; ``kbl_<name>``: the log;
- ``kbf_<name>``: the forward table of the text index, by bucket; ``kbp_<name>``: its postings in blocks, by a hash of the term, sorted by term;
- ``kbs_<name>``: its statistics, signed sums: an insert adds, a delete takes away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import schemas
from sparkloom.functions import text as X
from sparkloom.operators import postings as P
from sparkloom.sources.tables import written

BUCKETS = 16
FIELDS = ("content", "title")
#: Deleted documents up to which a join with them is broadcast, so that the rows they hide aren't shuffled.
GONE = 2_000_000
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"

_LOG = "seq long, done boolean"
_DELETES = "doc_id long, seq long, bucket int"


def bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def few(gone: DataFrame) -> DataFrame:
    """A written table, marked for broadcast up to ``GONE`` rows."""
    return F.broadcast(gone) if gone.count() <= GONE else gone


class ChunkStore:
    """Collections as tables of the session's catalog, one fixed schema for all."""

    def __init__(self, spark: SparkSession, database: str = "default", fields: tuple[str, ...] = FIELDS):
        """``fields`` have text indexes; with none a collection is chunks alone."""
        self.spark, self.database, self.fields = spark, database, fields

    # --- the catalog

    def _name(self, collection: str, kind: str = "kb") -> str:
        return f"{self.database}.{kind}_{collection}"

    def create(self, collection: str) -> str:
        """Create the collection with its index; nothing happens if it exists."""
        if not self.exists(collection):
            chunk = T.StructType([*schemas.CHUNK.fields, T.StructField("seq", T.LongType()), T.StructField("bucket", T.IntegerType())])
            layouts = {"kbl": (_LOG, ()), "kbd": (_DELETES, ("bucket",)), "kbf": (f"{P.FORWARD}, seq long, bucket int", ("bucket",)), "kbp": (P.POSTINGS, ("term_bucket",)), "kbs": (f"{P.SUMS}, seq long", ()), "kb": (chunk, ("bucket",))}
            for kind, (schema, by) in layouts.items():
                made = self.spark.createDataFrame([], schema).write.format("parquet").option("parquet.bloom.filter.enabled#doc_id", "true")
                (made.partitionBy(*by) if by else made).saveAsTable(self._name(collection, kind))
        return collection

    def exists(self, collection: str) -> bool:
        return self.spark.catalog.tableExists(self._name(collection))

    def names(self) -> list[str]:
        return sorted(t.name[3:] for t in self.spark.catalog.listTables(self.database) if t.name.startswith("kb_"))

    def delete(self, collection: str, confirm: bool = False) -> bool:
        """Drop the collection if that is confirmed; False where there was nothing to drop or no confirmation."""
        if not confirm or not self.exists(collection):
            return False
        for kind in ("kb", "kbd", "kbl", "kbf", "kbp", "kbs"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(collection, kind)}")
        return True

    def _table(self, collection: str, kind: str = "kb") -> DataFrame:
        if not self.exists(collection):
            raise LookupError(f"no collection {collection!r}")
        self.spark.catalog.refreshTable(self._name(collection, kind))
        return self.spark.table(self._name(collection, kind))

    # --- operations

    def _open(self, collection: str) -> int:
        seq = (self._table(collection, "kbl").agg(F.max("seq")).first()[0] or 0) + 1
        self._append(self.spark.createDataFrame([(seq, False)], _LOG), collection, "kbl")
        return seq

    def _close(self, collection: str, seq: int) -> None:
        self._append(self.spark.createDataFrame([(seq, True)], _LOG), collection, "kbl")

    def _append(self, rows: DataFrame, collection: str, kind: str) -> None:
        target = self._table(collection, kind)
        rows.select(*target.columns).write.mode("append").insertInto(self._name(collection, kind))

    def _seen(self, collection: str, kind: str) -> DataFrame:
        """Rows of closed operations."""
        return self._table(collection, kind).join(self._table(collection, "kbl").filter("done").select("seq"), "seq", "left_semi")

    def _live(self, collection: str, kind: str = "kb") -> DataFrame:
        """Rows that no later delete hides."""
        gone = self._seen(collection, "kbd").groupBy("bucket", F.col("doc_id").alias("gone_id")).agg(F.max("seq").alias("gone")).withColumnRenamed("bucket", "gone_bucket")
        rows, gone = self._seen(collection, kind), few(written(gone, "gone"))
        hidden = (F.col("bucket") == F.col("gone_bucket")) & F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("gone") > F.col("seq"))
        return rows.join(gone, hidden, "left_anti")

    def get(self, collection: str, doc_id: int | None = None) -> DataFrame:
        """The collection's chunks; those of one document from its bucket alone."""
        rows = self._live(collection)
        if doc_id is not None:
            rows = rows.filter((F.col("bucket") == bucket_of(F.lit(doc_id).cast("long"))) & (F.col("doc_id") == doc_id))
        return rows.select(*[f.name for f in schemas.CHUNK])

    def insert(self, collection: str, chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """Append chunks with their titles and vectors (id, embedding); with vectors there must be one for each chunk.  Returns the ids as
        a table.  The rows are computed once."""
        return self._put(collection, chunks, vectors, False)

    def upsert(self, collection: str, chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """As ``insert``; all chunks that the documents had before go."""
        return self._put(collection, chunks, vectors, True)

    def _put(self, collection: str, chunks: DataFrame, vectors: DataFrame | None, replace: bool) -> DataFrame:
        self._table(collection)
        named = chunks.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.CHUNK if f.name not in chunks.columns})
        named = named.withColumn("title", X.title(F.col("doc_name"), F.col("chapter"))).withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
        if vectors is not None:
            given = vectors.select(F.col("id").alias("vector_id"), F.col("embedding").alias("given"))
            named = named.join(given, F.col("id") == F.col("vector_id"), "full").withColumn("dense_vector", F.col("given"))
        rows = named.select(*[F.col(f.name).cast(f.dataType) for f in schemas.CHUNK], (F.col("vector_id").isNotNull() if vectors is not None else F.lit(True)).alias("has_vector"))
        kept = rows.withColumn("bucket", bucket_of(F.col("doc_id")))
        if vectors is not None:
            kept = written(kept, "insert")
            if not kept.filter("id IS NULL OR NOT has_vector").isEmpty():
                raise ValueError("chunks and vectors differ in length")
        seq = self._open(collection)
        # rebalancing splits a bucket that holds much; a bucket's rows are sorted in each file
        spread = kept.drop("has_vector").withColumn("seq", F.lit(seq)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_name", "chapter_path", "chunk_idx")
        self._append(spread, collection, "kb")
        put = self._table(collection).filter(F.col("seq") == seq)
        if replace:
            self._hide(collection, put.select("doc_id").distinct(), seq)
        if self.fields:
            self._index(collection, put, seq)
        ids = written(put.select("id"), "ids")
        self._close(collection, seq)
        return ids

    def _index(self, collection: str, put: DataFrame, seq: int) -> None:
        """Forward rows where the chunks lie, by their buckets already; postings and sums where the forward rows lie."""
        forward = P.forward_rows(put, self.fields).withColumn("bucket", bucket_of(F.col("doc_id")))
        self._append(forward.withColumn("seq", F.lit(seq)).sortWithinPartitions("bucket", "doc_id"), collection, "kbf")
        forward = self._table(collection, "kbf").filter(F.col("seq") == seq)
        self._append(P.blocks(forward).sortWithinPartitions("term_bucket", "field", "term"), collection, "kbp")
        self._append(P.sums(forward).withColumn("seq", F.lit(seq)), collection, "kbs")

    def _hide(self, collection: str, doc_ids: DataFrame, seq: int) -> None:
        """Delete rows for documents, and their share taken from the statistics."""
        gone = written(doc_ids.withColumn("bucket", bucket_of(F.col("doc_id"))), "gone")
        same = few(gone.select(F.col("doc_id").alias("gone_id"), F.col("bucket").alias("gone_bucket")))
        forward = self._live(collection, "kbf").join(same, (F.col("bucket") == F.col("gone_bucket")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi")
        self._append(P.sums(forward, -1).withColumn("seq", F.lit(seq)), collection, "kbs")
        self._append(gone.withColumn("seq", F.lit(seq)), collection, "kbd")

    def delete_documents(self, collection: str, doc_ids: DataFrame) -> int:
        """Hide the chunks of ``doc_ids(doc_id)``; returns how many went.  No chunk is rewritten."""
        gone = written(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc-ids")
        same = few(gone.select(F.col("doc_id").alias("gone_id")))
        count = self._live(collection).join(same, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi").count()
        if count:
            seq = self._open(collection)
            self._hide(collection, gone, seq)
            self._close(collection, seq)
        return count

    def delete_document(self, collection: str, doc_id: int) -> int:
        return self.delete_documents(collection, self.spark.createDataFrame([(doc_id,)], "doc_id long"))

    def compact(self, collection: str) -> list[int]:
        """Fold the deletes in: the buckets that they touch are rewritten, chunks and forward rows, and no other.  Returns these buckets.  A crash in
        between leaves deletes that hide nothing."""
        touched = [r["bucket"] for r in self._table(collection, "kbd").select("bucket").distinct().collect()]  # at most BUCKETS
        if touched:
            for kind, order in (("kb", ("bucket", "doc_name", "chapter_path", "chunk_idx")), ("kbf", ("bucket", "doc_id"))):
                live = written(self._live(collection, kind).filter(F.col("bucket").isin(touched)), "compact")
                self._replace(live.hint("rebalance", "bucket").sortWithinPartitions(*order), collection, kind, "bucket", touched)
            self._replace(self._table(collection, "kbd").limit(0), collection, "kbd", "bucket", touched)
        return sorted(touched)

    def compact_index(self, collection: str) -> None:
        """Postings of the chunks of the day alone, the blocks of many inserts joined."""
        forward = written(self._live(collection, "kbf"), "forward")
        blocks = P.blocks(forward)
        self._replace(blocks.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "field", "term"), collection, "kbp", "term_bucket", list(range(P.TERM_BUCKETS)))

    def _replace(self, rows: DataFrame, collection: str, kind: str, by: str, buckets: list[int]) -> None:
        """Overwrite these buckets; those that get no row are emptied.  Dynamic partition overwrite leaves the others' files."""
        target, name = self._table(collection, kind), self._name(collection, kind)
        kept = {r[by] for r in rows.select(by).distinct().collect()}  # at most as many as there are buckets
        if kept:
            mode = self.spark.conf.get(OVERWRITE, "static")  # insertInto takes this from the session alone
            self.spark.conf.set(OVERWRITE, "dynamic")
            try:
                rows.select(*target.columns).write.mode("overwrite").insertInto(name)
            finally:
                self.spark.conf.set(OVERWRITE, mode)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first()["data_type"]
        for bucket in set(buckets) - kept:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{by}={bucket}")
            path.getFileSystem(conf).delete(path, True)
        self.spark.catalog.refreshTable(name)

    # --- what is asked of a collection

    def stats(self) -> DataFrame:
        """collection, n_chunks of every collection that can be read."""
        out = self.spark.createDataFrame([], "collection string, n_chunks long")
        for name in self.names():
            try:
                out = out.unionByName(self.get(name).agg(F.count("*").alias("n_chunks")).select(F.lit(name).alias("collection"), "n_chunks"))
            except Exception:  # a broken collection is left out, as a listing should not fail for one
                continue
        return out

    def index(self, collection: str) -> P.KeptIndex:
        return P.KeptIndex(self._live(collection, "kbf"), self._table(collection, "kbp"), self._seen(collection, "kbs"))

    def search_text(self, collection: str, queries: DataFrame, field: str = "content", k: int = 10, where: Column | None = None) -> P.Search:
        """The best chunks of each of ``queries(qid, query)`` by BM25, from the kept index; texts of chunks aren't read.  ``where`` narrows the hits alone."""
        allowed = None if where is None else self.get(collection).filter(where).select("id")
        return P.top_k(self.index(collection), P.query_terms(queries), field, k, allowed)
