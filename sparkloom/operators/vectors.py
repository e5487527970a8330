"""A kept vector index: an inverted file over k-means cells, with residuals in bytes.

Vectors are scaled to unit length.  Spark's k-means over a bounded sample gives the centroids; every vector goes to the folder of its nearest one, as
the residual in one byte a component.  A query looks at the cells whose centroids are nearest: their folders are the only ones that are
read.  Residuals rank the rows, and the exact cosine of the whole vectors, read by id from their own table, decides among the best.

The result is approximate: a neighbour in a cell that wasn't probed isn't found.  ``tuned`` measures recall on sample queries against exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import search as S
from sparkloom.sources.tables import fresh_folder, written

#: Vectors that the centroids are learned from, and the most cells.
SAMPLE, CELLS = 100_000, 4096
#: Rows of a cell and queries that one task compares at a time.
ROWS, QUERIES = 1 << 14, 1 << 12
#: Candidates by residuals for each result, which are ranked again exactly.
AGAIN = 8


def unit(v: Column) -> Column:
    """A vector of unit length; the largest component is divided out first, so that squares neither overflow nor vanish."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scaled = F.transform(v, lambda x: x / most)
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(scaled, lambda x: x / norm)


@dataclass
class VectorIndex:
    """``path`` has codes by cell (id, scale, code) and whole vectors by a hash of the id; ``centroids`` are at most ``CELLS`` rows."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.schema("id string, scale double, code binary, cell int").parquet(f"{self.path}/codes")

    @property
    def whole(self) -> DataFrame:
        return self.spark.read.schema("id string, embedding array<double>").parquet(f"{self.path}/whole")


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None) -> VectorIndex:
    """An index of ``vectors(id, embedding)``, all of one length.  The number of cells grows with the root of the number of vectors, up to ``CELLS``."""
    spark = vectors.sparkSession
    index = VectorIndex(spark, path or fresh_folder(spark, "vectors"), np.zeros((0, 0)))
    rows = S.directed(vectors, "id").select("id", unit(F.col("embedding")).alias("embedding"))
    rows.write.parquet(f"{index.path}/whole")
    total = index.whole.count()
    if total:
        cells = cells or min(CELLS, max(1, round(total**0.5)))
        chosen = sampled(index.whole).select(array_to_vector("embedding").alias("features"))
        index.centroids = np.array(KMeans(k=cells, seed=7, maxIter=10).fit(chosen).clusterCenters())
    add(index, index.whole)
    return index


def sampled(vectors: DataFrame) -> DataFrame:
    """``SAMPLE`` vectors at most, by a hash of the id; a limit leaves them in one task, so that they are dealt over all cores again."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).repartition(cores, "id")


def insert(index: VectorIndex, vectors: DataFrame) -> None:
    """More vectors for the cells that there are."""
    rows = written(S.directed(vectors, "id").select("id", unit(F.col("embedding")).alias("embedding")), "vectors")
    rows.write.mode("append").parquet(f"{index.path}/whole")
    add(index, rows)


def add(index: VectorIndex, rows: DataFrame) -> None:
    shared = index.spark.sparkContext.broadcast(index.centroids)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = x @ shared.value.T - (shared.value**2).sum(axis=1) / 2
                cell = near.argmax(axis=1).astype(np.int32)
                rest = x - shared.value[cell]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-300) / 127
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell)], names=["id", "scale", "code", "cell"])

    made = rows.mapInArrow(coded, "id string, scale double, code binary, cell int")
    made.hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.mode("append").partitionBy("cell").parquet(f"{index.path}/codes")


def probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """qid, embedding, cell: each of ``queries(qid, embedding)`` with its ``probes`` nearest cells."""
    shared = index.spark.sparkContext.broadcast(index.centroids)

    def work(batches):
        for batch in batches:
            if batch.num_rows and len(shared.value):
                q = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cells = np.argsort(-(q @ shared.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                again = np.repeat(np.arange(batch.num_rows), cells.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(again)), batch.column("embedding").take(pa.array(again)), pa.array(cells.reshape(-1))], names=["qid", "embedding", "cell"])

    asked = S.directed(queries, "qid").groupBy("qid").agg(F.min("embedding").alias("embedding")).select("qid", unit(F.col("embedding")).alias("embedding"))
    return asked.mapInArrow(work, "qid long, embedding array<double>, cell int")


def candidates(index: VectorIndex, queries: DataFrame, probes: int, k: int) -> DataFrame:
    """qid, id, near: the best rows of the probed cells by their residuals; folders of other cells aren't read."""
    asked = written(probed(index, queries, probes), "probes")
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most CELLS
    shared, most = index.spark.sparkContext.broadcast(index.centroids), AGAIN * k
    held = index.codes.filter(F.col("cell").isin(cells))
    cuts = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = F.broadcast(written(cuts(held, ROWS, "row_cuts").join(cuts(asked, QUERIES, "query_cuts"), "cell"), "blocks"))  # at most CELLS rows
    deal = lambda c, n, name: F.pmod(F.xxhash64(c), F.col(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = asked.join(blocks, "cell").select("cell", every("row_cuts", "rc"), deal("qid", "query_cuts", "qc"), "qid", "embedding")
    right = held.join(blocks, "cell").select("cell", deal("id", "row_cuts", "rc"), every("query_cuts", "qc"), "id", "scale", "code")

    def meet(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not questions.num_rows or not rows.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "near": pa.array([], pa.float64())})
        q = questions.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(questions.num_rows, -1)
        codes = np.stack([np.frombuffer(c, np.int8) for c in rows.column("code").to_pylist()]).astype(np.float32)
        near = (q.astype(np.float32) @ codes.T) * rows.column("scale").to_numpy().astype(np.float32) + (q @ shared.value[questions.column("cell")[0].as_py()])[:, None].astype(np.float32)
        take = min(most, near.shape[1])
        best = np.argpartition(-near, take - 1, axis=1)[:, :take]
        who = np.repeat(np.arange(len(q)), take)
        return pa.table({"qid": questions.column("qid").combine_chunks().take(pa.array(who)), "id": rows.column("id").combine_chunks().take(pa.array(best.reshape(-1))), "near": pa.array(near[who, best.reshape(-1)].astype(float))})

    met = left.groupBy("cell", "rc", "qc").cogroup(right.groupBy("cell", "rc", "qc")).applyInArrow(meet, "qid long, id string, near double")
    order = Window.partitionBy("qid").orderBy(F.desc("near"), "id")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("qid", "id", "near")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """qid, id, score, rank: about the k nearest of each of ``queries(qid, embedding)``, with exact cosines."""
    near = written(candidates(index, queries, probes, k), "near")
    asked = S.directed(queries, "qid").groupBy("qid").agg(F.min("embedding").alias("asked"))
    rows = index.whole.join(near.select("qid", "id"), "id").join(asked.select("qid", unit(F.col("asked")).alias("asked")), "qid")
    score = F.aggregate(F.zip_with("asked", "embedding", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return S.ranked(rows.select("qid", "id", score.alias("score")), k).select("qid", "id", "score", "rank")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of ``truth(qid, id)`` that was found."""
    told = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("n")).first()
    return told["hits"] / told["n"] if told["n"] else 1.0


def tuned(index: VectorIndex, queries: DataFrame, k: int, least: float = 0.95, sample: int = 128) -> int:
    """Probes that find ``least`` of the exact neighbours of at most ``sample`` queries; doubled until they do."""
    chosen = written(queries.orderBy(F.xxhash64("qid")).limit(sample), "sample")
    truth = written(S.dense(index.whole, chosen, k), "truth")
    probes = 1
    while probes < len(index.centroids) and recall(search(index, chosen, k, probes), truth) < least:
        probes *= 2
    return min(probes, max(1, len(index.centroids)))
