"""Exact top-k search by distributed histogram selection.

Components become ``floor(scale * x)``, a score is the integer inner product.  Queries and rows are dealt over a grid of cells of bounded
size; a cell scores its queries against its rows by matrix products.

Each pass scores everything and counts the scores of each query in ``bins`` bins of its range; a cell tells the bins that can hold the
query's k-th score alone, those above which it has counted fewer than k.  The counts are added up, and the bin that holds the global k-th score is
the range of the next pass.  A query is settled when that bin is one number wide, or when no more than ``NEAR`` times k scores
reach its lower edge.  One more pass keeps the scores at that edge or above; a cell sends a query's k best by (score, smaller id) on, so
that a crowd of ties stays in its cells.  Ranges shrink by ``bins`` a pass: 64 bits take seven passes at most, whatever the data.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate; zero vectors and empty
ones do; vectors of different lengths have no product and are searched apart; ties go to the smaller id; of rows that repeat an id the
one with the smallest vector counts; fewer than k candidates are all given; a component or a score beyond 64 bits counts as the nearest
64-bit number; a null id takes no part; an empty table gives an empty result; other columns and their names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_arrow_batches, broadcast_if_small, picked, stage

BINS = 1024
#: A query is settled when at most this many times k scores reach the edge.
NEAR = 16
#: Bytes of rows and of queries in a cell; small tables are still dealt over up to ``SPREAD`` groups of rows.
ROW_BYTES, QUERY_BYTES, SPREAD = 16 << 20, 4 << 20, 64
#: Queries and rows that are scored at once.
TILE = 256, 4096

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<bigint>) of the vectors that take part, one row an id."""
    x = F.col("x")
    made = picked(rows, vec_id=id_col, x=vector_col).select(F.col("vec_id").cast("long"), F.col("x").cast("array<double>"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = made.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return sound.select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of 64-bit integers, exact, and at the nearest 64-bit number where they leave that range.

    Doubles hold all that stays below 2 ** 53; vectors with larger components are multiplied as Python's integers."""
    most = (2.0**53 / max(1, q.shape[1])) ** 0.5
    small_q = (np.abs(q.astype(float)) <= most).all(axis=1)
    small_x = (np.abs(x.astype(float)) <= most).all(axis=1)
    out = (np.where(small_q[:, None], q, 0).astype(float) @ np.where(small_x[:, None], x, 0).astype(float).T).astype(np.int64)
    exact = lambda a, b: np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)
    if not small_x.all():
        out[:, ~small_x] = exact(q, x[~small_x])
    if not small_q.all():
        out[~small_q] = exact(q[~small_q], x)
    return out


def _ordered(s: np.ndarray) -> np.ndarray:
    """64-bit numbers as unsigned ones in the same order, whose differences can't overflow."""
    return s.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _matrix(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, v = cell.column("vec_id").to_numpy(), cell.column("v").combine_chunks()
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1 if len(v.flatten()) else 0)


def _tiles(asked: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each slice of the queries: its tiles of (scores, ids, where a query meets its own row)."""
    (q_ids, q), (ids, x) = _matrix(asked), _matrix(rows)
    for at in range(0, len(q_ids), TILE[0]):
        part = slice(at, min(at + TILE[0], len(q_ids)))
        starts = range(0, len(ids), TILE[1])
        yield part, ((products(q[part], x[b : b + TILE[1]]), ids[b : b + TILE[1]], q_ids[part, None] == ids[None, b : b + TILE[1]]) for b in starts)


_COUNTED = "query_id long, bin int, n long"
_FOUND = "query_id long, vec_id long, score long"


def _counting(k: int, bins: int):
    def count(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """Per query the highest bins of its range in this cell, down to the one with the cell's k-th score."""
        out: list[tuple[np.ndarray, ...]] = []
        q_ids = asked.column("vec_id").to_numpy()
        low, high = asked.column("low").to_numpy(), asked.column("high").to_numpy()
        base = _ordered(low)
        width = (_ordered(high) - base) // np.uint64(bins) + np.uint64(1)
        for part, tiles in _tiles(asked, rows):
            held = np.zeros((part.stop - part.start, bins), np.int64)
            for scores, _, own in tiles:
                who, what = np.nonzero((scores >= low[part, None]) & (scores <= high[part, None]) & ~own)
                place = (_ordered(scores[who, what]) - base[part][who]) // width[part][who]
                held += np.bincount(who * bins + place.astype(np.int64), minlength=held.size).reshape(held.shape)
            higher = held[:, ::-1].cumsum(axis=1)[:, ::-1] - held
            who, where = np.nonzero((held > 0) & (higher < k))
            out.append((q_ids[part][who], where.astype(np.int32), held[who, where]))
        return _table(out, (np.int64, np.int32, np.int64), ("query_id", "bin", "n"))

    return count


def _keeping(k: int):
    def keep(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """Per query the cell's k best among the scores at its edge or above."""
        out: list[tuple[np.ndarray, ...]] = []
        q_ids, edge = asked.column("vec_id").to_numpy(), asked.column("low").to_numpy()
        for part, tiles in _tiles(asked, rows):
            held = [np.zeros(0, np.int64) for _ in range(3)]
            for scores, ids, own in tiles:
                who, where = np.nonzero((scores >= edge[part, None]) & ~own)
                held = [np.concatenate(two) for two in zip(held, (who, ids[where], scores[who, where]), strict=True)]
                order = np.lexsort((held[1], ~held[2], held[0]))  # ~s falls as s grows, without overflow
                held = [h[order] for h in held]
                nth = np.arange(len(held[0])) - np.searchsorted(held[0], held[0])
                held = [h[nth < k] for h in held]
            out.append((q_ids[part][held[0]], held[1], held[2]))
        return _table(out, (np.int64,) * 3, ("query_id", "vec_id", "score"))

    return keep


def _table(parts: list[tuple[np.ndarray, ...]], kinds: tuple, names: tuple[str, ...]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [()] * len(names)
    return pa.table({n: np.concatenate([np.zeros(0, t), *c]).astype(t) for n, t, c in zip(names, kinds, columns, strict=True)})


def _dealt(rows: DataFrame, asked: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every cell of the grid: each query meets the rows of its length once."""
    deal = lambda group, n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int").alias(group)
    every = lambda group, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(group)
    left = asked.select("dim", every("rg", "row_groups"), deal("qg", "query_groups"), "vec_id", "v", "low", "high")
    right = rows.select("dim", deal("rg", "row_groups"), every("qg", "query_groups"), "vec_id", "v")
    return left.groupBy("dim", "rg", "qg").cogroup(right.groupBy("dim", "rg", "qg")).applyInArrow(work, schema)


def search(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, bins: int = BINS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the k highest scores among all other rows."""
    bound_arrow_batches(embeddings.sparkSession, 2048)
    rows = stage(usable(embeddings, scale, id_col, vector_col).withColumn("dim", F.size("v")), "topk-rows")
    size, largest = F.col("dim") * 8, F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"), F.coalesce(F.max(largest), F.lit(0.0)).alias("largest"))
    row_groups = F.greatest(F.ceil(F.col("n") * size / ROW_BYTES), F.least(F.lit(SPREAD), F.ceil(F.col("n") / TILE[0])), F.lit(1)).cast("int")
    query_groups = F.greatest(F.ceil(F.col("asked") * size / QUERY_BYTES), F.lit(1)).cast("int")
    lengths = stage(lengths.filter("asked > 0").select("dim", "largest", row_groups.alias("row_groups"), query_groups.alias("query_groups")), "topk-lengths")
    rows = rows.join(broadcast_if_small(lengths), "dim")
    queries = stage(rows.filter(F.col("vec_id") % every == 0), "topk-queries")
    # no score leaves -reach to reach
    total = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.abs(c.cast("double")))
    reach = F.ceil(F.least(total * F.col("largest") * (1 + 1e-9) + 1, F.lit(2.0**63)).cast("decimal(30,4)"))
    clipped = lambda c: F.greatest(F.least(c, F.lit(_MOST)), F.lit(_LEAST)).cast("long")
    state = queries.select(F.col("vec_id").alias("query_id"), clipped(-reach).alias("low"), clipped(reach).alias("high"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("settled"))
    state = stage(state, "topk-state")
    while not state.filter("NOT settled").isEmpty():
        open_ones = state.filter("NOT settled")
        asked = queries.join(open_ones.withColumnRenamed("query_id", "vec_id"), "vec_id")
        counted = _dealt(rows, asked, _counting(k, bins), _COUNTED).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        state = stage(state.filter("settled").unionByName(_narrowed(open_ones, counted, k, bins)), "topk-state")
    asked = queries.join(state.withColumnRenamed("query_id", "vec_id"), "vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _dealt(rows, asked, _keeping(k), _FOUND).withColumn("rank", F.row_number().over(best))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _narrowed(state: DataFrame, counted: DataFrame, k: int, bins: int) -> DataFrame:
    """The state after a pass: the bin of the k-th score as the new range.  Where all bins together hold fewer than k, the range's
    lower end is the edge."""
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most ``bins`` rows a query
    reached = counted.join(state, "query_id").withColumn("run", F.sum("n").over(down) + F.col("above")).filter(F.col("run") >= k)
    at = reached.groupBy("query_id").agg(F.max(F.struct("bin", "n", "run")).alias("at"))
    met = state.drop("settled").join(at, "query_id", "left")
    wide = F.expr(f"(cast(high AS decimal(20,0)) - cast(low AS decimal(20,0))) div {bins} + 1").cast("decimal(20,0)")
    edge = F.col("low").cast("decimal(20,0)") + F.coalesce("at.bin", F.lit(0)).cast("decimal(10,0)") * wide
    high = F.when(F.col("at").isNull(), F.col("high")).otherwise(F.least(F.col("high"), edge + wide - 1).cast("long"))
    settled = F.col("at").isNull() | (wide == 1) | (F.col("at.run") <= NEAR * k)
    above = F.coalesce(F.col("at.run") - F.col("at.n"), F.col("above"))
    return met.select("query_id", edge.cast("long").alias("low"), high.alias("high"), above.alias("above"), settled.alias("settled"))
