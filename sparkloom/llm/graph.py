"""Connected components of an edge table, by alternating stars; no neighbour list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_freed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges(a, b)``; the label is the smallest node reachable.

    Large stars hang every larger neighbour of a node on the node's smallest neighbour, small stars do so with the smaller
    ones; the two in turn turn each component into one star (Kiveris et al. 2014).  Sums of 64-bit hashes tell when
    nothing moves any more."""
    now, mark = edges.select("a", "b").filter("a <> b").distinct().checkpoint(), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = down.join(low, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = small.filter("a <> b").distinct().checkpoint()
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(told) == mark:
            break
        mark = tuple(told)
        files_freed(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
