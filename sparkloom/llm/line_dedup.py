"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate.  Each line hash gets a HyperLogLog sketch of its sites; sketches merge by
aggregation, within scan tasks first, so that a line in a third of the documents costs each task one sketch.  Estimates far from the
threshold decide; lines near it get exact distinct counts.  Lines on ``min_sites`` sites or more are removed from all
documents.  DataFrame functions do all of it.

Lines are compared without blanks, tabs and returns at their ends; blank lines are never removed.  A line's identity is
96 bits of hash (xxHash64 and Murmur3 of the line).

Defined cases: a null text counts as empty, which is one blank line; a null site is a site of its own; rows that repeat count
once for their site, and each is cleaned; a document of boilerplate alone becomes the empty text; ties don't occur, as the
threshold is inclusive; an empty table gives an empty result; further columns pass through ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, picked, stage, text_of, unwrapped, wrapped

MIN_SITES = 8
LG_K = 12
#: Half-width of the band that is counted exactly, as a share of the threshold: six standard errors of a sketch.
BAND = 6 * 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.hash(line).alias("g")]


def exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, tkey, site, pos, h, g of every line that isn't blank."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("-"))
    named = picked(docs, id=id_col, text=text_col, site=site_col)
    rows = named.select("id", F.xxhash64(text_of()).alias("tkey"), site.alias("site"), F.posexplode(_lines(text_of())).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(" \t\r")))
    return rows.filter("line <> ''").select("id", "tkey", "site", "pos", *_identity(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, g of the lines on ``min_sites`` sites or more."""
    low, high = min_sites * (1 - BAND) - 0.5, min_sites * (1 + BAND) + 0.5
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")).filter(F.col("sites") >= low)
    spread = stage(spread, "spread")
    near = spread.filter(F.col("sites") <= high).select("h", "g")
    counted = lines.join(broadcast_if_small(near), ["h", "g"]).select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("n"))
    wide = spread.filter(F.col("sites") > high).select("h", "g")
    return stage(wide.unionByName(counted.filter(F.col("n") >= min_sites).select("h", "g")), "boilerplate")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", to: str = "clean") -> DataFrame:
    """The input's columns, the text without boilerplate lines in column ``to``, n_lines and n_removed."""
    lines = exploded(docs, id_col, text_col, site_col)
    hits = lines.join(broadcast_if_small(boilerplate(lines, min_sites)), ["h", "g"])
    # positions depend on the text alone; the id in the key keeps copies of a text apart
    gone = hits.groupBy(F.col("id").alias("gone_id"), F.col("tkey").alias("gone_key")).agg(F.collect_set("pos").alias("gone"))
    keyed = wrapped(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64(text_of()))
    met = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    # a column of its own, which the text below reads twice: Spark then doesn't split the text again for every line
    met = met.withColumn("__lines", _lines(text_of())).withColumn("__gone", F.coalesce(F.col("gone"), F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.size("__gone") == 0, text_of()).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n"))
    return unwrapped(met, docs.columns, **{to: text, "n_lines": F.size("__lines"), "n_removed": F.size("__gone")})
