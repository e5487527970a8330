"""Mixing sources to target weights.

Words are summed by source, each source gets a target, and a document is taken floor(rate) times plus one more copy with
the rate's fraction as its probability, where rate = target / words of its source.  The draw hashes the document's id with
a seed, so reruns agree.  For each source the seed is the best of ``trials``: the one whose drawn words come nearest to
the target.  All trials are summed in the one aggregation, and any of them is an honest Bernoulli draw.

Targets: the sources in code point order, null last, weigh ``weights[0], weights[1], ...`` in turn and share all words.
A target stops at ``cap`` times its source's words; the excess is shared again by weight until no target is above.  That
loop runs over the source table with sums alone coming back, and the rank of a source comes from a range partitioning,
so the number of sources is not bounded by one task or the driver.

Defined cases: null and empty texts have size 0 and are taken 0 words and 0 copies; null ids share one draw; rows that repeat an id share its draw; a null source is a
source of its own; no document, or none with words, gives targets of 0; an empty table gives an empty result; further columns pass
through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, broadcast_if_small, picked, shared_dir, stage, text_of, unwrapped, wrapped

WEIGHTS = (1, 2, 3)
CAP = 3
TRIALS = 16


def n_words(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD.replace("\\x20", " "))).cast("long")


def _draw(id_col: Column, trial: int) -> Column:
    """A number in [0, 1) from 32 bits of an MD5 of the seed and the id; four trials share a digest."""
    digest = F.md5(F.concat(F.lit(f"mix-{trial // 4}-"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1 + 8 * (trial % 4), 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_table(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target from rows of (source, size)."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.withColumn("missing", F.col("source").isNull()).repartitionByRange("missing", "source")
    placed = ordered.withColumn("part", F.spark_partition_id()).checkpoint()
    # One number for each range partition: the sources before it.
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part int, before long")
    inside = Window.partitionBy("part").orderBy("missing", "source")
    place = F.row_number().over(inside) - 1 + F.col("before")
    ranked = placed.join(F.broadcast(offsets), "part").withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    )
    wide = ranked.select("source", "source_size", "weight", F.col("weight").cast("decimal(38,0)").alias("w"), F.col("source_size").cast("decimal(38,0)").alias("s"))
    sums = wide.agg(F.sum("s").alias("s"), F.sum("w").alias("w")).first()
    if not sums["w"]:
        return wide.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    share, held = (int(sums["s"]), int(sums["w"])), -1
    while True:
        above = F.col("w") * F.lit(share[0]).cast("decimal(38,0)") > F.col("s") * F.lit(cap * share[1]).cast("decimal(38,0)")
        got = wide.agg(
            F.sum(F.when(above, F.col("s"))).alias("capped"), F.sum(F.when(~above, F.col("w"))).alias("open"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if got["n"] == held or not got["open"]:
            break
        held, share = got["n"], (int(sums["s"]) - cap * int(got["capped"] or 0), int(got["open"]))
    even = F.col("weight") * F.lit(share[0]).cast("double") / F.lit(share[1]).cast("double")
    return wide.select("source", "source_size", "weight", F.least(even, (cap * F.col("source_size")).cast("double")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size of every row, written once: three passes follow, and none reads a text again."""
    named = picked(docs, doc_id=id_col, source=source_col, text=text_col)
    return stage(named.select("doc_id", "source", n_words().alias("size")), "sizes")


def _planned(docs: DataFrame, sized: DataFrame, size: Column, weights: tuple[int, ...], cap: int, trials: int) -> DataFrame:
    """The columns of ``docs(doc_id, source, ...)``, __size, __copies and, as __of, what the mix decides for the source."""
    shared_dir(docs.sparkSession)  # checkpoint() below needs the folder
    rates = stage(source_table(sized, weights, cap).withColumnRenamed("source", "s_source"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = rates.withColumn("whole", F.floor(rate).cast("long")).withColumn("part", rate - F.floor(rate))
    drawn = [F.sum(F.when(_draw(F.col("doc_id"), t) < F.col("part"), F.col("size")).otherwise(F.lit(0).cast("long"))) for t in range(trials)]
    sums = (
        sized.join(broadcast_if_small(rates), F.col("source").eqNullSafe(F.col("s_source")))
        .groupBy("s_source", "source_size", "target", "whole", "part")
        .agg(F.array(*drawn).alias("drawn"))
    )
    off = F.transform("drawn", lambda x: F.abs(x + F.col("whole") * F.col("source_size") - F.col("target")))
    seeded = sums.withColumn("trial", F.array_position(off, F.array_min(off)) - 1).drop("drawn")
    seeded = stage(seeded, "seeds")
    chosen = F.lit(None).cast("double")
    for t in range(trials):
        chosen = F.when(F.col("__of.trial") == t, _draw(F.col("doc_id"), t)).otherwise(chosen)
    copies = F.when(F.col("__size") > 0, F.col("__of.whole") + (chosen < F.col("__of.part")).cast("long")).otherwise(F.lit(0).cast("long"))
    met = docs.withColumn("__size", size).join(
        broadcast_if_small(seeded.select("s_source", F.struct("source_size", "target", "whole", "part", "trial").alias("__of"))),
        F.col("source").eqNullSafe(F.col("s_source")),
    )
    return met.withColumn("__copies", copies).drop("s_source")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, trials: int = TRIALS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    sized = _sized(docs, id_col, text_col, source_col)
    return _planned(sized, sized, F.col("size"), weights, cap, trials).select(
        "doc_id", "source", F.col("__size").alias("size"), "__of.source_size", "__of.target",
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, trials: int = TRIALS) -> DataFrame:
    """The mix itself: each input row as often as it is taken, with the input's columns."""
    sized = _sized(docs, id_col, text_col, source_col)
    rows = wrapped(docs, doc_id=id_col, source=source_col, text=text_col)
    planned = _planned(rows, sized, n_words(), weights, cap, trials).filter("__copies > 0")
    return unwrapped(planned.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))), docs.columns)
