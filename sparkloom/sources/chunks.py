"""Documents cut into overlapping chunks, and chunks merged again; ``sparkloom.sources.store`` keeps collections of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X

WINDOW, STEP = 512, 448


def from_documents(docs: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """One row a chunk.  Chunks overlap by ``window - step`` characters; merging them gives the text back.

    A text is cut once, into pieces of ``step`` characters that don't overlap; a chunk is a piece and the head of the next."""
    overlap = window - step
    if not 0 <= overlap <= step:
        raise ValueError("a chunk reaches into the next one at most")
    n = F.length("text")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}+"), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    pairs = F.arrays_zip(pieces.alias("a"), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))).alias("b"))
    rows = docs.filter("text IS NOT NULL").select("doc_id", "lang", "source", n.alias("n"), count.alias("chunks"), F.posexplode_outer(pairs).alias("pos", "pair"))
    rows = rows.withColumn("i", F.coalesce("pos", F.lit(0))).filter(F.col("i") < F.col("chunks"))
    start = F.col("i") * step
    chapter = F.concat(F.lit("part "), F.floor(F.col("i") / 4).cast("string"))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    cut = rows.withColumn("start_pos", start.cast("int")).withColumn("end_pos", F.least(start + window, F.col("n")).cast("int"))
    return cut.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("id"),
        "doc_id",
        name.alias("doc_name"),
        chapter.alias("chapter"),
        F.concat_ws("/", "lang", "source", chapter).alias("chapter_path"),
        F.col("i").alias("chunk_idx"),
        F.concat(F.coalesce("pair.a", F.lit("")), F.left(F.coalesce("pair.b", F.lit("")), F.lit(overlap))).alias("content"),
        X.title(name, chapter).alias("title"),
        "start_pos",
        "end_pos",
        F.when(F.col("i") == 0, 0).otherwise(overlap).alias("overlap_prev"),
        F.when(F.col("i") == F.col("chunks") - 1, 0).otherwise(overlap).alias("overlap_next"),
        (F.lit(1704067200000) + F.col("doc_id")).alias("created_at"),
    )


def predicate(doc_name: str | None = None, chapter_prefix: str | None = None) -> Column:
    """Document name and literal chapter prefix; an empty one counts as absent."""
    out = F.lit(True)
    if doc_name:
        out = out & (F.col("doc_name") == doc_name)
    if chapter_prefix:
        out = out & F.startswith(F.col("chapter_path"), F.lit(chapter_prefix))
    return out


def chapter_scan(chunks: DataFrame, doc_name: str, prefix: str | None, fields: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Chunks of a document below a chapter by index, all of them or the first ``cap``."""
    found = chunks.filter(predicate(doc_name, prefix)).select(*(sorted({*fields, "chunk_idx"}) if fields else chunks.columns))
    in_order = found.orderBy(F.coalesce("chunk_idx", F.lit(0)))
    return in_order if cap is None else in_order.limit(cap)


def chapter(chunks: DataFrame, doc_name: str, prefix: str | None, ignore_overlap: bool = False) -> DataFrame:
    """One record of a document's chapter: doc_name, chapter_path, text, n_chunks; an empty text and 0 where there is no chunk."""
    found = merged(chunks.filter(predicate(doc_name, prefix)), ["doc_name"], ignore_overlap)
    asked = chunks.sparkSession.createDataFrame([(doc_name, prefix or "")], "doc_name string, chapter_path string")
    met = asked.join(found, "doc_name", "left")
    return met.select("doc_name", "chapter_path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def merged(chunks: DataFrame, by: list[str], ignore_overlap: bool = False) -> DataFrame:
    """The chunks of each group in index order as one text.  A chunk after the first loses the characters it shares with the
    one before, unless that is all it has."""
    piece = F.struct(F.coalesce("chunk_idx", F.lit(0)).alias("i"), F.coalesce("overlap_prev", F.lit(0)).alias("o"), F.coalesce("content", F.lit("")).alias("c"))
    sorted_pieces = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    whole = lambda x: (F.lit(ignore_overlap)) | (x["o"] <= 0) | (x["o"] >= F.length(x["c"]))
    text = F.transform("p", lambda x, at: F.when((at == 0) | whole(x), x["c"]).otherwise(F.substring(x["c"], x["o"] + 1, F.length(x["c"]))))
    return sorted_pieces.select(*by, F.array_join(text, "").alias("text"), F.size("p").alias("n_chunks"))
