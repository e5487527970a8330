"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Every stage works on all rows that the one before it kept and returns the columns of ``documents``; the last adds the ids of the
text.  A mixed corpus repeats documents, so rows may repeat from that stage on.

SQL can't say a learned score, shingle links and BPE merges, so ``ORACLE_SQL`` is None; the tests hold the pipeline
against brute-force versions of its stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from sparkloom.llm.common import stage
from sparkloom.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the smallest doc_id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 of five-word shingles: the smallest doc_id."""
    return near_dedup.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, n_tokens, ids_sha256 and decoded_sha256."""
    return bpe.digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
