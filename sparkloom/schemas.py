"""Explicit schemas of the chunk store and of messages."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("doc_name", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("chapter_path", T.StringType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
        T.StructField("overlap_prev", T.IntegerType()),
        T.StructField("overlap_next", T.IntegerType()),
        T.StructField("dense_vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)

#: What a search gives of a chunk: all but its vector.
SCAN_FIELDS = [f.name for f in CHUNK if f.name != "dense_vector"]

#: One element of a conversation held as an array.
MESSAGE = "struct<turn: bigint, role: string, content: string, calls: string, tool_call_id: string, name: string>"
MESSAGES = f"array<{MESSAGE}>"
