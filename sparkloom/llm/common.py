"""Helpers that the corpus operators share: staging tables, checked broadcasts, word splitting and hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is broadcast; past it the same join shuffles.
BROADCAST_ROWS = 200_000

#: A key with this share of the rows or more is joined by broadcast: at most a thousand keys.
HOT_KEYS = 1000

#: A run of anything but ASCII white space, as the contracts define a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a single machine gets a fresh local one, and a
    cluster, whose executors would not see that, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there and a lost executor
    costs a reread, not a recomputation.  The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def files_freed(spark: SparkSession) -> None:
    """Shuffle and checkpoint files that nothing refers to any more go now: Spark removes them when the driver's collector meets
    their owners, which a driver with room to spare may put off for the whole run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when it is counted to hold at most ``limit`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_join(many: DataFrame, one: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with a table of unique keys that knows how many rows of ``many`` each meets (``weight``): keys with a thousandth of them or
    more are at most a thousand and are broadcast, the others are shuffled."""
    total = one.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(one.filter(F.col(weight) >= max(total / HOT_KEYS, 1.5)))
    cold = one.filter(F.col(weight) < max(total / HOT_KEYS, 1.5))
    return many.join(hot.drop(weight), on).unionByName(many.join(hot.select(*on), on, "left_anti").join(cold.drop(weight), on))


def _place(names: list[str], name: str) -> int:
    """Where a column is: by its exact name, else by the name in any case."""
    if name in names:
        return names.index(name)
    return [n.lower() for n in names].index(name.lower())


def picked(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` under the keywords' names.  Other columns can't clash, whatever they are called."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{_place(df.columns, name)}").alias(key) for key, name in wanted.items()])


def wrapped(df: DataFrame, **wanted: str) -> DataFrame:
    """As ``picked``, with the whole row as one struct ``__row`` besides; ``unwrapped`` takes it apart again."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(F.struct(*plain.columns).alias("__row"), *[F.col(f"c{_place(df.columns, name)}").alias(key) for key, name in wanted.items()])


def unwrapped(df: DataFrame, names: list[str], **added: Column) -> DataFrame:
    """The row's own columns and the added ones; an added column takes the place of one with its name."""
    kept = [i for i, n in enumerate(names) if n.lower() not in {a.lower() for a in added}]
    out = df.select(*[F.col(f"__row.c{i}") for i in kept], *added.values())
    return out.toDF(*[names[i] for i in kept], *added)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds))


def ascii_lower_words(text: str | bytes | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased.  ``bytes`` methods touch ASCII only, as the contract asks."""
    if not text:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.lower().split()


class Memo(dict):
    """Remembers what ``make`` gives for a text, in two generations of ``room`` bytes each, about.

    What the younger lacks is looked up in the older one; a younger one that is full becomes the older.  So what is asked for often
    stays, however much is asked for once, and a long key is made anew each time."""

    #: Bytes of an entry besides its characters, and the longest key that is remembered.
    ENTRY, LONGEST = 200, 512

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room, self.held, self.older = make, room, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.LONGEST:
                return value
        self.held += self.ENTRY + 2 * len(key)
        if self.held > self.room:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value


class WordHashes(Memo):
    """word -> 64-bit hash, remembering words of up to twice ``room`` bytes."""

    def __init__(self, room: int = 8 << 20):
        super().__init__(xxhash.xxh3_64_intdigest, room)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


@cache
def _c_library():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


@contextmanager
def returned_memory():
    """At the end, what a worker's task has freed goes back to the system: Python workers outlive tasks and stages."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _c_library() is not None:
            _c_library().malloc_trim(0)


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def scramble(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` neighbours; nothing for fewer than ``n`` words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = scramble(out * _MIX[0] + hashes[i : i + count] + np.uint64(i + 1))
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a document's ``n``-word shingles; a shorter document is one shingle, an empty one none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < n:
        return ngram_hashes(np.append(hashes, np.uint64(len(hashes))), len(hashes) + 1)
    return np.unique(ngram_hashes(hashes, n))


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 2048, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack tuples into Arrow batches of at most ``size`` rows and about ``budget`` bytes of text."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or weight >= budget:
            yield _pack(schema, held)
            held, weight = [], 0
    if held:
        yield _pack(schema, held)


def _pack(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def bound_arrow_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and ``size`` bytes, so that a batch of long texts stays in a worker's
    memory.  Spark takes these from the session alone; larger settings of the caller's are lowered, smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
