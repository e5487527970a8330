"""Repeated passages by sparse suffixes.

Passages of ``length`` words or more that occur more than once, within a document or in several, are found by their sparse
suffixes.  A suffix is retained where its first ``gram`` words have the smallest hash of the ``length - gram + 1`` grams of a
passage: equal passages of ``length`` words retain a suffix at the same place, and about one word in 20 retains one.  A suffix answers
for the passages that chose it; the words of these are its context.

1. Retained suffixes are counted by the hash of their first words; those that occur once are done with.
2. Suffixes with the same context repeat it as a whole.  From there on such a group is one entry, so a passage that a third of the
   documents hold never gathers.
3. An entry can repeat a passage with another only if both share half of one around the gram: ``(length - gram) // 2`` words before
   it, or the words from it on that fill a passage up.  Entries that share neither half with another entry are done with.
4. The others of each gram are sorted by the words from it on, and by the words before it from right to left.  Neighbours are compared:
   the lowest of the common lengths between two entries of an order is what these share, so that one pass with a stack tells every length
   at which an entry shares words with another one.
5. Matches are extended: the entries that share ``r`` words from the gram on, for each such ``r``, are sorted by the words before it, where an
   entry's neighbours have the longest common words ``l`` of all.  With ``l + r >= length`` it is a repeat.  All passages of an
   entry hold its gram, so its repeats are one run of words: the furthest reach before the gram and after it.

Orders are range-partitioned by whole entries, so a frequent gram is spread; a task hands on its last entry and its stack, a row
a partition.

Overlapping repeats of a document are merged, which restores passages longer than a context.  Words are those between ASCII white
space, with A-Z lower-cased; they are compared as hashes
(64 bits for a word, a gram, a half, a shared beginning and a whole context).

Defined cases: a null, empty or short text has no repeats; rows that repeat an id and a text are places of their own; ``match_id`` is
the smallest id among the places found equal, the document's own if it repeats itself alone; null ids take part; an empty table gives an
empty result; other columns and their names play no part; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, ascii_lower_words, batches, bound_arrow_batches, broadcast_if_small, ngram_hashes, picked, returned_memory, shared_dir, stage, text_of

LENGTH, GRAM = 50, 6

_SUFFIX = pa.schema(
    [("doc_id", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64()), ("context", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("head", pa.int64()), ("tail", pa.int64())]
)
_SUFFIX_SQL = "doc_id long, tkey long, pos int, gram long, context long, left int, right int, head long, tail long"
_CONTEXT = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("own", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
_CONTEXT_SQL = "gram long, context long, own long, before binary, after binary"
_MET = pa.schema(
    [("gram", pa.int64()), ("context", pa.int64()), ("own", pa.int64()), ("kind", pa.int32()), ("mark", pa.int64()), ("part", pa.int32()), ("low", pa.int32()), ("depths", pa.list_(pa.int32()))]
    + [("node", pa.int64()), ("edge", pa.binary())]
)
_MET_SQL = "gram long, context long, own long, kind int, mark long, part int, low int, depths array<int>, node long, edge binary"
_ALL = 2**31 - 1
_HEAD, _TAIL = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class _Runs:
    """Hashes of runs of words: a polynomial over the words, read off prefix sums."""

    def __init__(self):
        self.base, self.back = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def read(self, hashes: np.ndarray) -> None:
        if len(self.powers) <= len(hashes):
            grow = 2 * len(hashes) + 1
            self.powers, self.inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(grow, b, np.uint64))]) for b in (self.base, self.back))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.powers[: len(hashes)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def retained(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the retained suffixes, their gram hashes, and how far left and right their contexts reach."""
    grams, window = ngram_hashes(hashes, gram), length - gram + 1
    if len(grams) < window:
        none = np.zeros(0, np.int64)
        return none, grams[:0], none, none
    chosen = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1) + np.arange(len(grams) - window + 1)
    places, first, count = np.unique(chosen, return_index=True, return_counts=True)  # a place is chosen by one run of passages
    return places, grams[places], places - first, first + count - 1 + length - places


def suffixes(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each retained suffix: its place, gram, hash and reach of the context, and the hashes of the two halves that its
    passages have in common, null where the context doesn't reach that far."""
    bound_arrow_batches(docs.sparkSession)
    before = (length - gram) // 2  # a passage holds as many words before the gram, or else ``upto`` words from there on
    upto = length + 1 - before

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        runs = _Runs()
        for part in parts:
            out = [[] for _ in _SUFFIX]
            for doc_id, tkey, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                hashes = memo.of(ascii_lower_words(text))
                places, grams, left, right = retained(hashes, length, gram)
                if not len(places):
                    continue
                runs.read(hashes)
                context = runs.of(places - left, places + right)
                context ^= (left * 1000 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                n, far, wide = len(places), left >= before, right >= upto
                head = runs.of(places - np.where(far, before, 0), places + gram) ^ _HEAD
                tail = runs.of(places, places + np.where(wide, upto, 0)) ^ _TAIL
                halves = (pa.array(h.view(np.int64), mask=~has) for h, has in ((head, far), (tail, wide)))
                for column, values in zip(out, ([doc_id] * n, [tkey] * n, places, grams.view(np.int64), context.view(np.int64), left, right, *halves), strict=True):
                    column.append(pa.array(values, pa.int64()) if isinstance(values, list) else values if isinstance(values, pa.Array) else pa.array(values))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c).cast(f.type) for c, f in zip(out, _SUFFIX, strict=True)], schema=_SUFFIX)

    raw = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("tkey"), text_of().alias("text"))
    return raw.mapInArrow(work, _SUFFIX_SQL)


def _contexts(docs: DataFrame, entries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """gram, context, the entry's smallest id, and the hashes of the words before the gram, from right to left, and from it on."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            memo = WordHashes()
            for part in parts:
                for text, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = memo.of(ascii_lower_words(text)).astype(">u8")
                    for w in wanted:
                        at = w["pos"]
                        yield w["gram"], w["context"], w["own"], words[at - w["left"] : at][::-1].tobytes(), words[at : at + w["right"]].tobytes()

        with returned_memory():
            yield from batches(_CONTEXT, rows(), 4096)

    by_doc = entries.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("gram", "context", "pos", "left", "right", "own")).alias("wanted")).withColumnsRenamed({"doc_id": "w_id", "tkey": "w_key"})
    keys = entries.select(F.col("doc_id").alias("k_id"), F.col("tkey").alias("k_key")).distinct()
    raw = picked(docs, d_id=id_col, text=text_col).select(F.col("d_id").cast("long"), F.xxhash64(text_of()).alias("d_key"), text_of().alias("text"))
    raw = raw.join(broadcast_if_small(keys), F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_key") == F.col("k_key")), "left_semi")
    met = raw.join(by_doc, F.col("d_id").eqNullSafe(F.col("w_id")) & (F.col("d_key") == F.col("w_key")))
    return met.select("text", "wanted").mapInArrow(work, _CONTEXT_SQL).dropDuplicates(["gram", "context"])


def _alike(entries: DataFrame) -> DataFrame:
    """The entries that share a half with another one."""
    halved = entries.withColumn("half", F.explode(F.array_compact(F.array("head", "tail"))))
    shared = stage(halved.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"), "halves")
    return halved.join(shared, "half").drop("half", "head", "tail").dropDuplicates(["gram", "context"])


def _common(nodes: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """How many words each key shares with the one before it; -1 between different nodes."""
    sizes = np.fromiter((len(k) // 8 for k in keys), np.int64, len(keys))
    wide = int(sizes.max())
    words = np.frombuffer(b"".join(k.ljust(8 * wide, b"\0") for k in keys), np.uint64).reshape(len(keys), wide)
    differ = np.ones((len(keys) - 1, wide + 1), bool)
    differ[:, :wide] = words[1:] != words[:-1]
    return np.where(nodes[1:] == nodes[:-1], np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1])), -1)


def _below(depths: list[int], common: int) -> list[int]:
    """The lengths shared with earlier entries, once the next one shares ``common`` words with the last."""
    while depths and depths[-1] >= common:
        depths.pop()
    if common >= 0:
        depths.append(common)
    return depths


def _one_way(rows: DataFrame, down: bool) -> DataFrame:
    """``rows`` with ``depths``: the different numbers of words that an entry's key shares with those of its node that precede it."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, low, depths, last = TaskContext.get().partitionId(), _ALL, [], None
        names = [f.name for f in _MET]

        def border(node: int, key: bytes) -> pa.RecordBatch:
            values = {"part": part, "low": low, "depths": list(depths), "node": node, "edge": key}
            return pa.RecordBatch.from_pylist([values], schema=_MET)

        for batch in parts:
            if not batch.num_rows:
                continue
            nodes, keys = batch.column("node").to_numpy(), batch.column("key").to_pylist()
            if last is None:
                yield border(int(nodes[0]), keys[0])
                common = [None, *_common(nodes, keys).tolist()]
            else:
                common = _common(np.concatenate([[last[0]], nodes]), [last[1], *keys]).tolist()
            lows, stacks = [], []
            for c in common:
                if c is not None:
                    low, depths = min(low, c), _below(depths, c)
                lows.append(low)
                stacks.append(list(depths))
            last = int(nodes[-1]), keys[-1]
            told = {"part": pa.array([part] * len(keys), pa.int32()), "low": pa.array(lows, pa.int32()), "depths": pa.array(stacks, pa.list_(pa.int32()))}
            told |= {n: batch.column(n) for n in ("gram", "context", "own", "kind", "mark")}
            yield pa.RecordBatch.from_arrays([told[n] if n in told else pa.nulls(len(keys), _MET.field(n).type) for n in names], schema=_MET)
        if last is not None:
            yield border(*last)

    order = [F.desc(c) if down else F.asc(c) for c in ("node", "key", "gram", "context")]
    met = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, _MET_SQL), "met")
    # two rows a partition: its first key; its last one with the stack there
    borders = sorted(met.filter("edge is not null").select("part", "low", "depths", "node", "edge").collect(), key=lambda b: (b["part"], -b["low"], len(b["depths"])))
    carry, carries, last = [], [], None
    for first, end in zip(borders[::2], borders[1::2], strict=True):
        if last is not None:
            carry = _below(carry, int(_common(np.array([last["node"], first["node"]]), [bytes(last["edge"]), bytes(first["edge"])])[0]))
        carries.append((first["part"], list(carry)))
        carry = [d for d in carry if d < end["low"]] + end["depths"]
        last = end
    handed = F.broadcast(rows.sparkSession.createDataFrame(carries, "part int, carry array<int>"))
    whole = met.filter("edge is null").drop("node", "edge").join(handed, "part")
    return whole.withColumn("depths", F.concat(F.filter("carry", lambda d: d < F.col("low")), "depths")).drop("carry", "low", "part")


def shared_lengths(rows: DataFrame) -> DataFrame:
    """Each row (node, key, gram, context, own, kind, mark) twice, without node and key: ``depths`` holds the different numbers of words
    that its key shares with those of the same node that are sorted before it, and after it."""
    return _one_way(rows, False).unionByName(_one_way(rows, True))


def matched(contexts: DataFrame, length: int) -> DataFrame:
    """gram, context, l, r, other: how far the passages that an entry shares with others reach, and the smallest id of those."""
    entry = contexts.select("gram", "context", "own", F.lit(0).cast("long").alias("mark"), "before", "after")
    sides = entry.withColumn("at", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("after").alias("key")))))
    sides = sides.select("gram", "context", "own", "mark", "at.kind", "at.key", F.xxhash64("gram", "at.kind").alias("node"))
    lengths = shared_lengths(sides).groupBy("gram", "context").agg(
        F.max(F.when(F.col("kind") == 0, F.array_max("depths"))).alias("left"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == 1, F.col("depths"))))).alias("rights")
    )
    lengths = stage(lengths.withColumn("rights", F.filter("rights", lambda r: r + F.col("left") >= length)).filter(F.size("rights") > 0), "lengths")
    shared = contexts.join(lengths, ["gram", "context"]).withColumn("kind", F.explode("rights"))
    shared = shared.withColumn("node", F.expr("xxhash64(gram, kind, substring(after, 1, 8 * kind))"))
    shared = shared.withColumn("mark", F.expr(f"xxhash64(node, substring(before, 1, 8 * ({length} - kind)))"))
    nodes = stage(shared.select("node", F.col("before").alias("key"), "gram", "context", "own", "kind", "mark"), "nodes")
    extended = shared_lengths(nodes).withColumn("l", F.array_max("depths")).filter(F.col("l") + F.col("kind") >= length)
    extended = stage(extended.groupBy("gram", "context", "own", "kind", "mark").agg(F.max("l").alias("l")), "extended")
    firsts = stage(extended.groupBy("mark").agg(F.min("own").alias("other")), "firsts")
    return extended.join(firsts, "mark").groupBy("gram", "context").agg(F.max("l").alias("l"), F.max("kind").alias("r"), F.min("other").alias("other"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each repeated passage of a document: doc_id, start_word, end_word (exclusive), n_words, match_id."""
    shared_dir(docs.sparkSession)
    kept = stage(suffixes(docs, length, gram, id_col, text_col), "suffixes")
    # written, so that the join below shuffles both sides by itself and Spark can split a frequent gram's partition
    often = stage(kept.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    kept = stage(kept.join(often, "gram"), "repeated")
    groups = kept.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("own"), F.min(F.struct("doc_id", "tkey", "pos", "left", "right", "head", "tail")).alias("at")
    )
    groups = groups.checkpoint()
    several = stage(groups.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("gram"), "several")
    entries = stage(groups.join(several, "gram").select("gram", "context", "own", "at.*"), "entries")
    contexts = stage(_contexts(docs, stage(_alike(entries), "alike"), id_col, text_col), "contexts")
    matches = matched(contexts, length)
    whole = groups.filter("n > 1").select("gram", "context", F.col("at.left").alias("l"), F.col("at.right").alias("r"), F.col("own").alias("other"))
    # the two sides of a join on (gram, context): places, and at most two rows an entry
    told = stage(matches.unionByName(whole).groupBy("gram", "context", "l", "r").agg(F.min("other").alias("other")), "told")
    spans = kept.join(told, ["gram", "context"]).select("doc_id", "tkey", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e"), "other")
    spans = spans.groupBy("doc_id", "tkey", "s", "e").agg(F.min("other").alias("other"))
    by_doc = Window.partitionBy("doc_id", "tkey").orderBy("s", "e")
    before = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("s") < before, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc))
    merged = islands.groupBy("doc_id", "tkey", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("other").alias("match_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "match_id")
