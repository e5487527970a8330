"""Collocations: phrases of 2 to 5 words that occur often, by how much oftener than their parts let expect.

Words are counted per language first.  Texts are kept as runs of 64-bit word hashes (seeded by the language), broken at words that can't be
frequent.  Then, for each length in turn, the tasks collect the phrases whose two shorter parts may be frequent, by bit arrays of the frequent phrases
of the length before, add up equal ones as they go, and deal them by a hash over blocks.  The number of blocks follows the
number of occurrences, so that a block is about ``SLOTS`` of them at any size of the input.

A block adds up counters of hashed phrases; a counter below ``least`` belongs to no frequent phrase, so that none is lost.  What is left are its candidates.  They
get a minimal perfect hash with their 128-bit keys stored by slot; each arrival is looked up, its key compared and its count added by ``bincount`` by slot:
exact counts.  What a cut needs, the counts of a phrase's two parts, is joined to the phrases that no longer one hides.

Two words of one 64-bit hash, one of which could be frequent, are noticed in the word table, and all is hashed again with another seed.

Runs are read once for each length.  Memory is bounded by ``SLOTS``, ``HELD`` and ``BITS`` at any size; where more phrases are frequent than the bit arrays
take, more occurrences are dealt and the work grows, not the error.

Defined cases: null text is empty; null language counts as ``und``; words that no neighbour can join are counted as words; texts of any length
are cut into pieces of about a megabyte between phrases; repeated rows count as often as they are there; an empty table gives an empty
result; other columns and their names play no part.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _MIX, Memo, bound_arrow_batches, hot_join, picked, returned_memory, scramble, stage

LONGEST = 5
#: The smallest and the largest bit array of frequent words or phrases; occurrences of a block.
BUCKETS, BITS, SLOTS = 1 << 22, 1 << 29, 1 << 20
#: Bits of an array for each frequent phrase, those that are one row, arrivals that a block adds up at a time, word hashes of one row of runs.
SPARSE, PIECE, FAN_IN, ROW = 16, 1 << 19, 32, 1024
#: Phrases that a task adds up before it deals them.
HELD = 1 << 20
#: Distinct words that a task counts before it hands them on; word hashes of one numpy step; bytes of a text that are cut at once.
WORDS_HELD, STEP, BYTES = 200_000, 1 << 18, 1 << 20

_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The pieces of a text between punctuation and line ends, A-Z lower-cased."""
    marked, at = text.lower().translate(_BREAKS), 0
    while at < len(marked):
        end = marked.find(b"\n", at + BYTES)
        end = len(marked) if end < 0 else end
        yield from marked[at:end].split(b"\n")
        at = end + 1


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    return zip(batch.column("lang").to_pylist(), (x.as_py() for x in batch.column("text").cast(pa.binary())), strict=True)


def _word_hash(lang: str, seed: int):
    own = xxhash.xxh3_64_intdigest(lang.encode(), seed)
    return lambda word: xxhash.xxh3_64_intdigest(word, own) or 1


def _counting(seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                of = _word_hash(lang, seed)
                words = list(counts)
                for at in range(0, len(words), 8192):
                    part = words[at : at + 8192]
                    hashes = np.array([of(w) for w in part], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(hashes), pa.array([counts[w] for w in part], pa.int64())], names=["lang", "word", "h", "f"])
            held.clear()

        with returned_memory():
            for batch in batches:
                for lang, text in _texts(batch):
                    counts = held.setdefault(lang, Counter())
                    for piece in _pieces(text):
                        counts.update(piece.split())
                    if sum(map(len, held.values())) > WORDS_HELD:
                        yield from told()
            yield from told()

    return work


def _phrased(seed: int, words):
    """Runs of the hashes of words that may be frequent; 0 breaks a run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words.value.tobytes()
        mask = 8 * len(bits) - 1
        memos: OrderedDict[str, Memo] = OrderedDict()

        def memo_of(lang: str) -> Memo:
            if lang not in memos:
                of = _word_hash(lang, seed)
                memos[lang] = Memo(lambda w: h if bits[(at := (h := of(w)) & mask) >> 3] >> (at & 7) & 1 else 0, 8 << 20)
                if len(memos) > 8:
                    memos.popitem(last=False)
            memos.move_to_end(lang)
            return memos[lang]

        held: list[int] = []
        with returned_memory():
            for batch in batches:
                for lang, text in _texts(batch):
                    known = memo_of(lang).__getitem__
                    for piece in _pieces(text):
                        held.extend(map(known, piece.split()))
                        held.append(0)
                        if len(held) > STEP:
                            yield _run_rows(held)
                            held.clear()
            yield _run_rows(held)

    return work


def _run_rows(hashes: list[int]) -> pa.RecordBatch:
    ids = np.array([*hashes, 0], np.uint64)
    known = ids != 0
    joined = known & (np.append(False, known[:-1]) | np.append(known[1:], False))
    ids = ids[joined | (~known & np.append(False, joined[:-1]))]
    breaks = np.flatnonzero(ids == 0)
    last = np.append(np.diff(breaks // ROW) > 0, True)[: len(breaks)]
    offsets = np.append(0, breaks[last] + 1).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int64)))], names=["ids"])


def first_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit keys of single words, as two lanes."""
    return scramble(h * _MIX[0] + np.uint64(1)), scramble(h * _MIX[1] + np.uint64(7))


def _longer(key: np.ndarray, h: np.ndarray, lane: int) -> np.ndarray:
    return scramble(key * _MIX[lane] + h + np.uint64(1))


def keys_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of phrases, one a row of word hashes."""
    a, b = first_keys(words[:, 0])
    for j in range(1, words.shape[1]):
        a, b = _longer(a, words[:, j], 0), _longer(b, words[:, j], 1)
    return a, b


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _phrases(h: np.ndarray, filters: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``length`` words start whose parts may be frequent by the bits of the shorter lengths, and a hash of each."""
    at = np.flatnonzero(h)
    a, b = first_keys(h)
    may = np.zeros(len(h) + 1, bool)
    may[at] = True
    for m in range(2, length + 1):
        at = np.flatnonzero(may[:-1] & may[1:])
        a[at], b[at] = _longer(a[at], h[at + m - 1], 0), _longer(b[at], h[at + m - 1], 1)
        if m < length:
            bits = filters[m - 2]
            mask = np.uint64(8 * len(bits) - 1)
            at = at[_set(bits, a[at] & mask)]
            at = at[_set(bits, b[at] & mask)]
            may[:] = False
            may[at] = True
    return at, a[at]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("ids").flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _bits(places: DataFrame, size: int) -> np.ndarray:
    """A bit array of ``size`` with the bits at ``places(place)`` set, packed; made by pieces.  The driver gets the array."""
    width = min(PIECE, size)

    def made(group: pa.Table) -> pa.Table:
        held = np.zeros(width, bool)
        held[group.column("place").to_numpy() % width] = True
        return pa.table({"piece": group.column("piece")[:1], "data": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    pieces = places.select((F.col("place") / width).cast("int").alias("piece"), "place").distinct()
    out = np.zeros(size // 8, np.uint8)
    for row in stage(pieces.groupBy("piece").applyInArrow(made, "piece int, data binary"), "colloc-bits").toLocalIterator():
        out[row["piece"] * width // 8 : (row["piece"] + 1) * width // 8] = np.frombuffer(row["data"], np.uint8)
    return out


def _size(keys: int, least: int) -> int:
    """Bits for so many keys: a power of two, bounded."""
    return min(max(least, 64, 1 << (SPARSE * keys).bit_length()), max(least, BITS))


def _added_up(words: np.ndarray, key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours in the order of the keys as one row with the sum of their counts."""
    order = np.argsort(key, kind="stable")
    words, key, f = words[order], key[order], f[order]
    fresh = np.append(True, (words[1:] != words[:-1]).any(axis=1))[: len(words)]
    first = np.flatnonzero(fresh)
    return words[first], key[first], np.add.reduceat(f, first) if len(first) else f


_DEALT = "block int, words binary, f binary"


def _dealing(filters, length: int, blocks: int):
    """The phrases of a length that may be frequent, with their counts in the task, by blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = filters.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, room = 0, HELD

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _added_up(*(np.concatenate(c) for c in zip(*held, strict=True)))

        def told(words: np.ndarray, key: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            block = (scramble(key) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            words, f = words[order], f[order].astype(np.uint32)
            ends = np.append(0, np.cumsum(np.bincount(block, minlength=blocks)))
            for some in np.array_split(np.flatnonzero(np.diff(ends)), max(1, len(f) // STEP)):
                cells = [[x[ends[i] : ends[i + 1]].tobytes() for i in some] for x in (words, f)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["block", "words", "f"])

        with returned_memory():
            for h in _steps(batches):
                at, key = _phrases(h, shorter, length)
                held.append((np.stack([h[at + j] for j in range(length)], axis=1), key, np.ones(len(at), np.int64)))
                rows += len(at)
                if rows > room:
                    held[:] = [added()]
                    rows = len(held[0][1])
                    if 2 * rows > room or held[0][2].max() >> 31:  # few are equal: nothing is won by holding them longer
                        yield from told(*held.pop())
                        rows = 0
            if held:
                yield from told(*added())

    return work


class Slots:
    """A minimal perfect hash of 128-bit keys: levels of bit arrays, in each of which the keys that meet no other have their place (Limasset et
    al. 2017).  ``a`` and ``b`` are the keys by slot, which ``find`` compares."""

    def __init__(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray):
        self.levels, self.a, self.b = levels, a, b
        self.ranks = [np.cumsum(bits, dtype=np.int32) - 1 for bits in levels]
        self.starts = np.cumsum([0, *[int(r[-1]) + 1 for r in self.ranks]])

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (scramble(a * _MIX[2] + b + np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def built(cls, a: np.ndarray, b: np.ndarray) -> Slots:
        levels, rest = [], np.arange(len(a))
        while len(rest):
            size = max(64, 2 * len(rest))
            place = cls._place(a[rest], b[rest], len(levels), size)
            bits = np.bincount(place, minlength=size) == 1
            levels.append(bits)
            rest = rest[~bits[place]]
        made = cls(levels, a, b)
        slots = made._slots(a, b)
        made.a, made.b = np.empty_like(a), np.empty_like(b)
        made.a[slots], made.b[slots] = a, b
        return made

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(a), -1), np.arange(len(a))
        for level, bits in enumerate(self.levels):
            place = self._place(a[rest], b[rest], level, len(bits))
            hit = bits[place]
            out[rest[hit]] = self.starts[level] + self.ranks[level][place[hit]]
            rest = rest[~hit]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 for a key that isn't stored."""
        slots = self._slots(a, b)
        same = slots >= 0
        same[same] = (self.a[slots[same]] == a[same]) & (self.b[slots[same]] == b[same])
        return np.where(same, slots, -1)


_PHRASES = "a long, b long, words array<long>, f long"


def _counted(length: int, least: int):
    """The frequent phrases of a block: candidates by counters, then counts by slot."""

    def work(group: pa.Table) -> pa.Table:
        cells = list(zip(group.column("words").to_pylist(), group.column("f").to_pylist(), strict=True))

        def arrivals() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for at in range(0, len(cells), FAN_IN):
                words, f = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*cells[at : at + FAN_IN], strict=True), (np.uint64, np.uint32), strict=True))
                words = words.reshape(-1, length)
                yield words, f, *keys_of(words)

        size = 1 << max(6, (2 * sum(len(f) // 4 for _, f in cells)).bit_length())
        counters = [np.zeros(size, np.int64) for _ in range(2)]
        for _, f, *lanes in arrivals():
            for held, lane in zip(counters, lanes, strict=True):
                np.add.at(held, (lane & np.uint64(size - 1)).astype(np.int64), f)
        may = [held >= least for held in counters]
        able = []
        for words, f, a, b in arrivals():
            some = may[0][(a & np.uint64(size - 1)).astype(np.int64)] & may[1][(b & np.uint64(size - 1)).astype(np.int64)]
            able.append((words[some], f[some], a[some], b[some]))
        words, f, a, b = (np.concatenate(c) for c in zip(*able, strict=True))
        order = np.lexsort((b, a))
        first = order[np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))[: len(a)]]
        slots = Slots.built(a[first], b[first])
        counts = np.bincount(slots.find(a, b), f, len(first)).astype(np.int64)
        own = slots.find(a[first], b[first])
        kept = counts[own] >= least
        return pa.table(_phrase_rows(words[first][kept], counts[own][kept]))

    return work


def _phrase_rows(words: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    a, b = keys_of(words)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * words.shape[1], pa.int32()), pa.array(words.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists, pa.array(f)], names=["a", "b", "words", "f"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _phrase_rows(batch.column("h").to_numpy().view(np.uint64)[:, None], batch.column("f").to_numpy())


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the phrases of one length, and their words as a matrix."""
    lists = batch.column("words")
    sizes, starts, flat = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1], lists.values.to_numpy().view(np.uint64)
    for m in np.unique(sizes):
        where = np.flatnonzero(sizes == m)
        yield where, flat[starts[where][:, None] + np.arange(m)]


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a phrase's first k words and of what follows them: parts number k - 1, and the phrase's length less 2 more."""
    for batch in batches:
        of = [batch.column(c).to_numpy() for c in ("a", "b")]
        for where, words in _by_length(batch):
            cuts = range(1, words.shape[1])
            for no, part in enumerate([words[:, :k] for k in cuts] + [words[:, k:] for k in cuts]):
                keys = [pa.array(x.view(np.int64)) for x in keys_of(part)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[where]) for x in of), pa.array(np.full(len(where), no, np.int32)), *keys], names=["a", "b", "no", "pa", "pb"])


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the two phrases that are one word shorter, with the longer one's count."""
    for batch in batches:
        f = batch.column("f").to_numpy()
        for where, words in _by_length(batch):
            if words.shape[1] > 2:
                for part in (words[:, :-1], words[:, 1:]):
                    a, b = keys_of(part)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(f[where])], names=["a", "b", "longer"])


def _scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cut with the lowest score; Python's integers have no bound."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("f", "n", "heads", "tails")]
        best = [min(((1000 * f * n) // (p * q), k, p, q) for k, (p, q) in enumerate(zip(heads, tails, strict=True))) for f, n, heads, tails in zip(*columns, strict=True)]
        chosen = [pa.array([x[i] for x in best], pa.int64()) for i in (0, 2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), batch.column("f"), chosen[1], chosen[2], batch.column("n"), chosen[0]], names=["lang", "phrase", "a", "l", "r", "n", "score"])


def mine(documents: DataFrame, least: int = 100, longest: int = LONGEST, top: int = 2000, percent: int = 100, buckets: int = BUCKETS, slots: int = SLOTS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (those of the parts of its lowest-scoring cut), n (words of the language), score: each language's
    ``top`` phrases of 2 to ``longest`` words with a count of ``least`` or more.  A phrase inside a longer one that has ``percent`` of its count is left out."""
    spark = documents.sparkSession
    bound_arrow_batches(spark)
    docs = picked(documents, text=text_col, lang=lang_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    share = spark.sparkContext.broadcast
    seed = -1
    while True:
        seed += 1
        counted = docs.mapInArrow(_counting(seed), "lang string, word string, h long, f long")
        words = stage(counted.groupBy("lang", "word").agg(F.any_value("h").alias("h"), F.sum("f").alias("f")), "colloc-words")
        if words.groupBy("h").agg(F.count("*").alias("n"), F.sum("f").alias("f")).filter(f"n > 1 AND f >= {least}").isEmpty():
            break
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = stage(words.filter(F.col("f") >= least), "colloc-frequent")
    told = frequent.agg(F.count("*").alias("n"), F.sum("f").alias("f")).first()
    size = _size(told["n"], buckets)
    heads = _bits(frequent.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("place")), size)
    runs = stage(docs.mapInArrow(_phrased(seed, share(heads)), "ids array<long>"), "colloc-runs")
    singles = frequent.select("h", "f").mapInArrow(_single, _PHRASES)
    filters, found, counts = [], [], [singles.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("f").alias("weight"))]
    for length in range(2, longest + 1):
        # an occurrence begins with a frequent phrase that is one word shorter
        blocks = max(1, -(-(told["f"] or 0) // slots))
        dealt = runs.mapInArrow(_dealing(share(list(filters)), length, blocks), _DEALT).repartition(2 * blocks, "block")
        level = stage(dealt.groupBy("block").applyInArrow(_counted(length, least), _PHRASES), "colloc-level")
        told = level.agg(F.count("*").alias("n"), F.sum("f").alias("f")).first()
        if not told["n"]:
            break
        found.append(level)
        counts.append(level.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("f").alias("weight")))
        size = _size(told["n"], buckets)
        lanes = F.explode(F.array(F.col("a").bitwiseAND(F.lit(size - 1)), F.col("b").bitwiseAND(F.lit(size - 1))))
        filters.append(_bits(level.select(lanes.alias("place")), size))
    if not found:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    whole = reduce(DataFrame.unionByName, found)
    longer = whole.mapInArrow(_parents, "a long, b long, longer long").groupBy("a", "b").agg(F.max("longer").alias("longer"))
    kept = whole.join(longer, ["a", "b"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f"))).drop("longer")
    kept = stage(kept, "colloc-kept")
    # a part is in few more frequent phrases than its count over ``least``, as is a word
    parts = kept.mapInArrow(_sides, "a long, b long, no int, pa long, pb long")
    met = hot_join(parts, reduce(DataFrame.unionByName, counts).withColumn("f", F.col("weight")), ["pa", "pb"], "weight")
    sides = met.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "f"))), lambda x: x["f"]).alias("sides"))
    half = (F.size("sides") / 2).cast("int")
    sides = sides.select("a", "b", F.slice("sides", F.lit(1), half).alias("heads"), F.slice("sides", half + 1, half).alias("tails"))
    spelled = hot_join(kept.select("a", "b", F.posexplode("words").alias("pos", "h")), frequent.select("h", "lang", "word", F.col("f").alias("weight")), ["h"], "weight")
    spelled = spelled.groupBy("a", "b").agg(F.any_value("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ready = kept.join(sides, ["a", "b"]).join(spelled, ["a", "b"]).join(totals, "lang").select("lang", "phrase", "f", "n", "heads", "tails")
    scored = ready.mapInArrow(_scoring, "lang string, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
