"""MinHash near-dedup as an inverted join over signature coordinates.

A document is its set of distinct ``words``-word shingles.  Equal sets form one class, so exact copies never meet as pairs.
Every class has a signature of ``coords`` minima, and is posted under its coordinate-value pairs:

* prefix: a class orders its pairs from rare to frequent and is posted under the first ``coords - matches + 1`` alone; two
  classes that agree in ``matches`` coordinates share one of these.  Pairs that no other class has come first and are not
  written at all, so that a class without company posts nothing, and frequent passages stay in the tail;
* skip: in a posting list only sizes meet that could reach the similarity.

Lists are merged in two rounds.  In the first, each member of a list meets the list's smallest alone; collisions are counted on
the two signatures, pairs with ``matches`` or more are retained and confirmed on the full shingle sets, and components are
joined.  So a family of n near copies costs about n comparisons and becomes one component.  In the second, lists that still hold
several components are merged in blocks of ``BLOCK`` members: collisions and common shingles are counted for all pairs of a block
at once, in arrays, and what leaves the task is a tree of the links between components.  No link between components goes untested,
no group, however large, gathers in a task, and no more links are told than members.

A pair at similarity 0.8 agrees in 40 of 64 coordinates with probability 0.9996, at 0.85 with 0.999998: that is the one way a link
may be missed.  Shingles are compared as 64-bit hashes.

Defined cases: documents without words (null, empty or blank texts) have size 0 and stand alone; one or a few words form one
shingle; ties need no order, as components have none; rows that repeat an id or a text share its class; a class whose ids are
all null has a null component; an empty table gives an empty result; further columns pass through ``survivors``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ascii_lower_words, batches, bound_arrow_batches, broadcast_if_small, files_freed, picked, returned_memory, scramble, shingle_set, stage, text_of, unwrapped, wrapped
from .graph import components

COORDS = 64
MATCHES = 40
#: Members of a list that a task compares with as many others at a time, and shingles that they hold together, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Cells of the matrix in which a block's common shingles are counted, a slice of the shingles at a time.
CELLS = 1 << 22
#: Sets that a task remembers to have signed; past it a copy is signed again.
SIGNED_SETS = 1 << 15

_SIGNED = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int64()))])
_SETS = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])


class Signer:
    """Signatures of shingle sets: coordinate i keeps the shingle that is smallest under the i-th hash."""

    def __init__(self, coords: int = COORDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.times = rng.integers(0, 1 << 31, (coords, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.flips = rng.integers(0, 1 << 32, (coords, 1), dtype=np.uint32)
        self.salts = scramble(rng.integers(0, 1 << 63, coords, dtype=np.uint64))

    def sign(self, members: np.ndarray, block: int = 2048) -> np.ndarray:
        high, best, place = (members >> np.uint64(32)).astype(np.uint32), None, None
        for at in range(0, len(members), block):
            hashed = (high[at : at + block] ^ self.flips) * self.times
            where = hashed.argmin(axis=1)
            value = hashed[np.arange(len(where)), where]
            if best is None:
                best, place = value, where + at
            else:
                lower = value < best
                best, place = np.where(lower, value, best), np.where(lower, where + at, place)
        return scramble(members[place] ^ self.salts).view(np.int64)


def signed(docs: DataFrame, words: int, coords: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey (a hash of the text), n, digest of the set, and the signature at a set's first row in a task."""
    bound_arrow_batches(docs.sparkSession)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            hashes, signer, met = WordHashes(), Signer(coords), set()
            for part in parts:
                for doc_id, tkey, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    members = shingle_set(hashes.of(ascii_lower_words(text)), words)
                    if not len(members):
                        yield doc_id, tkey, 0, None, None
                        continue
                    digest = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
                    fresh = digest not in met
                    if fresh and len(met) >= SIGNED_SETS:
                        met.clear()
                    met.add(digest)
                    yield doc_id, tkey, len(members), digest, signer.sign(members) if fresh else None

        with returned_memory():
            yield from batches(_SIGNED, rows())

    raw = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("tkey"), text_of().alias("text"))
    return raw.mapInArrow(work, "doc_id long, tkey long, n long, digest binary, sig array<long>")


def postings(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """(key, digest, n): the prefix postings of every class that could agree with another in ``matches`` coordinates."""
    posts = classes.select("digest", "n", F.explode("sig").alias("key"))
    # written, so that the join shuffles both sides for itself and Spark can split a frequent value's partition; so are the tables below
    often = stage(posts.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    shared = posts.join(often, "key").groupBy("digest").agg(F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
    room = F.size("keys") - F.lit(matches - 1)  # prefix less the pairs that are this class's own
    return shared.filter(room > 0).select("digest", "n", F.explode(F.slice("keys", F.lit(1), room)).alias("k")).select("k.key", "digest", "n")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(digest, n, members) for the classes in ``wanted(digest, doc_id, tkey)``, from their texts."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            hashes = WordHashes()
            for part in parts:
                for digest, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    members = shingle_set(hashes.of(ascii_lower_words(text)), words)
                    yield digest, len(members), members.view(np.int64)

        with returned_memory():
            yield from batches(_SETS, rows(), 256)

    raw = picked(docs, d_id=id_col, text=text_col).select(F.col("d_id").cast("long"), F.xxhash64(text_of()).alias("d_key"), text_of().alias("text"))
    met = raw.join(broadcast_if_small(wanted), F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("tkey")))
    return met.select("digest", "text").mapInArrow(work, "digest binary, n long, members array<long>").dropDuplicates(["digest"])


def _confirmed(pairs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) that collide in ``matches`` coordinates and whose sets have the similarity."""
    one = lambda side: sets.select(F.col("digest").alias(side), F.col("sig").alias(f"sig_{side}"))
    hits = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = pairs.join(one("a"), "a").join(one("b"), "b").filter(hits >= matches).select("a", "b")
    full = lambda side: sets.select(F.col("digest").alias(side), F.col("members").alias(f"of_{side}"))
    both = near.join(full("a"), "a").join(full("b"), "b").withColumn("same", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("same")
    return both.filter(F.col("same") * 100 >= union * percent).select("a", "b")


def links(docs: DataFrame, base: DataFrame, words: int, percent: int, coords: int, matches: int, id_col: str, text_col: str) -> DataFrame | None:
    """(node, label) for the classes that are linked with another; None without any link."""
    classes = base.filter("sig IS NOT NULL").groupBy("digest").agg(F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    posted = stage(postings(classes, coords, matches), "postings")
    if posted.isEmpty():
        return None
    named = posted.select("digest").distinct()
    # 16 bits of each value count collisions: none that agree are missed, and the sets decide
    brief = base.select("digest", "doc_id", "tkey", F.transform("sig", lambda x: F.shiftright(x, 48).cast("short")).alias("sig"))
    wanted = brief.join(named, "digest").groupBy("digest").agg(F.min(F.struct("doc_id", "tkey")).alias("at"), F.max("sig").alias("sig"))
    wanted = stage(wanted.select("digest", "at.doc_id", "at.tkey", "sig"), "wanted")
    sets = stage(shingle_sets(docs, wanted.drop("sig"), words, id_col, text_col).join(wanted.select("digest", "sig"), "digest"), "sets")

    files_freed(docs.sparkSession)

    # first round: every member with its list's smallest
    lowest = stage(posted.groupBy("key").agg(F.min("digest").alias("p")), "pivots")
    pairs = posted.join(lowest, "key").filter("digest <> p").select(F.col("digest").alias("a"), F.col("p").alias("b")).distinct()
    edges = _confirmed(pairs, sets, matches, percent).checkpoint()
    # components() gives a star for each component: its edges say what the links said
    labels = components(edges)
    # second round: what lists still hold of different components
    open_lists = posted.join(labels, F.col("digest") == F.col("node"), "left").select("key", "digest", "n", F.coalesce("label", "digest").alias("label"))
    lists = open_lists.join(stage(dealt_lists(open_lists), "lists"), "key")
    more = _confirmed(merged_lists(lists, sets, matches, percent), sets, matches, percent).checkpoint()
    files_freed(docs.sparkSession)
    if more.isEmpty():
        return labels
    stars = labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return components(stars.unionByName(more))


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _linked(sets: list[np.ndarray], sizes: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Whether members ``low`` and ``high`` of a block reach the similarity: common shingles by matrix products, each over a slice
    of the shingles, so that memory is that of the sets and of ``CELLS`` numbers however long the texts are."""
    members = np.unique(np.concatenate([low, high]))
    flat = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    again = np.concatenate([[False], flat[1:] == flat[:-1]])
    shared = again | np.concatenate([again[1:], [False]])  # a shingle that one member has is common to no pair
    name, owner = np.cumsum(~again[shared]) - 1, owner[shared]
    rows, columns = np.searchsorted(members, low), np.searchsorted(members, high)
    common = np.zeros((len(low), len(high)), np.int64)
    width = max(1, CELLS // len(members))
    for start in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        a, b = np.searchsorted(name, [start, start + width])
        has = np.zeros((len(members), int(name[b - 1]) + 1 - start), np.float32)
        has[owner[a:b], name[a:b] - start] = 1
        common += (has[rows] @ has[columns].T).astype(np.int64)  # whole numbers below 2**24: none is rounded
    return common * 100 >= (sizes[low][:, None] + sizes[high][None, :] - common) * percent


def _tree(rows: list[tuple], matches: int, percent: int) -> Iterator[tuple]:
    """Links that join the labels of one block: a pair for each two labels that meet, none that says nothing new."""
    mine, sizes = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
    label = np.unique([r[6] for r in rows], return_inverse=True)[1]
    low, high = np.flatnonzero(mine == rows[0][1]), np.flatnonzero(mine == rows[0][2])
    if not len(low) or not len(high):
        return
    sig = np.stack([r[7] for r in rows])
    ok = label[low][:, None] != label[high][None, :]
    ok &= np.minimum(sizes[low][:, None], sizes[high][None, :]) * 100 >= np.maximum(sizes[low][:, None], sizes[high][None, :]) * percent
    hits = np.zeros(ok.shape, np.int16)
    for c in range(sig.shape[1]):
        hits += sig[low, c][:, None] == sig[high, c][None, :]
    ok &= hits >= matches
    if not ok.any():
        return
    left, right = ok.any(axis=1), ok.any(axis=0)
    low, high, ok = low[left], high[right], ok[left][:, right]
    ok &= _linked([r[8] for r in rows], sizes, low, high, percent)
    owner = list(range(label.max() + 1))

    def root(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    for x, y in zip(*np.nonzero(ok), strict=True):
        p, q = root(label[low[x]]), root(label[high[y]])
        if p != q:
            owner[p] = q
            a, b = rows[low[x]][4], rows[high[y]][4]
            yield max(a, b), min(a, b)


def dealt_lists(open_lists: DataFrame) -> DataFrame:
    """(key, most, cuts, apart) for the lists with several labels: the label with most members, the number of blocks for the other
    members, and of those for its own, which is 0 where the whole list is one block."""
    of_label = open_lists.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("held"))
    top = F.max(F.struct("m", "label", "held")).alias("top")
    several = of_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("m").alias("m"), F.sum("held").alias("held"), top).filter("labels > 1")
    blocks = lambda m, held: F.greatest(F.ceil(m / BLOCK), F.least(F.ceil(held / BLOCK_SHINGLES), m)).cast("int")
    whole = blocks(F.col("m"), F.col("held")) == 1
    rest = blocks(F.col("m") - F.col("top.m"), F.col("held") - F.col("top.held"))
    apart = blocks(F.col("top.m"), F.col("top.held"))
    return several.select("key", F.col("top.label").alias("most"), F.when(whole, 1).otherwise(rest).alias("cuts"), F.when(whole, 0).otherwise(apart).alias("apart"))


def merged_lists(lists: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """(a, b): links between the labels of ``lists(key, digest, n, label, cuts, most, apart)`` that collide in ``matches`` coordinates.

    A list is cut into blocks, and each pair of blocks is one piece of work; without ``most`` and ``apart`` any two blocks meet.  Members of the label with most of a list have nothing
    to tell each other: their blocks come after the others' and meet those alone, so that a family with a few strangers in its list
    is dealt once for each block of strangers, and not once for each block of its own."""
    if "apart" not in lists.columns:
        lists = lists.select("*", F.lit(None).cast("binary").alias("most"), F.lit(0).alias("apart"))
    large = (F.col("apart") > 0) & (F.col("label") == F.col("most"))
    in_block = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    own = F.when(large, F.col("cuts") + in_block(F.col("apart"))).otherwise(in_block(F.col("cuts")))
    last = F.when(large, F.col("cuts")).otherwise(F.col("cuts") + F.col("apart")) - 1
    dealt = lists.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "digest", "n", "label")
    with_sets = dealt.join(sets.select("digest", "sig", "members"), "digest")
    order = ["key", "i", "j"]
    sorted_rows = with_sets.repartition(*order).sortWithinPartitions(*order).select(*order, "own", "digest", "n", "label", "sig", "members")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            held: list[tuple] = []
            for part in parts:
                *plain, sig, members = part.columns
                for row in zip(*(c.to_pylist() for c in plain), *((x.values.to_numpy() for x in c) for c in (sig, members)), strict=True):
                    if held and row[:3] != held[0][:3]:
                        yield from _tree(held, matches, percent)
                        held = []
                    held.append(row)
            if held:
                yield from _tree(held, matches, percent)

        with returned_memory():
            yield from batches(_PAIR, pairs(), 8192)

    return sorted_rows.mapInArrow(work, "a binary, b binary").distinct()


def mark(docs: DataFrame, words: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tkey, n_shingles, component_id (smallest id reachable), kept."""
    base = stage(signed(docs, words, coords, id_col, text_col), "signed")
    with_words = base.filter("digest IS NOT NULL")
    owner = with_words.groupBy("digest").agg(F.min("doc_id").alias("own"))
    labels = links(docs, base, words, percent, coords, matches, id_col, text_col)
    if labels is not None:
        linked = owner.join(labels, F.col("digest") == F.col("node")).select("digest", "label", "own")
        lowest = linked.groupBy("label").agg(F.min("own").alias("lowest"))
        named = linked.join(lowest, "label").select("digest", "lowest")
        owner = owner.join(named, "digest", "left").select("digest", F.coalesce("lowest", "own").alias("own"))
    found = with_words.join(stage(owner, "owners"), "digest").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("own").alias("component_id"))
    alone = base.filter("digest IS NULL").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, words: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each component the rows with the smallest id."""
    out = mark(docs, words, percent, coords, matches, id_col, text_col).filter("NOT kept").select("doc_id", "tkey").distinct()
    keyed = wrapped(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64(text_of()))
    gone = F.col("id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("tkey"))
    return unwrapped(keyed.join(broadcast_if_small(stage(out, "dropped")), gone, "left_anti"), docs.columns)
