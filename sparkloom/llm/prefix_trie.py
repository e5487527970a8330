"""The trie of conversation prefixes, from chained cryptographic digests.

The digest of a prefix is SHA-256 over the digest of the prefix before it and that of its last turn.  Conversations longer than
``BLOCK`` turns are chained in blocks of so many, the blocks' digests are chained in turn, and so on: prefixes start at the same places in
all conversations, so equal ones still get equal digests, and no task holds more than a block.  Every prefix of every conversation
is a row; rows grouped by (depth, digest) are the trie's nodes.

Sums over subtrees go by chains.  A child with as many members as its parent has the same members, and (smallest member, number of members)
names such a chain.  Each chain is exploded to all chains above it: a chain starts where conversations part or end, so that these rows
are at most twice as many as turns, however deep the trie is.  Within a chain a node's share follows from the
characters up to it, which every prefix carries.

Nothing gathers a hot node's rows in one place: turns are numbered by a range sort (at most one conversation crosses each boundary);
counts are added up in the tasks first; keys with a thousandth of all rows or more, of which there are at most a thousand, are joined by
broadcast; the ids that end at a node reach its hash in sorted texts of up to 4096 ids, streamed, not gathered.

Defined cases: turns are ordered by turn, null first, then by role, the text's first 64 characters, and the digest; null role or text is empty; rows
without conv_id take no part; repeated turns are turns; equal conversations share all their nodes; an empty table has no node, not even
the root; other columns and their names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_arrow_batches, hot_join, picked, returned_memory, stage

#: Turns that one task chains at a time.
BLOCK = 1024
#: Chains of one member that meet the chains above it in one group.
CHAINS = 1024
#: Ids whose high bits agree are joined in one text before a hash reads them: 2 ** 12 ids.
ID_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()


def _root() -> Column:
    """The digest of no turns."""
    return F.lit(b"")


def _sha(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), digest of the turn, n_chars: the turns in order."""
    bound_arrow_batches(conversations.sparkSession)
    rows = picked(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv_id IS NOT NULL")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turns = stage(rows.select(F.col("conv_id").cast("long"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"), _sha(whole).alias("digest"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("at")]
    spread = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_chars", F.spark_partition_id().alias("part"))
    placed = stage(spread.mapInArrow(_ordinals, "conv_id long, digest binary, n_chars long, part int, ord long"), "trie-placed")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", before).filter("before > 0").drop("n")
    pos = F.col("ord") + F.coalesce("before", F.lit(0))
    # at most one conversation goes on from one partition to the next: as many rows as partitions
    return placed.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "digest", "n_chars")


def _ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among its conversation's rows in this partition."""
    last, held = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sizes = np.diff(np.append(starts, len(ids)))
        ords = np.arange(len(ids)) - np.repeat(starts, sizes)
        if ids[0] == last:
            ords[: sizes[0]] += held
        last, held = ids[-1], int(ords[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ords, pa.int64())], names=[*batch.schema.names, "ord"])


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt from ``numbered`` turns: c takes the first h turns of conversation c - c % ``group`` (all if there are fewer, none if it
    is absent), then its own after its first h; h is CRC-32 of c's decimal text modulo ``most``.  conv_id, pos, digest, n_chars, and one row with null pos
    for a conversation without turns."""
    turns = stage(turns, "trie-numbered")
    sizes = stage(turns.groupBy("conv_id").agg(F.count("*").alias("n_own")), "trie-sizes")
    c = F.col("conv_id")
    asked = sizes.select("conv_id", "n_own", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    known = asked.join(sizes.select(c.alias("base"), F.col("n_own").alias("n_base")), "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    known = stage(known, "trie-plan")
    # at most most - 1 turns of a conversation go to the ids of its group
    heads = turns.filter((c % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    taken = heads.join(known.select("base", "conv_id", "taken"), "base").filter("pos < taken").select("conv_id", "pos", "digest", "n_chars")
    # a long conversation is as many keys as it has blocks
    block = lambda n: (F.col(n) / BLOCK).cast("long")
    parts = known.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n_own") - 1) / BLOCK).cast("long"))).alias("block"))
    own = turns.withColumn("block", block("pos")).join(parts, ["conv_id", "block"]).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_chars")
    none = known.filter("taken = 0 AND n_own <= h").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    return taken.unionByName(own).unionByName(none)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and characters of a block up to each turn, and the digest up to the turn before; rows come in order."""
    now, chain, held = None, b"", 0
    with returned_memory():
        for batch in batches:
            chains, befores, runs = [], [], []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "block", "digest", "n_chars")]
            for conv, block, digest, n in zip(*columns, strict=True):
                if (conv, block) != now:
                    now, chain, held = (conv, block), None, 0
                befores.append(chain)
                chain, held = hashlib.sha256((chain or b"") + digest).digest(), held + n
                chains.append(chain)
                runs.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chains, pa.binary()), pa.array(befores, pa.binary()), pa.array(runs, pa.int64())], names=[*batch.schema.names, "chain", "before", "run"])


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, pos, digest (of the turn), n_chars, prefix (digest of the turns up to this one), parent (that up to the turn before, empty for
    none), total (characters of the prefix)."""
    rows = turns.select("conv_id", "pos", (F.col("pos") / block).cast("long").alias("block"), "digest", "n_chars")
    ordered = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    within = stage(ordered.mapInArrow(_chain, "conv_id long, pos long, block long, digest binary, n_chars long, chain binary, before binary, run long"), "trie-chains")
    full = within.filter(F.col("pos") % block == block - 1).select("conv_id", F.col("block").alias("pos"), F.col("chain").alias("digest"), F.col("run").alias("n_chars"))
    start, end, carried = _root(), _root(), F.lit(0)
    if not full.isEmpty():
        up = prefixes(full, block)
        starts = up.select("conv_id", (F.col("pos") + 1).alias("block"), F.col("prefix").alias("start"), _sha(F.concat("parent", "digest")).alias("end"), F.col("total").alias("carried"))
        within = within.join(starts, ["conv_id", "block"], "left")
        start, end, carried = F.coalesce("start", _root()), F.coalesce("end", _root()), F.coalesce("carried", F.lit(0))
    parent = F.when(F.col("before").isNull(), end).otherwise(_sha(F.concat(start, "before")))
    return within.select("conv_id", "pos", "digest", "n_chars", _sha(F.concat(start, "chain")).alias("prefix"), parent.alias("parent"), (F.col("run") + carried).alias("total"))


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of each node, which come in order, joined by commas."""
    node, state = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for prefix, text in zip(batch.column("prefix").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if prefix != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = prefix, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield _ends_batch(out)
    if node is not None:
        yield _ends_batch([(node, state.hexdigest())])


def _ends_batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["prefix", "ends_sha256"])


def nodes(turns: DataFrame) -> DataFrame:
    """One row a node of the trie over ``turns`` (conv_id, pos, digest, n_chars; null pos: a conversation without turns): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stage(turns, "trie-rebuilt")
    paths = stage(prefixes(turns.filter("pos IS NOT NULL")).drop("digest").withColumn("depth", F.col("pos") + 1), "trie-prefixes")
    last = turns.groupBy("conv_id").agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("depth"))
    last = stage(last, "trie-lengths")
    first = last.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = first.select(zero.alias("depth"), _root().alias("prefix"), "conv_id", "n_convs", zero.alias("n_chars"), zero.alias("total"), F.lit(None).cast("binary").alias("parent"))
    counted = paths.groupBy("depth", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.any_value(n).alias(n) for n in ("n_chars", "total", "parent")])
    bare = stage(root.unionByName(counted), "trie-nodes")
    families = bare.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    alone = stage(bare.join(families, "prefix", "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-families")
    # each node with its parent
    above = alone.filter("n_children > 0").select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), "n_children")
    child = alone.filter("parent IS NOT NULL")
    top = alone.filter("parent IS NULL").withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_n": F.lit(None).cast("long")})
    linked = stage(hot_join(child, above.withColumnRenamed("n_children", "weight"), ["parent"], "weight").unionByName(top), "trie-linked")
    # chains: nodes with the same members
    saved = F.sum((F.col("n_convs") - 1) * F.col("n_chars"))
    chains = linked.groupBy("conv_id", "n_convs").agg(F.min("depth").alias("top"), F.count("*").alias("weight"), F.min(F.col("total") - F.col("n_chars")).alias("ahead"), saved.alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    chains = stage(chains, "trie-chain-tops")
    starts = linked.filter(F.coalesce(F.col("parent_n") != F.col("n_convs"), F.lit(False))).select("prefix", F.col("conv_id").alias("head"), F.col("n_convs").alias("size"), F.col("depth").alias("from"), F.col("n_convs").alias("weight"))
    on_path = hot_join(paths.select("prefix", "conv_id"), starts, ["prefix"], "weight").drop("prefix")
    # each chain goes to all chains above it and to itself
    heads = stage(chains.groupBy("conv_id").agg(F.ceil(F.count("*") / CHAINS).cast("int").alias("cuts")), "trie-heads")
    low = chains.join(heads, "conv_id").select("conv_id", F.pmod(F.xxhash64("n_convs"), F.col("cuts")).cast("int").alias("cut"), "top", "saved", "leaves")
    high = on_path.join(heads, "conv_id").select("conv_id", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "head", "size", "from")
    sums = [F.sum("saved").alias("all_saved"), F.sum("leaves").alias("all_leaves")]
    summed = low.join(high, ["conv_id", "cut"]).filter(F.col("from") <= F.col("top")).groupBy(F.col("head").alias("conv_id"), F.col("size").alias("n_convs")).agg(*sums)
    # the chain of the root has everything below it
    whole = first.crossJoin(F.broadcast(chains.agg(*sums)))
    summed = summed.unionByName(whole).join(chains.filter("n_convs > 1").select("conv_id", "n_convs", "ahead", "weight"), ["conv_id", "n_convs"])
    summed = stage(summed, "trie-sums")
    out = ["prefix", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    met = hot_join(linked.filter("n_convs > 1"), summed, ["conv_id", "n_convs"], "weight")
    spared = F.col("all_saved") - (F.col("n_convs") - 1) * (F.col("total") - F.col("n_chars") - F.col("ahead"))
    many = met.select(*out, F.col("all_leaves").alias("n_leaves"), spared.alias("saved_tokens"))
    one = linked.filter("n_convs = 1").select(*out, F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    # the ids that end at each node
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ended = paths.select("conv_id", "depth", "prefix").join(last, ["conv_id", "depth"]).select("prefix", "conv_id")
    ended = ended.unionByName(last.filter("depth = 0").select(_root().alias("prefix"), "conv_id"))
    texts = ended.groupBy("prefix", F.shiftright("conv_id", ID_BITS).alias("high")).agg(ids.alias("ids"))
    digests = texts.repartition("prefix").sortWithinPartitions("prefix", "high").select("prefix", "ids").mapInArrow(_ends_digest, "prefix binary, ends_sha256 string")
    joined = many.unionByName(one).join(digests, "prefix", "left")
    return joined.select(*out[1:], "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def trie(conversations: DataFrame, shared_heads: bool = False) -> DataFrame:
    """The nodes of the conversations' prefixes, as they are or rebuilt by ``with_shared_heads``."""
    turns = numbered(conversations)
    return nodes(with_shared_heads(turns) if shared_heads else turns)
