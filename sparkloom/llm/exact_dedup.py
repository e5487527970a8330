"""Exact dedup with Patricia-trie owners.

Full byte strings go into compressed radix tries.  A terminal node keeps the owner's identifier and the number of rows
that ended there, so two texts share an owner only when every byte agrees.  Work runs in two tries:

1. each scan task combines its own rows first, so a text that fills a third of the table leaves a task once;
2. what is left is dealt by (byte length, content hash) and merged in one trie per partition, which spills whole subtrees
   to unnamed scratch files once its labels pass ``memory`` bytes.

The owner table has one row per text.  Rows find their owner by the text's SHA-256; Spark splits a hot digest's
partition in that sort-merge join by itself (adaptive skew join).

Defined cases: null text counts as empty, and empty texts are equal to each other; a null id never owns a text that
another row has with an id; rows that repeat both id and text are all marked kept, and ``survivors`` lets one of them
through; an empty table gives an empty result; further columns pass through ``survivors`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bound_arrow_batches, picked, returned_memory, text_of, unwrapped, wrapped

#: Bytes of labels that one trie holds before it lets a subtree go.
MEMORY = 48 << 20


def _shared(label: bytes, text: bytes, start: int) -> int:
    """Length of the common prefix of ``label`` and ``text[start:]``, by halving."""
    top = min(len(label), len(text) - start)
    if text[start : start + top] == label[:top]:
        return top
    low, high = 0, top
    while high - low > 1:
        middle = (low + high) // 2
        if text[start + low : start + middle] == label[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    __slots__ = ("label", "kids", "owner", "rows", "files")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.rows, self.files = label, None, None, 0, None


class PatriciaOwners:
    """Compressed radix trie from byte strings to (owner, rows).  ``smallest`` says which identifier owns a text."""

    def __init__(self, smallest: bool = True, memory: int = MEMORY):
        self.smallest, self.memory, self.held, self.root = smallest, memory, 0, _Node(b"")

    def _own(self, node: _Node, owner: int | None, rows: int) -> None:
        node.rows += rows
        if owner is not None and (node.owner is None or (owner < node.owner) == self.smallest):
            node.owner = owner

    def insert(self, text: bytes, owner: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.files is not None:
                pickle.dump((text, owner, rows), node.files[-1], protocol=5)
                return
            if at == len(text):
                return self._own(node, owner, rows)
            kid = node.kids.get(text[at]) if node.kids else None
            if kid is None:
                leaf = _Node(text[at:])
                self.held += len(leaf.label) + 200
                if node.kids is None:
                    node.kids = {}
                node.kids[text[at]] = leaf
                return self._own(leaf, owner, rows)
            same = _shared(kid.label, text, at)
            if same < len(kid.label):
                fork = _Node(kid.label[:same])
                kid.label = kid.label[same:]
                fork.kids = {kid.label[0]: kid}
                node.kids[text[at]] = fork
                self.held += 200
                kid = fork
            node, at = kid, at + same

    def full(self) -> bool:
        return self.held > self.memory

    def heaviest(self) -> tuple[bytes, _Node] | None:
        """The subtree with most bytes below the first fork, and the prefix above it."""
        prefix, node = b"", self.root
        while True:
            open_kids = [k for k in (node.kids or {}).values() if k.files is None]
            if not open_kids:
                return None
            if len(node.kids) > 1 or node.rows:
                best = max(open_kids, key=self._weight)
                return prefix + node.label, best
            prefix, node = prefix + node.label, open_kids[0]

    def _weight(self, top: _Node) -> int:
        total, todo = 0, [top]
        while todo:
            node = todo.pop()
            total += len(node.label) + 200
            todo.extend((node.kids or {}).values())
        return total

    @staticmethod
    def walk(top: _Node, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        """(text, owner, rows) below ``top``; spilled subtrees are left out."""
        todo = [(top, prefix)]
        while todo:
            node, above = todo.pop()
            if node.files is not None:
                continue
            text = above + node.label
            if node.rows:
                yield text, node.owner, node.rows
            todo.extend((kid, text) for kid in (node.kids or {}).values())

    def release(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Take the heaviest subtree out of memory and hand its entries over."""
        found = self.heaviest()
        if found is None:
            return
        prefix, top = found
        yield from self.walk(top, prefix)
        self.held -= self._weight(top)
        top.label, top.kids, top.rows, top.owner = top.label[:1], None, 0, None

    @staticmethod
    def scratches(top: _Node) -> list:
        """The scratch files of all spilled subtrees in ``top``."""
        files, todo = [], [top]
        while todo:
            node = todo.pop()
            files.extend(node.files or ())
            todo.extend((node.kids or {}).values())
        return files

    def spill(self) -> bool:
        """Move the heaviest subtree to an unnamed scratch file; later strings below it go straight there.

        Subtrees of it that were spilled before, when the first fork was further down, keep their files: the node takes
        these over."""
        found = self.heaviest()
        if found is None:
            return False
        prefix, top = found
        scratch = tempfile.TemporaryFile(dir=os.environ.get("TMPDIR"))
        for entry in self.walk(top, prefix):
            pickle.dump(entry, scratch, protocol=5)
        self.held -= self._weight(top)
        top.files = [*self.scratches(top), scratch]
        top.label, top.kids, top.rows, top.owner = top.label[:1], None, 0, None
        return True

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every entry once: those in memory, then each spilled subtree through a trie of its own."""
        spilled, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.files is not None:
                spilled.append(node.files)
            todo.extend((node.kids or {}).values())
        yield from self.walk(self.root)
        self.root, self.held = _Node(b""), 0
        for files in spilled:
            below = PatriciaOwners(self.smallest, self.memory)
            for scratch in reversed(files):  # the last one has the highest forks
                scratch.seek(0)
                with scratch:
                    while True:
                        try:
                            entry = pickle.load(scratch)
                        except EOFError:
                            break
                        below.insert(*entry)
                        if below.full() and not below.spill():
                            below.memory *= 2
            yield from below.drain()


_PART = pa.schema([("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
_OWNER = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memory: int = MEMORY) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (its owner), group_size."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    smallest = keep == "smallest"
    bound_arrow_batches(docs.sparkSession)

    def combine(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie = PatriciaOwners(smallest, memory // 2)
            for part in parts:
                for owner, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    trie.insert(text, owner)
                    while trie.full():
                        before = trie.held
                        yield from trie.release()
                        if trie.held >= before:
                            yield from trie.drain()
            yield from trie.drain()

        with returned_memory():
            yield from batches(_PART, rows())

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie, due = PatriciaOwners(smallest, memory), 0
            for part in parts:
                for text, owner, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    trie.insert(text, owner, n)
                    due += n
                    while trie.full() and trie.spill():
                        pass
            for text, owner, n in trie.drain():
                due -= n
                yield hashlib.sha256(text).hexdigest(), owner, n
            if due:
                raise RuntimeError(f"{due} rows without an owner")

        with returned_memory():
            yield from batches(_OWNER, rows())

    raw = picked(docs, owner=id_col, text=text_col).select(F.col("owner").cast("long"), text_of().cast("binary").alias("text"))
    parts = raw.mapInArrow(combine, "text binary, owner long, n long")
    dealt = parts.repartition(F.length("text"), F.xxhash64("text"))
    return dealt.mapInArrow(merge, "text_sha256 string, keep_id long, group_size long")


def _owned(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the owner of their text; a text without one is an error."""
    met = rows.join(table.withColumn("known", F.lit(True)), "text_sha256", "left")
    sure = F.when(F.col("known"), F.col("group_size")).otherwise(F.raise_error(F.concat(F.lit("no owner for text "), "text_sha256")).cast("long"))
    return met.withColumn("group_size", sure).drop("known")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memory: int = MEMORY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    table = owners(docs, id_col, text_col, keep, memory)
    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("text_sha256"))
    return _owned(rows, table).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memory: int = MEMORY) -> DataFrame:
    """The input's rows that own their text, one for each text, with the input's columns."""
    table = owners(docs, id_col, text_col, keep, memory)
    keyed = wrapped(docs, id=id_col, text=text_col).withColumn("text_sha256", F.sha2(text_of().cast("binary"), 256))
    met = _owned(keyed, table).filter(F.col("id").cast("long").eqNullSafe(F.col("keep_id")))
    once = met.filter("group_size = 1").unionByName(met.filter("group_size > 1").dropDuplicates(["text_sha256"]))
    return unwrapped(once, docs.columns)
