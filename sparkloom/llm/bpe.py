"""BPE encoding and decoding through a minimal acyclic transducer.

The lexicon holds the frequent pieces of the corpus.  It is a minimal acyclic automaton (equal suffixes share states,
built from sorted words) whose transitions carry additive outputs: the sum along a word's path is the word's ordinal, and
a table gives the ids at that ordinal.  Its flat arrays are written to one file that every worker memory-maps.  A piece
that is not in the lexicon is merged exactly, by the ranks of the public vocabulary.

Frequencies cover all documents: every task keeps a Misra-Gries summary of its pieces (bounded, mergeable), and the sums of
these summaries pick at most ``words`` pieces.  A choice of pieces changes speed alone, never ids.

Defined cases: null and empty texts encode to no ids and decode to the empty text; special tokens in a text become their
id, as the library does; a text of any length is encoded whole, in runs of pieces; rows that repeat are encoded each; an
empty table gives an empty result; other columns and their names play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import os
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, bound_arrow_batches, picked, returned_memory, unwrapped, wrapped

#: Pieces in the lexicon, and pieces that one task's frequency summary holds.
LEXICON_WORDS = 32_768
SUMMARY_WORDS = 65_536
#: Characters that a word of the summaries, and so a piece of the lexicon, has at most; longer ones are merged.
LONGEST = 64

#: The split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Past every rank.
NEVER = 1 << 60

#: Below this code point the pattern's classes agree in every Unicode version at hand; other texts are split by the library.
AGREED = 0x0530


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file: merges of byte strings by rank, ids, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: i for i, c in enumerate(byte_letters())}
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        pairs = [(raw(a), raw(b)) for a, b in merges]
        self.ranks = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.joined = [self.ids[a + b] for a, b in pairs]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {str(i): t for t, i in self.ids.items()} | {str(i): t.encode() for t, i in self.special.items()}
        self.pattern = regex.compile(SPLIT)
        self.beyond = regex.compile(f"[^\\x00-\\u{AGREED - 1:04x}]")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._splitter = None

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, text) in turn."""
        if self.at_special is None:
            if text:
                yield False, text
            return
        for i, part in enumerate(self.at_special.split(text)):
            if part:
                yield i % 2 == 1, part

    def pieces(self, text: str) -> Iterable[str]:
        if self.beyond.search(text) is None:
            return self.pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in self.pattern.finditer(text))
        if self._splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        return (text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece: the lowest rank merges first, leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, joined = self.ranks.get, self.joined
        ranks = list(map(get, zip(ids, ids[1:]), itertools.repeat(NEVER)))
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            ids[at] = joined[best]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), NEVER)
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), NEVER)
        return ids

    def _merge_long(self, parts: list[int | None]) -> list[int]:
        """The same merges with a heap and links, for pieces of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(itertools.pairwise(parts)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.joined[rank], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p is not None]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _State:
    __slots__ = ("edges", "final", "below")

    def __init__(self):
        self.edges, self.final, self.below = {}, False, 0


#: A word whose checksum isn't marked is not in the lexicon: most unseen words need no walk.
_FILTER_BITS = 19
_FILTER = (1 << _FILTER_BITS) - 1


def build_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton and its id table as one blob: a header of nine lengths, then flat arrays."""
    register: dict[tuple, _State] = {}
    root = _State()
    path: list[tuple[_State, int]] = []

    def freeze(down_to: int) -> None:
        while len(path) > down_to:
            parent, letter = path.pop()
            child = parent.edges[letter]
            mark = (child.final, tuple((c, id(s)) for c, s in child.edges.items()))
            parent.edges[letter] = register.setdefault(mark, child)

    words, last = sorted(entries), b""
    for word in words:
        same = len(os.path.commonprefix([word, last]))
        freeze(same)
        state = path[-1][0].edges[path[-1][1]] if path else root
        for letter in word[same:]:
            state.edges[letter] = _State()
            path.append((state, letter))
            state = state.edges[letter]
        state.final, last = True, word
    freeze(0)

    order: dict[int, int] = {}
    states: list[_State] = []
    todo: list[tuple[_State, bool]] = [(root, False)]
    while todo:  # children first, so that word counts below a state are known
        state, ready = todo.pop()
        if id(state) in order:
            continue
        if ready:
            order[id(state)] = len(states)
            states.append(state)
            state.below = state.final + sum(s.below for s in state.edges.values())
        else:
            todo.append((state, True))
            todo.extend((s, False) for s in state.edges.values() if id(s) not in order)
    first, letters, targets, outputs, final = [0], [], [], [], []
    for state in states:
        passed = int(state.final)
        for letter in sorted(state.edges):
            child = state.edges[letter]
            letters.append(letter)
            targets.append(order[id(child)])
            outputs.append(passed)
            passed += child.below
        first.append(len(letters))
        final.append(state.final)
    flat, starts = [], [0]
    for word in words:
        flat.extend(entries[word])
        starts.append(len(flat))
    arrays = [np.array(first, "<u4"), np.array(targets, "<u4"), np.array(outputs, "<u4"), np.array(starts, "<u4"), np.array(flat, "<u4"), np.array(letters, "u1"), np.array(final, "u1")]
    marks = np.zeros(1 << _FILTER_BITS, "u1")
    marks[[zlib.crc32(w) & _FILTER for w in words]] = 1
    arrays.append(marks)
    head = np.array([order[id(root)], *map(len, arrays)], "<u4")
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


_ONE = [bytes([b]) for b in range(256)]


class Lexicon:
    """Reads a blob of ``build_lexicon`` through a memory map."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile(dir=os.environ.get("TMPDIR")) as f:  # unnamed: nothing stays behind
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, "<u4", 9)
        self.root, at, arrays, starts = int(head[0]), 36, [], []
        for n, kind in zip(head[1:].tolist(), ("<u4",) * 5 + ("u1",) * 3, strict=True):
            arrays.append(memoryview(np.frombuffer(self.map, kind, n, at)))
            starts.append(at)
            at += n * np.dtype(kind).itemsize
        self.first, self.targets, self.outputs, self.starts, self.flat, _, self.final, self.marks = arrays
        self.letters = starts[5]

    def ids(self, word: bytes) -> list[int] | None:
        if not self.marks[zlib.crc32(word) & _FILTER]:
            return None
        state, ordinal = self.root, 0
        for letter in word:
            edge = self.map.find(_ONE[letter], self.letters + self.first[state], self.letters + self.first[state + 1]) - self.letters
            if edge < 0:
                return None
            ordinal += self.outputs[edge]
            state = self.targets[edge]
        return list(self.flat[self.starts[ordinal] : self.starts[ordinal + 1]]) if self.final[state] else None


def frequent_pieces(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS, summary: int = SUMMARY_WORDS) -> list[str]:
    """At most ``words`` pieces with the largest counts, out of mergeable summaries of every document.

    Tasks count words between white space, which is cheap, and split those that their summary keeps."""
    bound_arrow_batches(docs.sparkSession)
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def shrink(counts: Counter) -> Counter:
        if len(counts) <= summary:
            return counts
        kept = counts.most_common(summary + 1)
        cut = kept[-1][1]
        return Counter({w: n - cut for w, n in kept if n > cut})

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned_memory():
            vocab, counts = vocabulary(path), Counter()
            for part in parts:
                for text in part.column(0).to_pylist():
                    if text:
                        counts.update([w for w in text.split() if len(w) < LONGEST])
                        if len(counts) > 3 * summary:
                            counts = shrink(counts)
            pieces: Counter = Counter()
            for word, n in shrink(counts).items():
                for piece in vocab.pattern.findall(" " + word):
                    pieces[piece] += n
            del counts
            yield from batches(schema, pieces.items(), 20_000)

    summed = picked(docs, text=text_col).select(F.col("text").cast("string")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in summed.orderBy(F.desc("n"), "piece").limit(words).collect()]


#: What white space below ``AGREED`` must not be for words to be encoded one by one: two in a row, or any but blank and line feed.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0")


class Encoder:
    """Whole texts to ids and back, on a worker."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon, room: int = 48 << 20):
        """``room``: bytes that are remembered of words and pieces, twice over."""
        self.vocab, self.lexicon = vocab, lexicon
        self.memo = Memo(self._piece, room // 8)
        self.words = [Memo(self._word, room // 8), Memo(lambda w: self._word(" " + w), room - room // 4)]

    def _piece(self, piece: str) -> str:
        raw = piece.encode()
        ids = self.lexicon.ids(raw)
        return ",".join(map(str, self.vocab.merge(raw) if ids is None else ids))

    def _word(self, word: str) -> str:
        if word.lstrip(" ").isalpha():
            return self._piece(word)
        after_blank, memo = self.words[True], self.memo
        # a word in front of a comma is the word that is known without one
        return ",".join([after_blank[p[1:]] if p[0] == " " and p[1:].isalpha() else memo[p] for p in self.vocab.pattern.findall(word)])

    def runs(self, text: str, size: int = 1 << 18) -> Iterator[str]:
        """Ids in decimal joined by commas, for one run of pieces after another."""
        for special, segment in self.vocab.segments(text):
            if special:
                yield str(self.vocab.special[segment])
            elif self._plain(segment):
                yield from self._by_words(segment)
            else:
                pieces = iter(self.vocab.pieces(segment))
                while run := list(itertools.islice(pieces, size)):
                    yield ",".join(map(self.memo.__getitem__, run))

    def _plain(self, text: str) -> bool:
        """Whether all white space is single blanks and line feeds between words.  No piece then crosses the front of a
        blank or either side of a line feed, so words can be encoded one by one."""
        return not (text[0].isspace() or text[-1].isspace() or any(u in text for u in _UNEVEN)) and self.vocab.beyond.search(text) is None

    def _by_words(self, text: str) -> Iterator[str]:
        at_start, after_blank, feed = self.words[False].__getitem__, self.words[True].__getitem__, f",{self.memo[chr(10)]},"
        lines = iter(text.split("\n"))
        prefix = ""
        while block := list(itertools.islice(lines, 4096)):
            out = []
            for line in block:
                first, *rest = line.split(" ")
                out.append(at_start(first) + "," + ",".join(map(after_blank, rest)) if rest else at_start(first))
            yield prefix + feed.join(out)
            prefix = feed[1:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for run in self.runs(text) for i in run.split(",")]

    def decode(self, ids: Iterable[int | str]) -> str:
        return b"".join(self.vocab.bytes_of[str(i)] for i in ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, SHA-256 of the joined ids, SHA-256 of the decoded text."""
        n, ids, raw = 0, hashlib.sha256(), []
        for run in self.runs(text):
            ids.update(f",{run}".encode() if n else run.encode())
            each = run.split(",")
            n += len(each)
            raw.append(b"".join(map(self.vocab.bytes_of.__getitem__, each)))
        return n, ids.hexdigest(), hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest()


def lexicon_for(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    vocab = vocabulary(path)
    return build_lexicon({p.encode(): vocab.merge(p.encode()) for p in frequent_pieces(docs, path, text_col, words)})


def encode(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """The input's columns and ``ids array<int>``."""
    return _mapped(docs, path, text_col, words, ["ids array<int>"], lambda e, t: (e.encode(t),))


def digests(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """The input's columns, n_tokens, ids_sha256 and decoded_sha256 of a round trip."""
    return _mapped(docs, path, text_col, words, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"], lambda e, t: e.digest(t))


def _mapped(docs: DataFrame, path: str, text_col: str, words: int, added: list[str], work) -> DataFrame:
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon_for(docs, path, text_col, words))
    fields = [a.split(" ", 1) for a in added]
    struct = ", ".join(f"{n}: {k}" for n, k in fields)

    @F.pandas_udf(f"struct<{struct}>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with returned_memory():
            encoder = Encoder(vocabulary(path), Lexicon(shared.value))
            for part in texts:
                yield pd.DataFrame([work(encoder, t or "") for t in part], columns=[n for n, _ in fields])
            del encoder

    out = wrapped(docs, text=text_col).withColumn("__out", run(F.col("text").cast("string")))
    return unwrapped(out, docs.columns, **{n: F.col(f"__out.{n}") for n, _ in fields})


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """The input's columns and the text of its ids; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(path).bytes_of
        for part in ids:
            yield pd.Series([b"".join(known[str(i)] for i in (x if x is not None else ())).decode("utf-8", "replace") for x in part], dtype=object)

    return unwrapped(wrapped(tokens, ids=ids_col).withColumn("__out", run("ids")), tokens.columns, **{to: F.col("__out")})
