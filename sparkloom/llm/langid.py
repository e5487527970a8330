"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's likelihood sums over all ways to
cut it into pieces, by the forward algorithm; a text's is the product over its words.  The piece probabilities come from
expected counts over all segmentations (one forward-backward pass from a length prior), gathered over the words of the
learning fold.  The score is the posterior of the predicted language, with an even prior, at ``temperature``.

Pieces never cross white space, so a text falls apart into words, and the distinct words of a batch are scored together:
one array step for each word position and piece length.  A character outside the vocabulary is a piece of its own with
a small probability.

The model is fitted on at most about ``per_language`` documents of a language, those with the smallest hashes of their ids, and on
the ``most`` languages with most documents; every text is scored whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language that sorts first;
documents without a language, held-out ones and null ids aren't learned from; with no language learned every text is ``und``; rows that
repeat are scored alike; a word of any length is learned from and scored whole; an empty table gives an empty result; other columns and
their names play no part.
"""

from __future__ import annotations

import functools
import itertools
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bound_arrow_batches, fold_of, picked, returned_memory, text_of

PER_LANGUAGE = 3_000
#: Bytes of word likelihoods that a task remembers, in each of two generations.
ROOM = 32 << 20
#: Languages that are learned at most, those with most documents: the model has a number for each language and piece.
LANGUAGES = 500
#: Words that a task counts, and languages that it sums, before it hands them on.
COUNTED, SUMMED = 200_000, 64
FOLDS, HELD_OUT = 5, 0
TEMPERATURE = 0.2
_START = "▁"
_RARE = 1e-7
_BASE = np.uint64(0x100000001B3)


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, n + 1):
            out[i] = out[i - 1] * _BASE
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _hash(codes: np.ndarray) -> int:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            h = h * _BASE + c
    return int(h)


class Pieces:
    """Vocabulary pieces by a rolling hash, sorted for lookup."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.names = sorted({p.lower() for p in plain if p})
        self.longest = max(map(len, self.names))
        hashes = np.array([_hash(_codes(p)) for p in self.names], np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.lengths = np.array(list(map(len, self.names)))
        self.by_length = [np.sort(hashes[self.lengths == n]) for n in range(self.longest + 1)]

    def __len__(self) -> int:
        return len(self.names)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 for none."""
        at = np.searchsorted(self.sorted, hashes)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """All pieces in a set of words: for position i of the words and piece length n, (words, piece numbers)."""

    def __init__(self, vocab: Pieces, words: list[str]):
        marked = [_START + w for w in words]
        self.order = np.argsort([-len(w) for w in marked], kind="stable")  # longest first: live words are a prefix
        marked = [marked[i] for i in self.order]
        self.lengths = np.array([len(w) for w in marked], np.int64)
        self.size, self.top = len(words), int(self.lengths[0]) if words else 0
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = _codes("".join(marked))
        power = _powers(vocab.longest)
        # rolling: hash of the n characters that end at each place, built length by length
        self.steps: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.top + 1)]
        place = np.arange(len(codes)) - np.repeat(starts[:-1], self.lengths)
        owner = np.repeat(np.arange(self.size), self.lengths)
        rolling = np.zeros(len(codes), np.uint64)
        for n in range(1, vocab.longest + 1):
            fits = np.flatnonzero(place >= n - 1)  # ends at this character
            if not len(fits):
                break
            rolling[fits] = codes[fits - (n - 1)] * power[n - 1] + rolling[fits]
            found = vocab.find(rolling[fits])
            hit = found >= 0
            at, piece = fits[hit], found[hit]
            ends = place[at] + 1
            by_end = np.argsort(ends, kind="stable")
            at, piece, ends = at[by_end], piece[by_end], ends[by_end]
            cuts = np.flatnonzero(np.diff(ends)) + 1
            for chunk_at, chunk_piece, chunk_end in zip(np.split(at, cuts), np.split(piece, cuts), np.split(ends, cuts), strict=True):
                if len(chunk_at):
                    self.steps[int(chunk_end[0])].append((n, owner[chunk_at], chunk_piece))

    def forward(self, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward values (position, word, language) and the words' log likelihoods (word, language)."""
        langs = probability.shape[1]
        values = np.zeros((self.top + 1, self.size, langs))
        values[0] = 1
        for i in range(1, self.top + 1):
            live = int(np.searchsorted(-self.lengths, -i, side="right"))
            values[i, :live] = values[i - 1, :live] * _RARE
            for n, who, piece in self.steps[i]:
                values[i, who] += values[i - n, who] * probability[piece]
        with np.errstate(divide="ignore"):
            out = np.log(values[self.lengths, np.arange(self.size)])
        return values, out


def _long_likelihood(vocab: Pieces, word: str, probability: np.ndarray) -> np.ndarray:
    """Log likelihood of one word of any length, rescaled at every step."""
    lattice = Lattice(vocab, [word])
    ring = np.zeros((vocab.longest + 1, probability.shape[1]))
    ring[0], log = 1.0, np.zeros(probability.shape[1])
    size = len(ring)
    for i in range(1, lattice.top + 1):
        now = ring[(i - 1) % size] * _RARE
        for n, _, piece in lattice.steps[i]:
            now = now + ring[(i - n) % size] * probability[piece[0]]
        ring[i % size] = now
        peak = now.copy()
        ring /= peak
        log += np.log(peak)
    return log


class _Known:
    """Word -> row of numbers, in two generations: a full younger one becomes the older, and what is asked for often moves on."""

    def __init__(self, width: int, room: int):
        self.most = max(512, room // (200 + 4 * width))
        self.width, self.young, self.older = width, ({}, np.zeros((self.most, width), np.float32)), ({}, None)

    def fill(self, words: list[str], out: np.ndarray) -> list[int]:
        """Put the rows that are known into ``out``; returns the places of the other words."""
        names, rows = self.young
        at = np.fromiter(map(names.get, words, itertools.repeat(-1)), np.int64, len(words))
        out[at >= 0] = rows[at[at >= 0]]
        rest = np.flatnonzero(at < 0).tolist()
        names, rows = self.older
        met = [i for i in rest if words[i] in names]
        if met:
            out[met] = rows[[names[words[i]] for i in met]]
            self.keep([words[i] for i in met], out[met])
            gone = set(met)
            rest = [i for i in rest if i not in gone]
        return rest

    def keep(self, words: list[str], rows: np.ndarray) -> None:
        for at in range(0, len(words), self.most):
            part = words[at : at + self.most]
            if len(self.young[0]) + len(part) > self.most:
                self.older, self.young = self.young, ({}, np.zeros((self.most, self.width), np.float32))
            names, held = self.young
            held[len(names) : len(names) + len(part)] = rows[at : at + len(part)]
            names.update(zip(part, range(len(names), len(names) + len(part))))


class Model:
    """Piece probabilities of each language; ``score`` gives log likelihoods of words."""

    def __init__(self, path: str, languages: list[str], probability: np.ndarray, room: int = ROOM):
        self.path, self.languages, self.probability = path, languages, probability
        self.known = _Known(len(languages), room)

    def words(self, words: list[str], cells: int = 1 << 21) -> np.ndarray:
        """A row for each of the different ``words``; a block of words has about ``cells`` forward values."""
        vocab, out = pieces(self.path), np.zeros((len(words), len(self.languages)), np.float32)
        fresh = self.known.fill(words, out)
        for i in fresh:
            if len(words[i]) > 40:
                out[i] = _long_likelihood(vocab, words[i], self.probability)
        short = [i for i in fresh if len(words[i]) <= 40]
        block = max(64, min(8192, cells // (42 * max(1, len(self.languages)))))
        for at in range(0, len(short), block):
            part = short[at : at + block]
            lattice = Lattice(vocab, [words[i] for i in part])
            out[np.array(part)[lattice.order]] = lattice.forward(self.probability)[1]
        self.known.keep([words[i] for i in short], out[short])
        return out

    def texts(self, texts: list[str | None], temperature: float = TEMPERATURE) -> list[tuple[str, float]]:
        bags = [letters_of(t) for t in texts]
        place: dict[str, int] = {}
        for bag in bags:
            for w in bag:
                place.setdefault(w, len(place))
        table = self.words(list(place)).astype(np.float64)
        out = []
        for bag in bags:
            if not bag or not self.languages:
                out.append(("und", 0.0))
                continue
            rows = np.fromiter((place[w] for w in bag), np.int64, len(bag))
            total = np.fromiter(bag.values(), np.float64, len(bag)) @ table[rows]
            total *= temperature
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def letters_of(text: str | None) -> Counter:
    """Lower-cased words of a text with their counts, those with a letter alone."""
    return Counter({w: n for w, n in Counter((text or "").lower().split()).items() if w.isalpha() or any(c.isalpha() for c in w)})


def expected_counts(vocab: Pieces, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected number of times that each piece is used in the words, over all segmentations."""
    lattice = Lattice(vocab, words)
    forward, _ = lattice.forward(probability[:, None])
    forward = forward[:, :, 0]
    back = np.zeros_like(forward)
    back[lattice.lengths, np.arange(lattice.size)] = 1
    weights = weights[lattice.order] / forward[lattice.lengths, np.arange(lattice.size)]
    counts = np.zeros(len(vocab))
    for i in range(lattice.top, 0, -1):
        back[i - 1] += back[i] * _RARE
        for n, who, piece in lattice.steps[i]:
            used = back[i, who] * probability[piece]
            back[i - n, who] += used
            np.add.at(counts, piece, forward[i - n, who] * used * weights[who])
    return counts


def _found(vocab: Pieces, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of the pieces that end after place ``a`` and at ``b`` at the latest."""
    low = max(0, a - vocab.longest + 1)
    part, power = codes[low:b], _powers(vocab.longest)
    rolling, out = np.zeros(len(part), np.uint64), []
    for n in range(1, min(vocab.longest, len(part)) + 1):
        rolling[n - 1 :] = part[: len(part) - n + 1] * power[n - 1] + rolling[n - 1 :]
        first = max(n - 1, a - low)
        found = vocab.find(rolling[first:])
        hit = np.flatnonzero(found >= 0)
        ends = hit + first + low + 1
        out.append((ends - n, ends, found[hit]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def long_counts(vocab: Pieces, word: str, probability: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers and expected counts for one word of any length: forward and backward values as logarithms, and the
    pieces of one block of places at a time."""
    codes = _codes(_START + word)
    top = len(codes)
    forward, back = array("d", bytes(8 * (top + 1))), array("d", bytes(8 * (top + 1)))
    for a in range(0, top, block):
        b = min(top, a + block)
        starts, ends, piece = _found(vocab, codes, a, b)
        order, k = np.argsort(ends, kind="stable"), 0
        starts, ends, chance = starts[order].tolist(), [*ends[order].tolist(), 0], probability[piece[order]].tolist()
        for i in range(a + 1, b + 1):
            base, total = forward[i - 1], _RARE
            while ends[k] == i:
                total += math.exp(forward[starts[k]] - base) * chance[k]
                k += 1
            forward[i] = base + math.log(total)
    pieces_used, amounts = [], []
    for b in range(top, 0, -block):
        a = max(0, b - block)
        starts, ends, piece = _found(vocab, codes, a, min(top, b + vocab.longest - 1))
        inside = np.flatnonzero((starts >= a) & (starts < b))
        order, k = inside[np.argsort(-starts[inside], kind="stable")], 0
        starts, ends, piece = starts[order], ends[order], piece[order]
        begins, stops, chance = [*starts.tolist(), -1], ends.tolist(), probability[piece].tolist()
        for i in range(b - 1, a - 1, -1):
            base, total = back[i + 1], _RARE
            while begins[k] == i:
                total += math.exp(back[stops[k]] - base) * chance[k]
                k += 1
            back[i] = base + math.log(total)
        share = np.frombuffer(forward)[starts] + np.frombuffer(back)[ends] - forward[top]
        names, at = np.unique(piece, return_inverse=True)
        pieces_used.append(names)
        amounts.append(np.bincount(at, np.exp(share) * probability[piece], len(names)))
    return np.concatenate(pieces_used), np.concatenate(amounts)


def train(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE, smoothing: float = 0.1, most: int = LANGUAGES) -> Model:
    """Learn from rows with text and language outside the held-out fold."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    fold = picked(docs, doc_id="doc_id", text="text", lang="lang").filter((fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = fold.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    languages = sorted(r["lang"] for r in sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return Model(path, [], np.zeros((len(pieces(path)), 0)))
    # each language keeps the ids under its own cut of a uniform hash, which leaves about per_language of them
    draws = 1 << 20
    cuts = spark.createDataFrame([(r["lang"], int(min(1.0, per_language / r["n"]) * draws)) for r in sizes], "of string, cut int")
    chosen = fold.join(F.broadcast(cuts), F.col("lang") == F.col("of")).filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(draws)) < F.col("cut"))
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            yield from batches(schema, ((lang, w, n) for lang, bag in bags.items() for w, n in bag.items()), 20_000)
            bags.clear()

        with returned_memory():
            for part in parts:
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    bags.setdefault(lang, Counter()).update(letters_of(text))
                if sum(map(len, bags.values())) > COUNTED:
                    yield from told()
            yield from told()

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    expected = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.float64())])

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        flat = np.exp(-1.5 * np.maximum(1, 4 - vocab.lengths) - 3.0)  # longer pieces first, before anything is known
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            yield from batches(expected, ((lang, int(p), float(held[p])) for lang, held in sums.items() for p in np.flatnonzero(held)), 20_000)
            sums.clear()

        with returned_memory():
            for part in parts:
                langs, words, n = (c.to_pylist() for c in part.columns)
                for lang in dict.fromkeys(langs):
                    if lang not in sums and len(sums) >= SUMMED:
                        yield from told()
                    held = sums.setdefault(lang, np.zeros(len(vocab)))
                    of_lang = [i for i, x in enumerate(langs) if x == lang]
                    mine = [i for i in of_lang if len(words[i]) <= 40]
                    for i in (i for i in of_lang if len(words[i]) > 40):
                        used, amounts = long_counts(vocab, words[i], flat)
                        np.add.at(held, used, amounts * n[i])
                    for at in range(0, len(mine), 8192):
                        block = mine[at : at + 8192]
                        held += expected_counts(vocab, [words[i] for i in block], np.array([n[i] for i in block], float), flat)
            yield from told()

    # languages times pieces: bounded by the model's own size
    rows = counted.mapInArrow(gather, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(pieces(path)), len(languages)))
    for r in rows:
        counts[r["piece"], number[r["lang"]]] = r["n"]
    counts += smoothing
    return Model(path, languages, counts / counts.sum(axis=0))


def identify(docs: DataFrame, path: str, model: Model | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    model = model or train(docs, path)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.probability))

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with returned_memory():
            known = Model(path, *shared.value)
            for texts in parts:
                yield pd.DataFrame(known.texts(texts.tolist(), temperature), columns=["lang_pred", "score"])
            del known

    held = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return picked(docs, doc_id="doc_id", text="text").select("doc_id", held.alias("held_out"), run(text_of()).alias("out")).select("doc_id", "held_out", "out.lang_pred", "out.score")
