"""BM25 where the texts lie: a task scores its own chunks against a block of queries and hands on the best of them, so that no meeting of a chunk
and a query is written or shuffled.

A block's terms get numbers.  A first pass writes each chunk's numbers and counts (``numbered``) and tells how many chunks have each term; a
second one scores (``scored``).  Queries share work: those with the same frequent terms are one set, scored once, and chunks of one
task's batch that have the same length and counts stand for each other.  Rare terms, if leaving them out makes sets of queries
fall together, are scored for the queries and chunks that meet in them: such a pair's whole score is at least the set's score
of that chunk, so that the ``k`` best of a query are among the ``k`` best of its set and the pairs.

Where there are no pairs, a set is held against a batch of chunks at a time.  Its frequent terms are left out of the first sum as long as what they can
add stays below a share of the score it takes to be among the ``k`` best so far; the chunks that can still reach that score get the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: A term that at most one chunk in so many has may be scored by pairs.
RARE = 256
#: A term that at least one set in so many has is scored by a matrix product.
SHARED = 16
#: Scores held at once by a task, and meetings of a term's chunk with a query.
CELLS, MEETINGS = 1 << 20, 1 << 21
#: Chunks that sets are held against at once, at first and at most; each batch is four times the one before, as the first ones only give thresholds.
OPENING, BATCH = 1 << 12, 1 << 16
#: A term that at least one chunk in so many of a batch has may be left for later, up to so many terms, and the share of a threshold that may take.
FREQUENT, LATER, SHARE = 64, 256, 0.7
#: Share of such a term's postings whose weights are left whole; of the others what is beyond that isn't left.
USUAL = 0.9
#: Scores tie at nine decimals.
NEAR = 2e-9

NUMBERED = "id string, keep boolean, dl int, terms array<int>, tfs array<int>"
HITS = "no int, id string, score double"


class Best:
    """The ``k`` best rows of each of ``n`` queries: all that can tie with the k-th at nine decimals, of equal ones the ``k`` smallest ids."""

    def __init__(self, n: int, k: int):
        self.k = max(k, 1)
        self.floor = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending, self.room = 0, 1 << 14

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores are told to twelve decimals, as sums differ by the order of their terms beyond that."""
        able = score >= self.floor[q]
        if able.any():
            self.parts.append((q[able], ids[able], np.round(score[able], 12)))
            self.pending += int(able.sum())
            if self.pending > self.room:
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, int), np.empty(0, object), np.empty(0)
        q, ids, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        at = np.lexsort((pd.factorize(ids, sort=True)[0], -score, q))
        q, ids, score = q[at], ids[at], score[at]
        place = np.arange(len(q))
        fresh = np.r_[True, (q[1:] != q[:-1]) | (score[1:] != score[:-1])]
        kept = place - np.maximum.accumulate(np.where(fresh, place, 0)) < self.k
        q, ids, score = q[kept], ids[kept], score[kept]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        full = start[np.diff(np.r_[start, len(q)]) >= self.k]
        self.floor[q[full]] = score[full + self.k - 1] - NEAR
        kept = score >= self.floor[q]
        self.parts = [(q[kept], ids[kept], score[kept])]
        self.pending = int(kept.sum())
        self.room = max(1 << 14, 2 * self.pending)
        return self.parts[0]


def spans(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of the ranges of so many places from each start."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner] + starts[owner]


def by_term(lists: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists that have each term, as (starts, owners)."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    term = np.concatenate([*lists, np.empty(0, int)]).astype(int)
    return np.searchsorted(np.sort(term), np.arange(n_terms + 1)), owner[np.argsort(term, kind="stable")]


@dataclass
class Asked:
    """A block of queries: ``idf`` by term; the terms of sets and of pairs by lists of owners; a query's set, or -1; frequent terms as a matrix."""

    idf: np.ndarray
    n_sets: int
    n_queries: int
    sets: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    set_of: np.ndarray
    column: np.ndarray
    shared: np.ndarray
    mean: float
    k: int
    k1: float
    b: float

    def set_terms(self) -> tuple[np.ndarray, np.ndarray]:
        """(set, term) of all terms of sets, by sets."""
        starts, owners = self.sets
        order = np.argsort(owners, kind="stable")
        return owners[order], np.repeat(np.arange(len(starts) - 1), np.diff(starts))[order]


def asked_block(queries: list[np.ndarray], df: np.ndarray, chunks: int, mean: float, k: int, k1: float, b: float) -> Asked:
    """``queries``: the numbers of each query's terms; ``df``: chunks that have each term."""
    met = df > 0
    idf = np.where(met, np.log(1 + (chunks - df + 0.5) / (df + 0.5)), 0.0)
    queries = [q[met[q]] for q in queries]
    common, numbers = df * RARE > chunks, {}
    for q in queries:
        if common[q].any():
            numbers.setdefault(q[common[q]].tobytes(), len(numbers))
    if 2 * len(numbers) > len({q.tobytes() for q in queries}):
        common = met
    numbers, lists = {}, []
    set_of = np.full(len(queries), -1)
    for i, q in enumerate(queries):
        part = q[common[q]]
        if len(part):
            set_of[i] = numbers.setdefault(part.tobytes(), len(numbers))
            if len(numbers) > len(lists):
                lists.append(part)
    starts, owners = by_term(lists, len(df))
    many = np.flatnonzero(np.diff(starts) * SHARED > max(len(lists), 64))[: max(CELLS * 4 // max(len(lists), 1), 1)]
    column = np.full(len(df), -1)
    column[many] = np.arange(len(many))
    shared = np.zeros((len(many), len(lists)))
    for at, term in enumerate(many):
        shared[at, owners[starts[term] : starts[term + 1]]] = 1.0
    return Asked(idf, len(lists), len(queries), (starts, owners), by_term([q[~common[q]] for q in queries], len(df)), set_of, column, shared, mean, k, k1, b)


def numbered(words, field: str):
    """The numbers of a block's words in a list of tokens, with their counts; chunks that have none are left out."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value_set = words.value, None
        for part in parts:
            listed = part.column(field)
            flat = listed.flatten()
            value_set = pa.array(known, flat.type) if value_set is None else value_set
            term = pc.fill_null(pc.index_in(flat, value_set=value_set), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            cell, tf = np.unique(row[term >= 0] * len(known) + term[term >= 0], return_counts=True)
            row, term = np.divmod(cell, max(len(known), 1))
            met, starts = np.unique(row, return_index=True)
            ends = pa.array(np.r_[starts, len(row)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            plain = [part.column(name).take(pa.array(met)).cast(kind) for name, kind in (("id", pa.string()), ("keep", pa.bool_()), (f"{field}_size", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*plain, *lists], names=["id", "keep", "dl", "terms", "tfs"])

    return work


def numbered_counts(words):
    """As ``numbered``, from rows (id, dl, counts) that are counted already."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for part in parts:
            listed = part.column("counts")
            flat = listed.flatten()
            term = pc.fill_null(pc.index_in(flat.field("term"), value_set=pa.array(known, pa.string())), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            at = np.flatnonzero(term >= 0)
            at = at[np.lexsort((term[at], row[at]))]
            met, starts = np.unique(row[at], return_index=True)
            ends = pa.array(np.r_[starts, len(at)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[at].astype(np.int32))) for x in (term, flat.field("tf").to_numpy())]
            plain = [part.column(name).take(pa.array(met)) for name in ("id", "dl")]
            yield pa.RecordBatch.from_arrays([plain[0].cast(pa.string()), pa.array(np.ones(len(met), bool)), plain[1].cast(pa.int32()), *lists], names=["id", "keep", "dl", "terms", "tfs"])

    return work


def scored(block):
    """no, id, score of a task's best chunks: ``no`` is a set's number, or the number of sets and a query's place for a pair."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = block.value
        sets, pairs = Best(asked.n_sets, asked.k), Best(asked.n_queries, asked.k)
        terms = None if len(asked.pairs[1]) else asked.set_terms()
        for part in parts if terms is None else grown(parts):
            if len(part):
                _score(asked, part.take(pc.sort_indices(part.column("id"))), sets, pairs, terms)
        for best, base in ((sets, 0), (pairs, asked.n_sets)):
            q, ids, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array((q + base).astype(np.int32)), pa.array(ids, pa.string()), pa.array(score)], names=["no", "id", "score"])

    return work


def grown(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``OPENING`` rows, then of four times as many each time, up to ``BATCH``."""
    held, rows, room = [], 0, OPENING
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for part in parts:
        at = 0
        while at < len(part):
            held.append(part.slice(at, room - rows))
            at, rows = at + len(held[-1]), rows + len(held[-1])
            if rows == room:
                yield joined()
                held, rows, room = [], 0, min(4 * room, BATCH)
    if held:
        yield joined()


def _score(asked: Asked, part: pa.RecordBatch, sets: Best, pairs: Best, terms: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    ids = part.column("id").to_numpy(zero_copy_only=False)
    dl = part.column("dl").to_numpy()
    ends = part.column("terms").offsets.to_numpy()
    ends = ends - ends[0]
    term, tf = part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy()
    of_set, of_pair = np.diff(asked.sets[0])[term], np.diff(asked.pairs[0])[term]
    row = np.repeat(np.arange(len(ids)), np.diff(ends))
    rare = np.bincount(row, of_pair, len(ids)) > 0
    # of the chunks with the same length and counts the k smallest ids stand for all; those with a rare term are looked at in any case
    told = np.where(of_set > 0, (term.astype(np.int64) << 32) | tf, -1).tobytes()
    seen: dict[tuple[int, bytes], int] = {}
    wanted = rare.copy()
    for i, (length, a, z) in enumerate(zip(dl.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        key = (length, told[8 * a : 8 * z])
        count = seen.get(key, 0)
        if count < sets.k:
            wanted[i] = True
            seen[key] = count + 1
    weight = asked.idf[term] * tf * (asked.k1 + 1) / (tf + asked.k1 * (1 - asked.b + asked.b * dl[row] / asked.mean))
    rows = np.flatnonzero(wanted)
    if terms is not None:
        _score_sets(terms, rows, ids, ends, term, weight, sets)
        return
    dense = asked.column[term] >= 0
    cost = np.cumsum(np.bincount(row, np.where(dense, 0, of_set) + of_pair, len(ids))[rows])
    at, most = 0, max(CELLS // max(asked.n_sets, len(asked.shared), 1), 1)
    while at < len(rows):
        before = cost[at - 1] if at else 0.0
        to = min(at + most, max(int(np.searchsorted(cost, before + MEETINGS, "right")), at + 1))
        _score_rows(asked, rows[at:to], ids, ends, term, weight, sets, pairs)
        at = to


def _score_sets(terms: tuple[np.ndarray, np.ndarray], rows: np.ndarray, ids: np.ndarray, ends: np.ndarray, term: np.ndarray, weight: np.ndarray, sets: Best) -> None:
    """Hold all sets against a batch's rows: a sum over the postings of a set's other terms first, then what its frequent terms add, where that matters."""
    n, (owner, wanted) = len(rows), terms
    local, entry = spans(ends[rows], np.diff(ends)[rows])
    order = np.argsort(term[entry], kind="stable")
    local, entry = local[order], entry[order]
    weight, term = weight[entry], term[entry]
    if not len(term):
        return
    held, first = np.unique(term, return_index=True)
    last = np.append(first[1:], len(term))
    many, most = last - first, np.maximum.reduceat(weight, first)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    here = held[at] == wanted
    owner, at = owner[here], at[here]
    places = [local[a:z] for a, z in zip(first.tolist(), last.tolist(), strict=True)]
    weights = [weight[a:z] for a, z in zip(first.tolist(), last.tolist(), strict=True)]
    # the most frequent terms up to a usual weight as rows of a matrix, for the chunks that are looked at again, and what is beyond it as postings
    later = np.argsort(-many, kind="stable")[:LATER]
    later = later[many[later] * FREQUENT > n]
    line = np.full(len(held), -1)
    line[later] = np.arange(len(later))
    whole = np.zeros((len(later), n))
    beyond_places, beyond_weights = [], []
    for i, t in enumerate(later.tolist()):
        most[t] = np.quantile(weights[t], USUAL)
        whole[i, places[t]] = np.minimum(weights[t], most[t])
        over = weights[t] > most[t]
        beyond_places.append(places[t][over])
        beyond_weights.append(weights[t][over] - most[t])
    rows_of = list(whole)
    # of a set's frequent terms those that save most postings for what they can add, up to a share of its threshold
    order = np.lexsort((np.where(line[at] >= 0, -many[at] / most[at], 0.0), owner))
    owner, at = owner[order], at[order]
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, int)
    counts = np.diff(np.append(begins, len(owner)))
    adds = np.where(line[at] >= 0, most[at], 0.0)
    total = np.cumsum(adds)
    taken = total - np.repeat(total[begins] - adds[begins], counts)
    waits = (line[at] >= 0) & (taken <= SHARE * sets.floor[owner])
    rest = np.add.reduceat(np.where(waits, adds, 0.0), begins) if len(owner) else np.empty(0)
    waiting = np.add.reduceat(waits.astype(int), begins) if len(owner) else np.empty(0, int)
    lines, floors, at = line[at], sets.floor[owner[begins]], at.tolist()
    whose, what, scores = [], [], []
    for who, begin, count, wait, left, floor in zip(owner[begins].tolist(), begins.tolist(), counts.tolist(), waiting.tolist(), rest.tolist(), floors.tolist(), strict=True):
        now, then = at[begin + wait : begin + count], lines[begin : begin + wait].tolist()
        where = [places[t] for t in now] + [beyond_places[i] for i in then]
        score = np.bincount(np.concatenate(where), np.concatenate([weights[t] for t in now] + [beyond_weights[i] for i in then]), n)
        found = np.flatnonzero(score >= floor - left - NEAR) if floor > left + NEAR else np.flatnonzero(score)
        score = score[found]
        for i in then if len(found) else ():
            score += rows_of[i].take(found)
        if len(found) > sets.k:
            floor = max(floor, np.partition(score, len(score) - sets.k)[len(score) - sets.k] - NEAR)
        kept = np.flatnonzero(score >= floor)
        whose.append(np.full(len(kept), who))
        what.append(found[kept])
        scores.append(score[kept])
    if whose:
        sets.add(np.concatenate(whose), ids[rows[np.concatenate(what)]], np.concatenate(scores))
        sets.rows()


def _score_rows(asked: Asked, rows: np.ndarray, ids: np.ndarray, ends: np.ndarray, term: np.ndarray, weight: np.ndarray, sets: Best, pairs: Best) -> None:
    n = asked.n_sets
    local, entry = spans(ends[rows], np.diff(ends)[rows])
    term, weight, column = term[entry], weight[entry], asked.column[term[entry]]
    thin, thick = column < 0, column >= 0
    starts, owners = asked.sets
    owner, place = spans(starts[term[thin]], np.diff(starts)[term[thin]])
    score = np.bincount(local[thin][owner] * n + owners[place], weight[thin][owner], len(rows) * n).astype(float).reshape(len(rows), n)
    if len(asked.shared):
        held = np.zeros((len(rows), len(asked.shared)))
        held[local[thick], column[thick]] = weight[thick]
        score += held @ asked.shared
    r, s = np.nonzero((score > 0) & (score >= sets.floor))
    sets.add(s, ids[rows[r]], score[r, s])
    starts, owners = asked.pairs
    owner, place = spans(starts[term], np.diff(starts)[term])
    if len(owner):
        cell, where = np.unique(local[owner] * asked.n_queries + owners[place], return_inverse=True)
        r, q = np.divmod(cell, asked.n_queries)
        of = asked.set_of[q]
        base = np.where(of >= 0, score[r, np.maximum(of, 0)], 0.0) if n else 0.0
        pairs.add(q, ids[rows[r]], np.bincount(where, weight[owner]) + base)
