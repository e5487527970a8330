"""BM25 scored where the chunks lie: against brute force, with ties, copies, shared and rare terms; and what a task hands on."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import scoring
from sparkloom.operators import search as S


def brute(chunks: dict[str, str], queries: dict[int, str], k: int) -> dict[int, list[tuple[str, float]]]:
    tokens = {i: t.split() for i, t in chunks.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for words in tokens.values() for t in set(words))
    out = {}
    for qid, query in queries.items():
        scores = {}
        for i, words in tokens.items():
            tf = Counter(words)
            met = [t for t in set(query.split()) if tf[t]]
            if met:
                scores[i] = sum(math.log(1 + (len(tokens) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in met)
        out[qid] = sorted(((i, round(s, 9)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]
    return {q: hits for q, hits in out.items() if hits}


@pytest.mark.parametrize(("rare", "shared", "block"), [(256, 16, 8192), (4, 16, 7), (4, 1, 8192), (1 << 30, 1 << 30, 5)])
def test_bm25_is_that_of_brute_force(spark, monkeypatch, rare, shared, block):
    monkeypatch.setattr(scoring, "RARE", rare)
    monkeypatch.setattr(scoring, "SHARED", shared)
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 12, 40))]) for _ in range(rng.randrange(9))) for _ in range(120)]
    chunks = {f"{i}_{j}": t for i, t in enumerate(texts) for j in range(rng.choice((1, 1, 4)))}
    # many queries of one frequent set, each with a word of its own; copies; none; words that no chunk has
    queries = {i: f"w0 w1 w2 w{3 + i}" for i in range(30)} | {40: "w0 w0 w1", 41: "", 42: "absent", 43: "w1 w0", 44: "w39", 45: "w0 absent"}
    got = S.bm25(spark.createDataFrame(list(chunks.items()), "id string, content string").repartition(3), spark.createDataFrame(list(queries.items()), "qid long, query string"), "content", 6)
    hits: dict[int, list[tuple[str, float]]] = {}
    for r in got.orderBy("qid", "rank").collect():
        hits.setdefault(r["qid"], []).append((r["id"], round(r["score"], 9)))
    want = brute(chunks, queries, 6)
    assert {q: [i for i, _ in h] for q, h in hits.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for q in want for a, b in zip(hits[q], want[q], strict=True))


def test_a_task_hands_on_k_rows_of_a_set_however_many_chunks_it_meets():
    """30 queries of three frequent terms and 4000 chunks that have them all: 120 000 meetings before, one set's five best now."""
    n = 4000
    asked = scoring.asked_block([np.array([0, 1, 2, 3 + i]) for i in range(30)], np.array([n, n, n, *[1] * 30], float), n, 5.0, 5, 1.2, 0.75)
    assert asked.n_sets == 1
    terms = [[0, 1, 2, 3 + i] if i < 30 else [0, 1, 2] for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"id": [f"{i:05}" for i in range(n)], "keep": [True] * n, "dl": pa.array([5] * n, pa.int32()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32()))})

    class Shared:
        value = asked

    rows = pa.Table.from_batches(list(scoring.scored(Shared)(iter([batch])))).to_pydict()
    assert [i for no, i in zip(rows["no"], rows["id"]) if no == 0] == [f"{i:05}" for i in range(5)]
    assert sorted((no - 1, i) for no, i in zip(rows["no"], rows["id"]) if no) == [(i, f"{i:05}") for i in range(30)]


def test_best_keeps_ties_by_id_and_a_bounded_number_of_rows():
    best = scoring.Best(2, 3)
    rng = np.random.default_rng(1)
    ids = np.array([f"{i:06}" for i in rng.permutation(60000)], object)
    for at in range(0, len(ids), 1000):
        best.add(np.zeros(1000, int), ids[at : at + 1000], np.full(1000, 0.5))
        assert best.pending <= (1 << 14) + 1000
    q, found, _ = best.rows()
    assert q.tolist() == [0, 0, 0] and found.tolist() == ["000000", "000001", "000002"]


def test_sets_held_against_growing_batches_find_what_brute_force_finds(spark, monkeypatch):
    """Few chunks a batch, so that thresholds leave frequent terms for later; copies, short and long chunks, terms that repeat."""
    for name, value in (("OPENING", 8), ("BATCH", 64), ("FREQUENT", 4), ("LATER", 6), ("RARE", 1 << 30)):
        monkeypatch.setattr(scoring, name, value)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice((4, 4, 15, 60))]) for _ in range(rng.choice((0, 3, 20, 30)))) for _ in range(500)]
    chunks = {f"{i}_{j}": t for i, t in enumerate(texts) for j in range(rng.choice((1, 1, 1, 5)))}
    queries = {i: " ".join(rng.sample(words[:4], 3) + rng.sample(words, 6)) for i in range(40)} | {50: "w0", 51: "w0 w1 w2 w3", 52: "", 53: "absent"}
    n, tokens = len(chunks), {i: t.split() for i, t in chunks.items()}
    df = Counter(t for listed in tokens.values() for t in set(listed))
    known = [sorted({words.index(t) for t in q.split() if t in words}) for q in queries.values()]
    mean = sum(map(len, tokens.values())) / n
    asked = scoring.asked_block([np.array(q, int) for q in known], np.array([df[w] for w in words], float), n, mean, 4, 1.2, 0.75)
    assert not len(asked.pairs[1])
    rows = [(i, len(listed), sorted(Counter(words.index(t) for t in listed).items())) for i, listed in tokens.items() if listed]
    batch = lambda part: pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in part]), pa.array([True] * len(part)), pa.array([r[1] for r in part], pa.int32()), *(pa.array([[x[j] for x in r[2]] for r in part], pa.list_(pa.int32())) for j in (0, 1))],
        names=["id", "keep", "dl", "terms", "tfs"],
    )

    class Shared:
        value = asked

    summed = []
    held = scoring.np.bincount
    monkeypatch.setattr(scoring.np, "bincount", lambda x, *more: summed.append(len(x)) or held(x, *more))
    found = pa.Table.from_batches(list(scoring.scored(Shared)(batch(rows[at : at + 50]) for at in range(0, len(rows), 50)))).to_pylist()
    best = [sorted(((r["id"], round(r["score"], 9)) for r in found if r["no"] == s), key=lambda x: (-x[1], x[0]))[:4] for s in range(asked.n_sets)]
    want = brute(chunks, queries, 4)
    assert {q: best[asked.set_of[i]] for i, q in enumerate(queries) if asked.set_of[i] >= 0} == want
    postings = sum(1 for q in known for r in rows for t, _ in r[2] if t in q)
    assert sum(summed) < 0.8 * postings  # postings of terms that were left for later are not met


def test_shared_vectors_find_what_a_vector_for_each_chunk_finds(spark):
    """Ten chunks of each vector and two vectors that tie: ranks, ties and scores are those of ``dense``."""
    rng = np.random.default_rng(3)
    made = rng.normal(size=(30, 4)).round(1)
    made[7] = made[3]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    holders = spark.createDataFrame([(f"{i}_x", i * 7 % 31) for i in range(300)], "id string, vec_id long")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made[:9])], "qid long, embedding array<double>")
    told = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert told(S.dense_shared(S.SharedVectors(holders, vectors), asked, 13)) == told(S.dense(holders.join(vectors, "vec_id").select("id", "embedding"), asked, 13))
