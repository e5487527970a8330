"""Prefix tries, collocations and exact top-k on small fixtures: SQL in ``test_corpus``, brute force and odd rows here."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import ann, collocations, common, prefix_trie, topk

# --- conversation prefix trie

TURNS = "conv_id long, turn long, role string, text string, digest string, pos int, CONV_ID2 long, prefix string"


def brute_trie(rows, shared):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((t is not None, t or 0, role, text[:64], hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    by = {c: [(x[2], x[5]) for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = by.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:] if shared else own
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def turns_of():
    rng, rows = random.Random(4), []
    for c in [*range(25), *range(100, 115), *range(-3, 0), *range(250, 265), 10**15 + 7]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 8, 20])):
            rows.append((c, t if rng.random() > 0.2 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü𝄞", None])))
    rows += [(c, t, "u", f"t{t % 7}") for c in (300, 301) for t in range(60)]  # two long copies
    rows += [(400 + i, t, "u", "same") for i in range(30) for t in range(8)]  # a group of copies
    rows += [(500 + i, t, "u", "x") for i in range(15) for t in range(i)]  # each the head of the next
    rows += [(None, 1, "u", "x"), (600, 1, "user", "A"), (600, 1, "user", "A"), (700, 1, "u", "long " * 50_000)]
    return rows


def trie_rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "d", 1, 2, "p") for r in turns_of()], TURNS).repartition(4)


def test_trie_equals_brute_force(spark, turns):
    assert trie_rows(prefix_trie.trie(turns, shared_heads=True)) == brute_trie(turns_of(), True)


def test_trie_in_small_blocks(spark, turns, monkeypatch):
    """Chains of four turns, three levels of them; most keys are hot; ids in texts of four."""
    plain = prefix_trie.prefixes
    monkeypatch.setattr(prefix_trie, "prefixes", lambda t, block=4: plain(t, block))
    monkeypatch.setattr(prefix_trie, "CHAINS", 2)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    assert trie_rows(prefix_trie.trie(turns)) == brute_trie(turns_of(), False)


def test_trie_of_nothing(spark, turns):
    assert prefix_trie.trie(turns.filter("false"), True).collect() == []
    assert prefix_trie.trie(turns.filter("conv_id IS NULL"), True).collect() == []


def test_conversation_that_keeps_no_turn(spark):
    """Its first turns would come from a conversation that isn't there: it ends at the root."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(c, 1, "u", "x"), (300, 1, "u", "y")]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), True)) == brute_trie(rows, True)


# --- collocations

DOCS = "text string, lang string, word string, h long, A int, phrase string"


def brute_phrases(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang in n:
        found = {p: a for (g, p), a in f.items() if g == lang and a >= least}
        inner = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= found[p[i : i + k]]}
        told = []
        for p, a in found.items():
            if len(p) > 1 and p not in inner:
                s, k = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                told.append((-s, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(told)[:top])]
    return sorted(out)


def texts_of():
    rng = random.Random(3)
    vocab = ["a", "B", "c", "ä", "𝄞", "x-y", "of", "The", "the", "z"]
    rows = [(" ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", "xx"), ("  \t ", "yy"), ("solo", "zz"), ("one two three " * 200, "qq"), ("w " * 30_000, "hot")] + [("Same Words Here again and again", "cp")] * 7


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(*r, "w", 1, 2, "p") for r in texts_of()], DOCS).repartition(5)


@pytest.mark.parametrize("least, top, more", [(3, 2000, {"buckets": 64, "slots": 200}), (4, 5, {}), (300, 2000, {"buckets": 1024})])
def test_collocations_equal_brute_force(spark, texts, least, top, more):
    assert sorted(map(tuple, collocations.mine(texts, least=least, top=top, **more).collect())) == brute_phrases(texts_of(), least, top)


def test_collocations_in_small_steps(spark, texts, monkeypatch):
    for name, size in {"ROW": 4, "STEP": 16, "WORDS_HELD": 3, "BYTES": 5, "FAN_IN": 2}.items():
        monkeypatch.setattr(collocations, name, size)
    few = texts.filter("lang IN ('cp', 'de', 'zz')")
    assert sorted(map(tuple, collocations.mine(few, least=3).collect())) == brute_phrases([r for r in texts_of() if r[1] in ("cp", "de", "zz")], 3, 2000)


def test_collocations_read_runs_once_a_length(spark, texts, monkeypatch):
    """However many blocks there are, no more tables are made and no more passes taken; full bit arrays lose nothing."""
    plain, labels = collocations.stage, []
    monkeypatch.setattr(collocations, "stage", lambda df, label: labels.append(label) or plain(df, label))
    monkeypatch.setattr(collocations, "BITS", 64)
    want, told = brute_phrases(texts_of(), 3, 2000), []
    for slots in (1 << 20, 9000):
        labels.clear()
        assert sorted(map(tuple, collocations.mine(texts, least=3, buckets=64, slots=slots).collect())) == want
        told.append(list(labels))
    assert told[0] == told[1] and told[0].count("colloc-level") == 4


def test_collocations_of_nothing(spark, texts):
    assert collocations.mine(texts.filter("false")).collect() == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    a[:100] = a[0]  # keys that differ in one lane alone
    slots = collocations.Slots.built(a, b)
    assert sorted(slots.find(a, b)) == list(range(5000))
    assert (slots.find(a, b + np.uint64(1)) == -1).all()


def test_colliding_words_are_hashed_again(spark, monkeypatch):
    plain = collocations._word_hash

    def poor(lang, seed):
        return (lambda word: len(word)) if seed == 0 else plain(lang, seed)

    monkeypatch.setattr(collocations, "_word_hash", poor)
    docs = spark.createDataFrame([("aa bb cc", "en")] * 5, "text string, lang string")
    assert [r.phrase for r in collocations.mine(docs, least=3).collect()] == ["aa bb cc"]


# --- exact top-k

WIDE = "vec_id long, embedding array<double>, score double, v string, DIM int, rank int"


def brute_topk(rows, every=50, k=5):
    kept: dict[int, list[int]] = {}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [clip(math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256) for x in v]
            kept[i] = min(kept[i], w) if i in kept else w
    out = []
    for q, a in kept.items():
        if q % every == 0:
            near = sorted((-clip(sum(x * y for x, y in zip(a, b))), i) for i, b in kept.items() if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("bins, near", [(1024, 16), (8, 0)])
def test_topk_equals_brute_force(spark, monkeypatch, bins, near):
    monkeypatch.setattr(topk, "NEAR", near)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # a crowd of ties
    rows += [(2000 + i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 19)).tolist()) for i in range(60)]
    rows += [(3000 + i, [1.0, 2.0]) for i in range(3)] + [(3050, []), (3051, []), (3052, None), (3100, [None] * 8), (3150, [float("nan")] * 8)]
    rows += [(None, [1.0] * 8), (50, [9.0] * 8), (3200, [1e300] * 8), (3250, [-1e300] * 8), (3300, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 0.5, "v", 3, 4) for r in rows], WIDE).repartition(5)
    assert sorted(map(tuple, topk.search(df, bins=bins).collect())) == brute_topk(rows)


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], WIDE)
    assert topk.search(empty).collect() == []
    assert topk.search(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<double>")).collect() == []


def test_ann_of_very_large_and_small_vectors(spark):
    """Squares of these components overflow or vanish; their cosines don't."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=16) * 10.0 ** rng.choice([-170, 0, 170])).tolist()) for i in range(60)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect()}
    unit = [np.array(v) / np.abs(v).max() for _, v in rows]
    unit = np.array([v / np.linalg.norm(v) for v in unit])
    for q in (0, 50):
        near = unit @ unit[q]
        near[q] = -2
        best = np.argsort(-near)[:5]
        assert [got[q, r + 1][0] for r in range(5)] == best.tolist()
        assert np.allclose([got[q, r + 1][1] for r in range(5)], near[best])
