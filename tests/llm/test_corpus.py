"""The corpus operators on small fixtures: brute force, edge rows, exact round trips, recall and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, bpe, exact_dedup, langid, line_dedup, mixing, near_dedup, quality, queries, repeats, url_filter
from tests.oracle import DATA, connected, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that no operator asks for, some with names that operators use themselves.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, digest string, TEXT2 string, key int, keep_id long, n_tokens int, h int"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
RAW = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "the cat sat on the mat", "en", "a", 22), (5, "the cat sat on the mat", "en", "b", 22),
    (5, "the cat sat on the mat", "en", "b", 22), (None, "the cat sat on the mat", "en", None, 22), (6, "The Cat sat on the mat", "en", "b", 22), (7, LONG, "en", "c", len(LONG)), (8, LONG + " tail", "en", "c", len(LONG) + 5),
    (9, "12 34 !!", "en", "c", 8), (10, "ein kurzer Satz über die Straße", "de", "c", 31), (11, "𝄞 漢字 ́x<|endoftext|>y", "zh", "c", 20), (12, "one", "en", "c", 3), (None, None, None, "c", None),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, 0.5, 1, "x", "y", 2, 3, 4, 5) for r in RAW]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 1), (7, 1), (9, 0), (99, 1), (None, 1), (10, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), connected().sql(queries.ORACLE[name]).df())


# --- repeats


def brute_repeats(rows, length):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[s : s + length]) for _, w in words for s in range(len(w) - length + 1))
    out = set()
    for i, w in words:
        starts = [s for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1]
        while starts:
            first, end = starts[0], starts[0] + length
            while starts and starts[0] < end:
                end = starts.pop(0) + length
            out.add((i, first, end))
    return out


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        text = [f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 90))]
        if i % 3:
            a, b = sorted(rng.integers(0, 41, 2))
            at = rng.integers(0, len(text) + 1)
            text[at:at] = passage[a:b]
        rows.append((i, " ".join(text)))
    rows += [(60, "same " * 80), (61, None), (62, rows[1][1]), (63, rows[4][1] + " " + rows[4][1])]
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=14, gram=3)
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got.collect()} == brute_repeats(rows, 14)


def test_repeats_in_a_family_of_edited_copies(spark):
    rng = np.random.default_rng(11)
    parent = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(1000):
        text = list(parent)
        for at in rng.choice(200, rng.integers(5, 9), replace=False):
            text[at] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(text)))
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == brute_repeats(rows, 50)


def test_shared_lengths_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        words = rng.integers(1, 3, rng.integers(0, 9)) if i % 4 else np.ones(8, np.int64)
        rows.append((int(rng.integers(0, 3)), words.astype(">u8").tobytes(), 1, i, i, 0, 0))
    schema = "node long, key binary, gram long, context long, own long, kind int, mark long"
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        met = repeats.shared_lengths(spark.createDataFrame(rows, schema)).select("context", "depths").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = collections.defaultdict(set)
    for r in met:
        assert r["depths"] == sorted(set(r["depths"]))
        got[r["context"]].update(r["depths"])

    def common(a, b):
        n = 0
        while a[8 * n : 8 * n + 8] and a[8 * n : 8 * n + 8] == b[8 * n : 8 * n + 8]:
            n += 1
        return n

    assert len(met) == 800
    for node, key, _, i, *_ in rows:
        assert got[i] == {common(key, k) for n, k, _, j, *_ in rows if n == node and j != i}


def brute_matches(rows, length):
    out = {}
    for gram, context, _, before, after in rows:
        met = []
        for g, c, own, b, a in rows:
            if g == gram and c != context:
                l = next((n for n in range(99) if b[8 * n : 8 * n + 8] != before[8 * n : 8 * n + 8] or not b[8 * n :] or not before[8 * n :]))
                r = next((n for n in range(99) if a[8 * n : 8 * n + 8] != after[8 * n : 8 * n + 8] or not a[8 * n :] or not after[8 * n :]))
                if l + r >= length:
                    met.append((l, r, own))
        if met:
            out[gram, context] = tuple(f(x) for f, x in zip((max, max, min), zip(*met, strict=True), strict=True))
    return out


def test_extended_matches_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = {}
    for i in range(400):
        gram = int(rng.integers(0, 3))
        before = rng.choice([1, 1, 1, 1, 2], rng.integers(0, 10)).astype(">u8").tobytes()
        after = np.concatenate([[7] * 3, rng.choice([1, 1, 1, 1, 2], rng.integers(3, 10))]).astype(">u8").tobytes()
        rows[gram, before, after] = (gram, i, 1000 - i, before, after)
    rows = list(rows.values())
    got = repeats.matched(spark.createDataFrame(rows, "gram long, context long, own long, before binary, after binary"), 14).collect()
    own = {(g, c): o for g, c, o, _, _ in rows}
    want = {k: (l, r, min(o, own[k])) for k, (l, r, o) in brute_matches(rows, 14).items()}
    assert {(r["gram"], r["context"]): (r["l"], r["r"], r["other"]) for r in got} == want and len(want) > 50


def test_repeats_edges(edge, empty):
    got = {(r["doc_id"], r["match_id"]) for r in repeats.repeats(edge).collect()}
    assert {(7, 7), (8, 7)} <= got and {d for d, _ in got} == {7, 8}
    assert repeats.repeats(empty).count() == 0


# --- quality


def test_quality_held_out(spark, docs):
    got = queries.op2_quality(spark, DATA).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))


def test_quality_of_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = queries.op2_quality(spark, folder).join(known, "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.mean([(x > bad).mean() + (x == bad).mean() / 2 for x in good])
    assert auc > 0.85 and (good >= 0.7).mean() > 0.9 and (bad < 0.7).mean() > 0.3


def test_quality_learns_from_an_id_that_many_rows_repeat(spark):
    rows = [(1, f"clean words number {i}.") for i in range(200)] + [(i, "clean words.") for i in range(2, 60)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int"), positives=30, unlabelled=40)
    assert 0 < model.prior < 1


def test_quality_tells_junk_apart():
    rng = np.random.default_rng(0)
    clean = lambda: " ".join(rng.choice(["tion", "ther", "ing", "and", "of"], rng.integers(20, 200))) + "."
    junk = lambda: "!! ".join(w.upper() for w in clean().split())
    pos = np.array([quality.features(clean()) for _ in range(300)])
    unl = np.array([quality.features(clean() if i % 5 else junk()) for i in range(600)])
    model = quality.learn(pos, unl)
    assert 0.7 < model.prior < 0.9
    held = np.array([quality.features(clean()) for _ in range(100)]), np.array([quality.features(junk()) for _ in range(100)])
    assert (model.score(held[0]) >= 0.7).mean() > 0.95 and (model.score(held[1]) < 0.7).mean() > 0.95


def test_the_prior_has_no_step():
    """Drawn rows are the same at each size but for the last; the estimate alone is far from 0.5."""
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, (600, len(quality.FEATURES))), rng.normal(1, 1, (600, len(quality.FEATURES)))
    priors = {n: quality.learn(pos[:n], unl[:n]).prior for n in (0, 1, 2, 5, 10, 18, 19, 20, 21, 22, 300)}
    assert priors[0] == priors[1] == 0.5 and abs(priors[2] - 0.5) < 0.01
    assert max(abs(priors[a] - priors[a + 1]) for a in (18, 19, 20, 21)) < 0.1
    assert all(abs(priors[n] - 0.5) <= 0.5 * n * n / (n * n + quality.STEADY**2) for n in priors)
    assert priors[300] > 0.6


def test_quality_scores_are_those_of_the_texts_one_by_one(spark, docs):
    """Every score of the query against features and weights applied in plain Python, summed cut by cut."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, labels)
    got = queries.op2_quality(spark, DATA).toPandas().set_index("doc_id").score
    for row in docs.select("doc_id", "text").collect():
        x, total, at = quality.features(row["text"]), model.bias, 0
        for j, cuts in enumerate(model.cuts):
            total += sum(w for cut, w in zip(cuts, model.weights[at : at + len(cuts)], strict=True) if x[j] > cut)
            at += len(cuts)
        assert abs(got[row["doc_id"]] - 1 / (1 + np.exp(-total))) < 1e-9


def test_the_prior_is_that_of_the_whole_corpus(spark):
    rng = np.random.default_rng(4)
    clean = lambda: " ".join(f"word{x}" for x in rng.integers(0, 400, 60)) + "."
    junk = lambda: "$$ ## BUY 99 || " * int(rng.integers(5, 20))
    ids = spark.range(1600).select(F.col("id").alias("doc_id")).filter(quality.fold_of("doc_id", quality.FOLDS) != quality.HELD_OUT)
    ids = [r["doc_id"] for r in ids.orderBy(F.xxhash64(F.lit("quality"), "doc_id")).collect()]
    # 200 rows of the sample of 240 are clean, and one in ten of the others
    texts = [clean() if k < 200 or k % 10 == 0 else junk() for k in range(len(ids))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, t in zip(ids, texts, strict=True) if t.startswith("word")], "doc_id long, quality int")
    true = sum(t.startswith("word") for t in texts) / len(texts)
    assert true < 0.3 and abs(quality.train(docs, labels, unlabelled=240).prior - true) < 0.1


def test_quality_edges(edge, empty, labels, spark):
    got = quality.scored(edge, labels).toPandas()
    assert len(got) == len(RAW) and got.score.notna().all() and not got[got.doc_id.isna()].held_out.any()
    assert got[got.doc_id == 5].score.nunique() == 1
    assert quality.scored(empty, labels).count() == 0
    assert quality.accepted(edge, labels).columns == edge.columns
    assert (quality.scored(edge, labels.limit(0)).toPandas().score == 0.5).all()


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(edge, docs, tokenizer):
    for df in (edge.select("doc_id", "text"), docs.select("doc_id", "text")):
        for r in bpe.digests(df, queries.tokenizer_path()).collect():
            want = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(want)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip_and_empty(edge, empty):
    path = queries.tokenizer_path()
    made = bpe.decode(bpe.encode(edge, path), path, to="back").select("text", "back").collect()
    assert all((r["text"] or "") == r["back"] for r in made)
    assert bpe.digests(empty, path).count() == 0


def test_bpe_pieces_of_any_kind(tokenizer):
    vocab = bpe.vocabulary(queries.tokenizer_path())
    words = [" the", "the", " and", "ing", "x" * 9]
    coder = bpe.Encoder(vocab, bpe.Lexicon(bpe.build_lexicon({w.encode(): vocab.merge(w.encode()) for w in words})), room=4_000)
    rng = np.random.default_rng(2)
    pool = list("ab Z9\n\t '.,") + ["é", "漢", "𝄞", "\x85", "\x1c", " ", "<|endoftext|>", " the", "'ll", "͸"]
    for _ in range(1500):
        text = "".join(rng.choice(pool, rng.integers(0, 40)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want, text
        assert coder.decode(want) == tokenizer.decode(want, skip_special_tokens=False)
    text = "ab" * 20_000
    assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_memo_holds_what_is_asked_for_often_and_no_long_key():
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or k.upper(), room=50 * 210)
    for i in range(3000):
        assert memo[f"once{i}"] == f"ONCE{i}" and memo["often"] == "OFTEN" and len(memo) <= 60
    assert made.count("often") == 1
    assert memo["x" * 600] == "X" * 600 and "x" * 600 not in memo


def test_a_vocabulary_without_special_tokens_takes_empty_texts(tmp_path, tokenizer):
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    (tmp_path / "plain.json").write_text(json.dumps(spec | {"added_tokens": []}), encoding="utf-8")
    vocab = bpe.Vocabulary(str(tmp_path / "plain.json"))
    coder = bpe.Encoder(vocab, bpe.Lexicon(bpe.build_lexicon({})))
    assert coder.encode("") == [] and coder.digest("")[0] == 0
    for text in ("a b", " a", "a\u00a0b", "a\n\nb", "x" * 700 + " y"):
        assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_long_piece_is_not_in_the_lexicon(spark):
    docs = spark.createDataFrame([(1, "q" * 100_000 + " the the"), (2, None)], "doc_id long, text string")
    assert max(map(len, bpe.frequent_pieces(docs, queries.tokenizer_path()))) <= bpe.LONGEST


def test_lexicon_holds_its_words_alone():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["a", "ab", "abs", "cabs", "cab", "z"])}
    lexicon = bpe.Lexicon(bpe.build_lexicon(words))
    assert all(lexicon.ids(w) == ids for w, ids in words.items())
    assert all(lexicon.ids(w) is None for w in (b"", b"b", b"abc", b"ca", b"zz"))


# --- exact dedup


def test_trie_spills_and_keeps_everything():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 12))).encode() for _ in range(3000)]
    trie = exact_dedup.PatriciaOwners(True, memory=5000)
    for i, t in enumerate(texts):
        trie.insert(t, i)
        while trie.full() and trie.spill():
            pass
    got = sorted(trie.drain())
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    assert got == sorted((t, min(i), len(i)) for t, i in want.items())


@pytest.mark.parametrize("late", [[b"other start" * 9], [b""], [b"<html>" + b"z" * 80, b"<", b""]])
def test_trie_keeps_what_it_spilled_below_a_later_fork(late):
    rng = np.random.default_rng(8)
    head = b"<html><head>" * 20
    texts = [head + rng.bytes(int(n)) for n in rng.integers(1, 60, 400)]
    texts = texts + [t for one in late for t in (one, *[head + rng.bytes(40) for _ in range(150)], texts[7])]
    trie = exact_dedup.PatriciaOwners(memory=6_000)
    for i, text in enumerate(texts):
        trie.insert(text, i)
        while trie.full() and trie.spill():
            pass
    got = list(trie.drain())
    assert len(got) == len(set(texts))
    assert {t: (o, n) for t, o, n in got} == {t: (texts.index(t), texts.count(t)) for t in texts}


def test_exact_dedup_of_a_shared_head_loses_nothing(spark):
    head = "<html><head>" * 50
    texts = [head + hashlib.sha256(b"%d" % (i % 500)).hexdigest()[: 10 + i % 50] for i in range(900)] + ["an other start", ""] + [head + hashlib.sha256(b"x%d" % i).hexdigest() for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    first: dict[str, int] = {}
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    got = exact_dedup.mark(docs, memory=8_000).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == [(i, first[t]) for i, t in enumerate(texts)]
    assert sorted(r["doc_id"] for r in exact_dedup.survivors(docs, memory=8_000).collect()) == sorted(first.values())


@pytest.mark.parametrize("ask", [exact_dedup.mark, exact_dedup.survivors])
def test_a_text_without_an_owner_is_an_error(spark, monkeypatch, ask):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "doc_id long, text string")
    some = exact_dedup.owners(docs).filter(F.col("keep_id").isNotNull())
    monkeypatch.setattr(exact_dedup, "owners", lambda *_: some)
    with pytest.raises(Exception, match="no owner"):
        ask(docs).collect()


def test_exact_dedup_edges(edge, empty):
    for memory in (exact_dedup.MEMORY, 2000):
        got = exact_dedup.mark(edge, keep="largest", memory=memory).toPandas()
        assert len(got) == len(RAW)
        cat = got[got.text_sha256 == hashlib.sha256(b"the cat sat on the mat").hexdigest()]
        assert set(cat.keep_id) == {5} and set(cat.group_size) == {4} and cat.kept.sum() == 2
        assert set(got[got.text_sha256 == hashlib.sha256(b"").hexdigest()].keep_id) == {2}
    left = exact_dedup.survivors(edge)
    assert left.columns == edge.columns and left.count() == len({t or "" for _, t, *_ in RAW})
    assert exact_dedup.mark(empty).count() == exact_dedup.survivors(empty).count() == 0


# --- neighbours


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(ann.hadamard(y), x)


def test_ann_recall_and_scores(spark):
    got = queries.op5_ann(spark, DATA).toPandas()
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    x, ids = np.vstack(e.embedding).astype(float), e.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        near[q] = -9
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine.score, near[np.searchsorted(ids, mine.vec_id)])
        hits, total = hits + len(set(mine.vec_id) & set(ids[np.lexsort((ids, -near))[:5]])), total + 5
    assert hits / total >= 0.9


def test_ann_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (50, [0.0, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (7, [1.0])]
    rows += [(i, [1.0, 0.001 * (i % 3)]) for i in range(8, 20)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, label int")
    got = ann.search(df).toPandas()
    assert set(got.query_id) == {0, 50}
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == [1, 2, 9, 12, 15]
    few = ann.search(df.filter("vec_id IN (0, 1, 50)")).toPandas()
    assert len(few) == 4 and list(few[few.query_id == 0].sort_values("rank").vec_id) == [1, 50]
    assert ann.search(df.limit(0)).count() == 0


def test_ann_searches_each_length_and_one_vector_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [0.0, 1.0, 0.0]), (100, [2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().sort_values(["query_id", "rank"])
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in got.itertuples()] == [(0, 1, 0.6), (0, 2, 0.0), (50, 51, 0.0)]


# --- lines


def test_lines_near_the_threshold_are_exact(spark):
    rows = [(i, f"own line {i}\n {'foot' if i < 7 else 'head'}er \n\nbody", f"s{i}") for i in range(15)] + [(99, None, None), (98, "header", None), (97, "header", "s9")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, h int, gone string").repartition(3)
    got = {r["doc_id"]: (r["clean"], r["n_removed"]) for r in line_dedup.cleaned(df, min_sites=8).collect()}
    assert got[0] == ("own line 0\n footer \n", 1) and got[8] == ("own line 8\n", 2) and got[98] == ("", 1) and got[99] == ("", 0)
    assert line_dedup.cleaned(df.limit(0)).count() == 0


def test_line_edges(edge):
    assert line_dedup.cleaned(edge).count() == len(RAW)


def test_a_text_of_many_lines_costs_its_length(spark):
    def took(n):
        text = "\n".join(f"line {i}" if i % 1000 else "foot" for i in range(n))
        docs = spark.createDataFrame([(0, text, "s0")] + [(i, "foot", f"s{i}") for i in range(1, 12)], "doc_id long, text string, source string")
        began = time.perf_counter()
        got = line_dedup.cleaned(docs).filter("doc_id = 0").first()
        assert (got["n_lines"], got["n_removed"]) == (n, -(-n // 1000)) and got["clean"] == "\n".join(x for x in text.split("\n") if x != "foot")
        return time.perf_counter() - began

    took(1000)
    assert took(60_000) < 15 + 3 * took(30_000)


# --- languages


def test_langid_held_out(spark, docs):
    got = queries.op7_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    vocab = langid.pieces(queries.tokenizer_path(queries.PIECES))
    rng = np.random.default_rng(0)
    p = rng.random((len(vocab), 2)) / len(vocab)
    number = {n: i for i, n in enumerate(vocab.names)}

    def brute(word, k, at=0):
        if at == len(word):
            return 1.0
        total = langid._RARE * brute(word, k, at + 1)
        return total + sum(p[number[word[at : at + n]], k] * brute(word, k, at + n) for n in range(1, vocab.longest + 1) if at + n <= len(word) and word[at : at + n] in number)

    words = ["thereon", "a", "über", "x9", "漢字", "aaaa"]
    got = langid.Model("", ["u", "v"], p)
    got.path = queries.tokenizer_path(queries.PIECES)
    want = np.log([[brute("▁" + w, k) for k in (0, 1)] for w in words])
    assert np.allclose(got.words(words), want, rtol=1e-4)
    assert np.allclose(langid._long_likelihood(vocab, "thereon", p), want[0])


@pytest.mark.parametrize("block", [1, 7, 1 << 14])
def test_long_words_count_as_short_ones_do(block):
    vocab = langid.pieces(queries.tokenizer_path(queries.PIECES))
    flat = np.exp(-1.5 * np.maximum(1, 4 - vocab.lengths) - 3.0)
    for word in ("a", "thereon", "漢字", "internationalisierungsmaßnahme𝄞xyz"):
        used, amounts = langid.long_counts(vocab, word, flat, block)
        got = np.zeros(len(vocab))
        np.add.at(got, used, amounts)
        assert np.allclose(got, langid.expected_counts(vocab, [word], np.ones(1), flat), rtol=1e-9, atol=1e-12)
    used, amounts = langid.long_counts(vocab, "straße" * 2000, flat, 500 * block)
    assert np.isclose((amounts * vocab.lengths[used]).sum(), 12_001, rtol=1e-3)


def test_langid_learns_scripts_without_spaces(spark):
    path = queries.tokenizer_path(queries.PIECES)
    letters = [p for p in langid.pieces(path).names if len(p) == 1 and p.isalpha() and "\u4e00" <= p <= "\u9fff"]
    assert len(letters) >= 80
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(letters[:40] if i % 2 else letters[40:80], 60)), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, path).join(docs, "doc_id").toPandas()
    assert got.held_out.any() and (got.lang == got.lang_pred).all()


def test_langid_of_more_languages_than_it_learns(spark):
    path = queries.tokenizer_path(queries.PIECES)
    rows = [(i, "the cat sat" if i % 3 else "der Hund lief", "en" if i % 3 else "de") for i in range(90)] + [(100 + i, "zzz", f"x{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, path, most=2).languages == ["de", "en"] and len(langid.train(docs, path).languages) > 20


def test_word_rows_move_on_to_the_next_generation():
    known = langid._Known(2, 0)
    for i in range(40):
        words = ["often", *(f"w{i}x{j}" for j in range(100))]
        out = np.zeros((101, 2), np.float32)
        fresh = known.fill(words, out)
        assert (0 in fresh) == (i == 0) and (i == 0 or out[0].tolist() == [1.0, 2.0])
        out[fresh] = [1.0, 2.0]
        known.keep([words[k] for k in fresh], out[fresh])
        assert len(known.young[0]) <= known.most


def test_langid_edges(edge, empty, spark):
    path = queries.tokenizer_path(queries.PIECES)
    got = {r["doc_id"]: r for r in langid.identify(edge.filter("doc_id IS NOT NULL"), path).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 9)] == ["und"] * 4 and got[9]["score"] == 0
    assert langid.identify(edge, path).count() == len(RAW)
    assert langid.identify(empty, path).count() == 0
    none = langid.identify(edge.withColumn("lang", F.lit(None).cast("string")), path).toPandas()
    assert set(none.lang_pred) == {"und"}


# --- mixing


def test_mixing_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 7}" if i % 9 else None) for i in range(1500)] + [(9000, "only", "tiny"), (9001, None, "void"), (9001, "", "void")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, s_source int, trial string").repartition(4)
    got = mixing.plan(df).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got[got["size"] == 0].taken == 0).all()
    by = got.groupby(got.source.fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    big = by[by["size"] > 1000]
    assert (abs(big.taken - big.target) < 0.01 * big.target + 40).all()
    again = mixing.plan(df.repartition(2)).toPandas()
    assert got.sort_values(list(got.columns)).reset_index(drop=True).equals(again.sort_values(list(got.columns)).reset_index(drop=True))
    made = mixing.mixed(df)
    assert made.columns == df.columns and made.count() == got.copies.sum()


def test_mixing_edges(edge, empty):
    planned = mixing.plan(edge).toPandas()
    assert len(planned) == len(RAW)
    assert {i: set(planned[planned.doc_id == i]["size"]) for i in (1, 2, 3, 5, 7, 8)} == {1: {0}, 2: {0}, 3: {0}, 5: {6}, 7: {60_000}, 8: {60_001}}
    assert mixing.plan(empty).count() == mixing.mixed(empty).count() == 0


# --- URLs


def test_url_rules(spark):
    urls = [
        ("http://A.Example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("https://com/en/", "com", "/en/", "com/en/", "block"), ("http://xcom/en/", "xcom", "/en/", None, None),
        ("https://example.net/de/81#a", "example.net", "/de/81", "example.net/de/8", "block"), ("http://b.net/de/9", "b.net", "/de/9", "net/de/", "allow"), ("http://x.org/es", "x.org", "/es", None, None),
        ("x.org/es/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b://c.org/es/?", "b:", "//c.org/es/", None, None), ("http://h.org?x/es/", "h.org", "", None, None),
    ]
    df = spark.createDataFrame([(i, u[0], "<p>", 1, "r") for i, u in enumerate(urls)], "page_id long, url string, html string, suffix int, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.filter("page_id = 7")).collect()} == {"allow"}


def test_verdicts_of_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    learn = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(4)) != 0
    got = url_filter.judge(pages, learn=learn).filter(F.col("rule").isNotNull() & ~learn).toPandas()
    right, most = (got.block_score > 0.5) == (got.verdict == "block"), (got.verdict == "block").mean()
    # one verdict for all would be right for 0.746 of them
    assert len(got) > 100 and 0.7 < most < 0.8 and right.mean() > 0.85


URL_SQL = """WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)"""


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_hosts_paths_and_rules_of_all_pages(spark, folder):
    got = queries.op9_url_filter(spark, folder).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"), F.col("verdict").isin("allow", "block").alias("one")).toPandas()
    assert got.one.all() and got.rule.notna().any() and got.rule.isna().any()
    same(got.drop(columns="one"), connected(folder).sql(URL_SQL).df())


def test_a_suffix_does_not_tell_its_own_label(spark):
    urls = [(i, f"http://{'b' if i % 2 else 'a'}{i}.org/{'es' if i % 2 else 'fr'}/") for i in range(60)]
    rules = [("block" if i % 2 else "allow", f"{'b' if i % 2 else 'a'}{i}.org", "/") for i in range(40)]
    got = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).filter("rule IS NULL").toPandas()
    assert got.block_score.nunique() <= 4 and set(got.verdict) <= {"allow", "block"}


def test_url_edges(spark):
    long = "http://h.com/" + "a/" * 20_000 + "?" + "q=1&" * 20_000
    rows = [(1, long), (1, long), (2, "http://com/en/1"), (2, "http://com/en/1"), (None, "http://x.net/de/1")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).toPandas()
    assert len(got) == 5 and got.groupby(["page_id"], dropna=False).verdict.nunique().max() == 1 and list(got[got.page_id == 1].path.map(len)) == [40_001] * 2


def test_trees_learn_a_rule(spark):
    spark.sparkContext.getCheckpointDir() or url_filter.shared_dir(spark)
    rows = [(float(i % 17), float(i % 5), int((i % 17 > 8) != (i % 5 > 2))) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, blocked int")
    trees = url_filter.fit(df, ("a", "b"))
    right = df.filter((trees.margin(trees.by_feature) > 0) == (F.col("blocked") == 1)).count()
    assert right > 1900


# --- near duplicates


def brute_components(rows, words, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    owner = list(range(len(rows)))

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                owner[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return {(i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    rng = np.random.default_rng(9)
    rows = []
    for family in range(8):
        base = [f"f{family}w{x}" for x in rng.integers(0, 400, 120)]
        for _ in range(12):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 6)):
                text[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join(f"u{x}" for x in rng.integers(0, 5000, 60)) + " " + "shared passage of words that many hold " * 3) for i in range(40)]
    rows += [(500, rows[3][1]), (501, None), (502, ""), (503, "one"), (504, "ONE"), (505, "two words"), (506, rows[5][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.mark(df, words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_blocks_of_a_list_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    # a chain of near copies: neighbours are linked, ends are not, and the smallest is not linked with most
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([f"x{k}" for k in range(9 * i)] + base[9 * i :])) for i in range(8)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_the_largest_label_of_a_list_meets_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    texts = [f"same words in all of these and one of its own w{i}" for i in range(14)]
    label = [b"A" if i < 9 else b"BCDEF"[i - 9 : i - 8] for i in range(14)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = docs.select(F.col("text").cast("binary").alias("digest"), "doc_id", F.xxhash64("text").alias("tkey"))
    # each stranger collides with one member of the large label alone, and the last with the one before it alone
    near = {9: 0, 10: 3, 11: 5, 12: 8, 13: 12}
    sig = [[i, 100 + i] for i in range(9)] + [[near[i], 200 + i] for i in range(9, 13)] + [[300, 212]]
    shown = spark.createDataFrame([(t.encode(), x) for t, x in zip(texts, sig, strict=True)], "digest binary, sig array<short>")
    sets = near_dedup.shingle_sets(docs, wanted, 1, "doc_id", "text").join(shown, "digest")
    open_lists = spark.createDataFrame([(7, t.encode(), len(set(t.split())), x) for t, x in zip(texts, label, strict=True)], "key long, digest binary, n long, label binary")
    cuts = near_dedup.dealt_lists(open_lists)
    row = cuts.first()
    assert (bytes(row["most"]), row["cuts"], row["apart"]) == (b"A", 3, 5)
    got = {frozenset((bytes(r["a"]).decode(), bytes(r["b"]).decode())) for r in near_dedup.merged_lists(open_lists.join(cuts, "key"), sets, 1, 80).collect()}
    assert got == {frozenset((texts[x], texts[y])) for x, y in near.items()}


def test_second_round_tells_shingles_with_equal_upper_halves_apart(spark):
    names = [f"w{i}" for i in range(400_000)]
    # a word alone is a shingle of its own
    shingles = near_dedup.scramble(near_dedup.WordHashes().of([n.encode() for n in names]) + np.uint64(1)) >> np.uint64(32)
    order = np.argsort(shingles, kind="stable")
    at = int(np.flatnonzero(np.diff(shingles[order]) == 0)[0])
    u, v = names[order[at]], names[order[at + 1]]
    texts = [f"{u} {v} c d", f"{u} {v} c d e", f"{u} p q r", f"{v} p q r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = docs.select(F.col("text").cast("binary").alias("digest"), "doc_id", F.xxhash64("text").alias("tkey"))
    sets = near_dedup.shingle_sets(docs, wanted, 1, "doc_id", "text").withColumn("sig", F.array(F.lit(1).cast("long")))
    rows = [(k // 2, t.encode(), len(t.split()), t.encode(), 1) for k, t in enumerate(texts)]
    lists = spark.createDataFrame(rows, "key long, digest binary, n long, label binary, cuts int")
    got = {(bytes(r["a"]).decode(), bytes(r["b"]).decode()) for r in near_dedup.merged_lists(lists, sets, 1, 80).collect()}
    assert got == {(max(texts[:2]), min(texts[:2]))}


def test_common_shingles_of_long_documents_are_whole_numbers():
    # 680,017 of 800,020 shingles in common are 85 percent; a float of 32 bits can't hold a hundred times that
    shared = np.arange(680_017, dtype=np.int64)
    sets = [np.concatenate([shared, np.arange(at, at + n)]) for at, n in ((10**7, 60_001), (2 * 10**7, 60_002))]
    linked = lambda s: near_dedup._linked(s, np.array(list(map(len, s))), np.array([0]), np.array([1]), 85).item()
    assert linked(sets) and not linked([s[1:] for s in sets])


def test_common_shingles_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n)) for n in (120, 150, 200, 5, 90, 140)]
    sizes, low, high = np.array(list(map(len, sets))), np.array([0, 1, 4]), np.array([1, 2, 3, 5])
    want = [[100 * len(np.intersect1d(sets[a], sets[b])) >= 30 * len(np.union1d(sets[a], sets[b])) for b in high] for a in low]
    for cells in (6, 100, 1 << 22):
        monkeypatch.setattr(near_dedup, "CELLS", cells)
        assert near_dedup._linked(sets, sizes, low, high, 30).tolist() == want


def test_near_duplicate_edges(edge, empty):
    got = near_dedup.mark(edge).toPandas()
    assert len(got) == len(RAW) and (got[got.n_shingles == 0].kept).all()
    assert set(got[got.doc_id == 6].component_id) == {4} and set(got[got.doc_id == 8].component_id) == {7}
    assert near_dedup.survivors(edge).columns == edge.columns
    assert near_dedup.mark(empty).count() == near_dedup.survivors(empty).count() == 0
