"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train one additive logistic model by the non-negative risk of Kiryo et al.
(2017): prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-)).  A first model tells the positives from the unlabelled
sample, and the class prior is the smallest ratio, over its thresholds, of the share above among all rows of the learning
fold to the positive share above (the anchor estimate, with a binomial allowance).

Samples are bounded: ``positives`` trusted rows and ``unlabelled`` rows, those with the smallest hashes of their ids, from
the learning fold alone.  They are what the driver holds, at every corpus size.  The prior reads every whole text of the learning fold, and
scoring every whole text, once each.

The inputs of a score are properties of the text only: shares of character classes, word and line lengths, repetition of
words and neighbours.  Each is cut at its sample quantiles, and the model adds one weight for each cut passed.

Defined cases: a null text counts as empty; an empty text has all features 0 and is scored like any other; a score is never
null; without positives or unlabelled rows every score is the prior (0.5 where that is unknown too); with few rows of
either kind the estimated prior shrinks towards 0.5, half the way at 20 rows and by less than 0.003 at 266; a null id is in no
fold, is not held out and isn't learned from; rows that repeat are scored alike; an empty table gives an empty result;
further columns pass through ``accepted``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, fold_of, picked, returned_memory, text_of, unwrapped, wrapped

POSITIVES, UNLABELLED = 4_000, 8_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Rows of the smaller sample at which the estimated prior weighs as much as 0.5; its weight grows with the square of the rows.
STEADY = 20

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32,), "feed": (10,), "high": range(128, 256),
    "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|", "sign": b"#$%&*+=<>@^~\\_`", "bracket": b"()[]{}", "quote": b"\"'", "slash": b"/-",
}
_TABLE = np.array([[float(b in kinds) for b in range(256)] for kinds in _KINDS.values()])
FEATURES = [*_KINDS, "entropy", "length", "word", "long", "caps", "distinct", "top", "twice", "again", "lines", "same_line", "short_line", "run", "bare"]


def features(text: str | None) -> np.ndarray:
    """One row of ``FEATURES`` for a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    seen = share[share > 0]
    n, bag = len(words), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    row = [
        float(-(seen * np.log(seen)).sum()), np.log1p(len(raw)), float(lengths.mean()), float((lengths > 20).mean()),
        sum(w.isupper() for w in words) / n, len(bag) / n ** 0.9, max(bag.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(pairs) / max(1, n - 1), np.log1p(len(raw) / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), max(Counter(lines).values()) / len(lines), sum(not any(48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c > 127 for c in w) for w in words) / n,
    ]
    return np.concatenate([_TABLE @ share, row])


class Model:
    """Cuts of every feature and one weight for each cut passed."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.cuts, self.weights, self.bias, self.prior = cuts, weights, bias, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[:, [j]] > c[None, :]).astype(np.float64) for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights + self.bias, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, decay: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Adam on the logistic loss: ordinary positive-against-unlabelled without a prior, the non-negative risk with one."""
    d = positive.shape[1]
    w, state, out = np.zeros(d + 1), [np.zeros(d + 1), np.zeros(d + 1)], None
    if prior is not None:
        w[-1] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        if prior is None:
            grad = p.T @ (sp - 1) / len(p) / 2 + u.T @ su / len(u) / 2
        else:
            grad_pos = prior * (p.T @ (sp - 1)) / len(p)
            grad_neg = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
            risk_neg = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
            grad = grad_pos + grad_neg if risk_neg >= 0 else -grad_neg
        grad[:-1] += decay * w[:-1]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        w = w - rate * state[0] / (1 - 0.9**t) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
    out = w
    return out[:-1], float(out[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled sample, from scores of a positive-against-unlabelled model."""
    cuts = _anchors(positive)
    return _smallest_ratio(positive, cuts, np.array([(unlabelled >= cut).sum() for cut in cuts]), len(unlabelled))


def _anchors(positive: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(positive, np.linspace(0.0, 0.6, 61)))


def _smallest_ratio(positive: np.ndarray, cuts: np.ndarray, counts: np.ndarray, total: int) -> float:
    """The prior from the number of rows, of ``total``, at each of the ``cuts`` or above."""
    best = 1.0
    for cut, count in zip(cuts, counts, strict=True):
        above, among = float(count) / max(1, total), float((positive >= cut).mean())
        slack = 1.0 / np.sqrt(max(1, total)) + 1.0 / np.sqrt(max(1, len(positive)))
        best = min(best, (above + slack * 0.5 * np.sqrt(above * (1 - above) + 1e-9)) / max(among, 1e-9))
    return float(np.clip(best, 0.02, 0.98))


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, bins: int = 16, halves: tuple[np.ndarray, np.ndarray] | None = None, above: Callable | None = None) -> Model:
    """Fit the model on feature rows of trusted positives and of unlabelled text.

    ``above(model, fitted, cuts)`` counts the corpus's rows at each cut or above, and all rows, where row half k is scored by
    ``fitted[k]``; ``halves`` are the samples' halves.  Without them the prior comes from the samples."""
    if not len(positive) or not len(unlabelled):
        known = 0.5 if prior is None else prior
        return Model([np.zeros(0) for _ in FEATURES], np.zeros(0), float(np.log(known / (1 - known))), known)
    both = np.concatenate([positive, unlabelled])
    grid = np.concatenate([[0.003], np.linspace(0, 1, bins + 1)[1:-1], [0.985, 0.995]])
    cuts = [np.unique(np.concatenate([[both[:, j].min()], np.quantile(both[:, j], grid)])) for j in range(both.shape[1])]
    model = Model(cuts, np.zeros(sum(map(len, cuts))), 0.0, 0.5)
    p, u = model.design(positive), model.design(unlabelled)
    fewest = min(len(p), len(u))
    if prior is None and fewest < 2:
        prior = 0.5  # no half to learn from
    if prior is None:
        # each half scored by a model of the other half
        sides = halves or (np.arange(len(p)) % 2, np.arange(len(u)) % 2)
        ph, uh = (h if 0 < h.sum() < len(h) else np.arange(len(h)) % 2 for h in sides)
        sp, su, fitted = np.zeros(len(p)), np.zeros(len(u)), []
        for k in (0, 1):
            w, c = _fit(p[ph != k], u[uh != k], None, 2e-3, 200, 0.05)
            sp[ph == k], su[uh == k] = p[ph == k] @ w + c, u[uh == k] @ w + c
            fitted.append((w, c))
        estimate = _smallest_ratio(sp, _anchors(sp), *above(model, fitted, _anchors(sp))) if above else estimate_prior(sp, su)
        prior = 0.5 + (estimate - 0.5) * fewest**2 / (fewest**2 + STEADY**2)
    model.weights, model.bias = _fit(p, u, prior, 1e-3, 500, 0.05)
    model.prior = prior
    return model


def _half() -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")


def _sample(texts: DataFrame, ids: DataFrame, at_most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and halves of the rows with these ids, ``at_most`` of them by the hash of the id.

    Features are computed where the rows are, for these ids alone, and only then are rows brought together: no text moves.
    ``ids`` are at most ``at_most`` different ids; an id that rows repeat is why rows are limited again."""
    made = texts.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", _half().alias("half"), _features_udf()("text").alias("x"))
    found = made.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "x").limit(at_most).collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    return np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["half"] for r in found], int)


def _first_ids(rows: DataFrame, at_most: int) -> DataFrame:
    """The ids of the ``at_most`` rows with the smallest hash of the id."""
    return rows.select("doc_id").orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(at_most).distinct()


def _features_udf():
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return run


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Learn from the folds that aren't held out: rows with quality 1 as positives, any rows as unlabelled."""
    bound_arrow_batches(docs.sparkSession)
    learning = fold_of("doc_id", FOLDS) != HELD_OUT
    docs, labels = picked(docs, doc_id="doc_id", text="text"), picked(labels, doc_id="doc_id", quality="quality")
    texts = docs.filter(learning).select("doc_id", text_of().alias("text"))
    p, p_half = _sample(texts, _first_ids(labels.filter(learning & (F.col("quality") == 1)), positives), positives)
    u, u_half = _sample(texts, _first_ids(texts, unlabelled), unlabelled)

    def above(model: Model, fitted: list[tuple[np.ndarray, float]], cuts: np.ndarray) -> tuple[np.ndarray, int]:
        schema = pa.schema([("at", pa.int64()), ("n", pa.int64())])

        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(cuts) + 1, np.int64)
            with returned_memory():
                for part in parts:
                    if not part.num_rows:
                        continue
                    half = part.column(0).to_numpy()
                    x = model.design(np.array([features(t) for t in part.column(1).to_pylist()]))
                    scores = np.where(half == 0, *(x @ w + c for w, c in fitted))
                    seen += np.bincount(np.searchsorted(cuts, scores, side="right"), minlength=len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], schema=schema)

        counts = np.zeros(len(cuts) + 1, np.int64)
        for r in texts.select(_half().alias("half"), "text").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[r["at"]] = r["n"]
        return counts[::-1].cumsum()[::-1][1:], int(counts.sum())

    return learn(p, u, prior, halves=(p_half, u_half), above=above)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None, whole_rows: bool = False) -> DataFrame:
    """The input's columns, held_out, score and predicted; with ``whole_rows`` the rows at the threshold or above, as they came."""
    model = model or train(docs, labels)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with returned_memory():
            for texts in parts:
                x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
                yield pd.Series(model.score(x))

    held = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    out = wrapped(docs, doc_id="doc_id", text="text").withColumn("score", score(text_of()))
    if whole_rows:
        return unwrapped(out.filter(F.col("score") >= threshold), docs.columns)
    return unwrapped(out, docs.columns, held_out=held, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier doesn't reject, with the input's columns."""
    return scored(docs, labels, threshold, whole_rows=True)
