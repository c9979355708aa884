"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The labels mark documents, not words. Tokens are labelled first: a word, or a word beginning of three to
seven letters, is telling if its log-odds between toxic and clean training documents exceed
``TELLING``; occurrences are counted by distinct preceding word, so that copied text counts once. Telling
words in toxic documents are labelled 1, all other tokens 0.

The field has two states per token; its weights belong to the word, its beginnings and the transitions,
fitted by adaptive gradient steps on the exact log-likelihood. Forward-backward runs over the whole
text: tokens are cut into chunks whose 2x2 transfer matrices are multiplied first, so that all chunks of a
batch are worked on together and a very long text needs no more steps than a short one.

The score of a document is a logistic function of its expected number of toxic tokens and its largest
marginal, fitted on the training documents weighted to the class sizes of the table. Tokens with a
marginal of one half or more are returned as character offsets.

Training takes at most ``TRAIN_DOCS`` labelled documents per class of at most ``TRAIN_CHARS`` characters.
Defined results: null, empty and wordless texts have no tokens and get the score of that; without both
classes to learn from every score is the share of label 1 (0 without labels); ties and repeated rows get
equal scores; rows without an id are never learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from runout.llm.common import arrow_schema, class_counts, labelled_sample, ship, slices

#: Bound of the training sample.
TRAIN_DOCS = 1000
TRAIN_CHARS = 50_000
#: Log-odds and distinct contexts from which a word or beginning is telling.
TELLING, CONTEXTS = 3.5, 5
STEPS = 30
CHUNK = 64
#: Distinct words whose emission a worker keeps.
CACHED_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_LIMIT = 18.0


def features(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    word = word.lower()
    return [f"{word}$", *(word[:n] for n in range(3, 8) if len(word) >= n)]


def marginals(
    odds: np.ndarray, lengths: Sequence[int], transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every token, and the expected number of each transition (from state, to state).

    ``odds``: emission log-odds of the texts' tokens, one after the other. A clean token stands before
    the first of every text.
    """
    n = np.asarray(lengths, np.int64)
    per_text = -(-n // CHUNK)
    n_chunks = int(per_text.sum())
    if not n_chunks:
        return np.empty(0), np.zeros((2, 2))
    first = np.cumsum(per_text) - per_text
    text_of = np.repeat(np.arange(len(n)), per_text)
    inside = np.arange(n_chunks) - first[text_of]
    begin = (np.cumsum(n) - n)[text_of] + inside * CHUNK
    size = np.minimum(n[text_of] - inside * CHUNK, CHUNK)
    steps = np.arange(CHUNK)[:, None]
    valid = steps < size
    places = np.where(valid, begin + steps, 0)
    o = np.exp(np.clip(odds, -_LIMIT, _LIMIT))[places]
    t = np.exp(transitions)

    def forward(a0, a1, k):
        b0, b1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * o[k]
        z = b0 + b1
        return np.where(valid[k], b0 / z, a0), np.where(valid[k], b1 / z, a1), z

    rows = []  # each row of a chunk's transfer matrix, up to its own scale
    for start in ((1.0, 0.0), (0.0, 1.0)):
        a0, a1, scale = np.full(n_chunks, start[0]), np.full(n_chunks, start[1]), np.zeros(n_chunks)
        for k in range(CHUNK):
            a0, a1, z = forward(a0, a1, k)
            scale += np.where(valid[k], np.log(z), 0)
        rows.append((a0, a1, scale))
    least = np.maximum(rows[0][2], rows[1][2])
    weight = [np.exp(r[2] - least) for r in rows]
    transfer = np.array([[r[0] * w, r[1] * w] for r, w in zip(rows, weight, strict=True)])

    enter, leave = np.zeros((2, n_chunks)), np.zeros((2, n_chunks))
    enter[0, first[per_text > 0]] = 1  # before the first token stands a clean one
    last = first + per_text - 1
    leave[:, last[per_text > 0]] = 1
    for j in range(1, int(per_text.max())):
        at = first[per_text > j] + j
        a = (enter[:, None, at - 1] * transfer[:, :, at - 1]).sum(axis=0)
        enter[:, at] = a / a.sum(axis=0)
        back = last[per_text > j] - j
        b = (transfer[:, :, back + 1] * leave[None, :, back + 1]).sum(axis=1)
        leave[:, back] = b / b.sum(axis=0)

    alpha = np.empty((CHUNK, 2, n_chunks))
    a0, a1 = enter
    for k in range(CHUNK):
        a0, a1, _ = forward(a0, a1, k)
        alpha[k] = a0, a1
    out, expected = np.empty(len(odds)), np.zeros((2, 2))
    b0, b1 = leave
    for k in range(CHUNK - 1, -1, -1):
        on = valid[k]
        p0, p1 = alpha[k, 0] * b0, alpha[k, 1] * b1
        out[places[k, on]] = (p1 / (p0 + p1))[on]
        previous = alpha[k - 1] if k else enter
        both = previous[:, None, :] * t[:, :, None] * np.stack([b0, o[k] * b1])[None]
        expected += (both / both.sum(axis=(0, 1)))[:, :, on].sum(axis=2)
        c0, c1 = t[0, 0] * b0 + t[0, 1] * o[k] * b1, t[1, 0] * b0 + t[1, 1] * o[k] * b1
        z = c0 + c1
        b0, b1 = np.where(on, c0 / z, b0), np.where(on, c1 / z, b1)
    return out, expected


def label_tokens(toxic: list[list[str]], clean: list[list[str]]) -> list[np.ndarray]:
    """Token labels of the toxic documents, by telling words and beginnings."""

    def contexts(docs: Iterable[list[str]]) -> Counter:
        seen = {(before, f) for words in docs for before, word in zip(["", *words], words) for f in features(word)}
        return Counter(f for _, f in seen)

    bad, good = contexts(toxic), contexts(clean)
    n_bad = sum(c for f, c in bad.items() if f[-1] == "$") or 1
    n_good = sum(c for f, c in good.items() if f[-1] == "$") or 1
    telling = {
        f
        for f, c in bad.items()
        if c >= CONTEXTS and np.log((c + 0.5) / n_bad) - np.log((good[f] + 0.5) / n_good) > TELLING
    }
    return [np.array([any(f in telling for f in features(w)) for w in words], float) for words in toxic]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    score: np.ndarray | None  # of (1, log expected toxic tokens, log-odds of the largest marginal)
    share: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.emission(w)
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def token_marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        lengths = [len(d) for d in docs]
        odds = np.concatenate([self.emissions(d) for d in docs]) if docs else np.empty(0)
        p, _ = marginals(odds, lengths, self.transitions)
        return np.split(p, np.cumsum(lengths)[:-1]) if docs else []

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        if self.score is None:
            return np.full(len(found), self.share)
        return 1 / (1 + np.exp(-np.clip(_summary(found) @ self.score, -30, 30)))


def _summary(found: list[np.ndarray]) -> np.ndarray:
    most = np.clip([p.max(initial=0) for p in found], 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(found)), np.log([p.sum() + 1e-2 for p in found]), np.log(most / (1 - most))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    theta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(theta))
        theta -= np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 0.1 * theta), -2, 2)
    return theta


def fit(rows: list[tuple[str, int]], counts: tuple[int, int]) -> Model:
    """A model from (text, label) rows; ``counts``: labelled rows of the table per class."""
    docs = [(_WORD.findall(text), label) for text, label in sorted(rows)]
    toxic, clean = [w for w, label in docs if label], [w for w, label in docs if not label]
    share = counts[1] / max(1, sum(counts))
    flat = Model({}, -_LIMIT, np.zeros((2, 2)), None, share)
    if not toxic or not clean:
        return flat
    labels = np.concatenate([*label_tokens(toxic, clean), *(np.zeros(len(d)) for d in clean)])
    words = [w for d in (*toxic, *clean) for w in d]
    lengths = [len(d) for d in (*toxic, *clean)]
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    token = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    support = Counter(f for w in distinct for f in features(w))
    support.update(f for w, y in zip(words, labels, strict=True) if y for f in features(w))
    place = {f: i for i, f in enumerate(sorted(f for f, n in support.items() if n >= 3))}
    pairs = np.array([(i, place[f]) for w, i in distinct.items() for f in features(w) if f in place] or [(0, 0)])
    weights, bias, transitions = _fit_field(token, labels, lengths, pairs, len(distinct), len(place) or 1)
    found = Model({f: float(weights[i]) for f, i in place.items() if weights[i]}, bias, transitions, None, share)
    x = _summary(found.token_marginals([*toxic, *clean]))
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    weight = np.where(y == 1, counts[1] / len(toxic), counts[0] / len(clean)) * len(y) / sum(counts)
    found.score = _logistic(x, y, weight)
    return found


def _fit_field(
    token: np.ndarray, labels: np.ndarray, lengths: list[int], pairs: np.ndarray, n_words: int, n_features: int
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions after adaptive gradient steps on the regularised likelihood."""
    theta, squares = np.zeros(n_features + 5), np.full(n_features + 5, 1e-6)
    theta[n_features] = -3.0
    state = labels.astype(np.int64)
    before = np.append(0, state[:-1])
    before[np.cumsum([0, *lengths[:-1]])[np.array(lengths) > 0]] = 0
    observed = np.bincount(2 * before + state, minlength=4)
    for _ in range(STEPS):
        word = np.bincount(pairs[:, 0], weights=theta[pairs[:, 1]], minlength=n_words)
        odds = word[token] + theta[n_features]
        p, expected = marginals(odds, lengths, theta[n_features + 1 :].reshape(2, 2))
        by_word = np.bincount(token, weights=p - labels, minlength=n_words)
        gradient = np.bincount(pairs[:, 1], weights=by_word[pairs[:, 0]], minlength=n_features + 5)
        gradient[n_features] = by_word.sum()
        gradient[n_features + 1 :] = expected.ravel() - observed
        gradient += 0.05 * theta
        squares += gradient**2
        theta -= 0.5 * gradient / np.sqrt(squares)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = TRAIN_DOCS) -> DataFrame:
    """Per document: doc_id, score and the offending spans (start, end), learned where ``learn`` holds."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled_sample(docs, labels, "toxic", learn, per_class, TRAIN_CHARS).collect()
    counts = class_counts(labels, "toxic", learn)
    model = spark.sparkContext.broadcast(fit([tuple(r) for r in rows], counts))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, score double, spans array<struct<start: long, end: long>>"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = model.value.token_marginals([_WORD.findall(t) for t in texts])
            spans = [
                [{"start": m.start(), "end": m.end()} for m, x in zip(_WORD.finditer(t), p) if x >= 0.5]
                if p.max(initial=0) >= 0.5
                else []
                for t, p in zip(texts, found, strict=True)
            ]
            columns = [batch.column(0).cast(schema[0].type), pa.array(model.value.scores(found))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, schema[2].type)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
