"""Quality by voting of the nearest labelled documents in a latent-semantic space.

Terms are the words, lower-cased and hashed to ``WORD_TERMS`` buckets, the trigrams of character classes
(lower and upper case letters, digits, line feeds, spaces, stops, commas, marks, brackets, bars, symbols ...)
and two counts of repeated words. The words carry the subject; the classes tell prose from lists, shouting
and noise in any language. Logarithmic term frequencies are weighted by inverse document frequency, and the
leading singular vectors of the training rows span the latent space.

The labelled vectors are broadcast: at most ``TRAIN_DOCS`` per class of ``DIMENSIONS`` numbers, 0.6 MB.
For every document, in blocks, the cosine with every labelled vector is computed; the ``NEIGHBOURS``
nearest vote with the ``SHARPNESS``-th power of their similarity, and the score is the share of label 1.

Features of the training rows are computed where the rows are, over whole texts; what reaches the driver is
bounded by the number of rows and terms. Defined results: null and empty texts have no terms, so no
neighbour has a similarity and the score is the share of label 1 among the labelled vectors (0 without
labels); the same if nothing is similar; labelled rows as near as the last neighbour
all vote; repeated rows get equal scores; rows without an id are never learned from.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from runout.llm.common import arrow_schema, labelled_sample, ship, slices

#: Bounds and sizes of the model.
TRAIN_DOCS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8
THRESHOLD = 0.7
BLOCK = 256
WORD_TERMS = 2048
SHAPE_TERMS = 16**3
TERMS = SHAPE_TERMS + WORD_TERMS + 2

_PLAIN = {"\n": 4, ".": 6, ",": 7, "!": 8, "?": 8, "|": 10}
_classes: list[np.ndarray] = []


def _class_of(c: int) -> int:
    char = chr(c)
    if char in _PLAIN:
        return _PLAIN[char]
    kind = unicodedata.category(char)
    if char.isspace():
        return 5
    if char in "#*$%&<>@^~=+_/\\{}":
        return 11
    return {"Lu": 2, "Lt": 2, "Nd": 3}.get(kind, {"L": 1, "N": 3, "P": 9, "M": 12, "S": 13}.get(kind[0], 14))


def _class_table() -> np.ndarray:
    if not _classes:
        _classes.append(np.fromiter(map(_class_of, range(0x110000)), np.uint8, 0x110000))
    return _classes[0]


def term_counts(text: str | None) -> np.ndarray:
    """How often each term occurs in a whole text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    kinds = _class_table()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    kinds = np.concatenate((np.array([5], np.uint8), kinds, np.array([5], np.uint8))).astype(np.int32)
    out[:SHAPE_TERMS] = np.bincount((kinds[:-2] * 16 + kinds[1:-1]) * 16 + kinds[2:], minlength=SHAPE_TERMS)
    words = text.split()
    buckets = [zlib.crc32(w) % WORD_TERMS for w in text.lower().encode().split()]
    out[SHAPE_TERMS:-2] = np.bincount(np.array(buckets, np.int64), minlength=WORD_TERMS)
    out[-2] = sum(map(str.__eq__, words, words[1:]))
    out[-1] = len(words) - len(set(words))
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    labels: np.ndarray
    share: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Rows of term counts as latent vectors of length 1, or 0 for rows without terms."""
        rows = (np.log1p(counts) * self.idf) @ self.axes
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-6)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.share)
        cosine = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(cosine, -k, axis=1)[:, -k, None]
        weight = np.where(cosine >= least, np.maximum(cosine, 0), 0).astype(np.float64) ** SHARPNESS
        total, vote = weight.sum(axis=1), weight @ self.labels
        return np.clip(np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.share), 0, 1)


def _axes(rows: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of the rows, by subspace iteration from a seeded start.

    Some more directions than asked for are iterated, which makes those asked for settle quickly; neither
    product of the rows with themselves is formed.
    """
    width = min(*rows.shape, dimensions + 16)
    span = np.random.default_rng(0).normal(size=(rows.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        span = np.linalg.qr(rows.T @ (rows @ span))[0]
    _, values, right = np.linalg.svd(rows @ span, full_matrices=False)
    kept = values[:dimensions] > 1e-5 * max(values.max(initial=0), 1e-9)
    return (span @ right[:dimensions].T)[:, kept]


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """A model from rows of term counts and their 0/1 labels; rows are sorted, so their order is free."""
    used = np.flatnonzero(counts.any(axis=0))
    order = np.lexsort((labels, *counts[:, used[:8]].T, counts.sum(axis=1)))
    rows, labels = counts[order], labels[order].astype(np.float64)
    del counts
    n, terms = rows.shape
    idf = (np.log((1 + n) / (1 + np.count_nonzero(rows, axis=0))) + 0.1).astype(np.float32)
    np.log1p(rows, out=rows)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    axes = _axes(rows, dimensions) if len(used) else np.zeros((terms, 1), np.float32)
    share = float(labels.mean()) if n else 0.0
    vectors = rows @ axes
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 1e-6)
    return Model(idf, axes, vectors, labels, share)


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``per_class`` rows per class, their terms counted by the executors."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [term_counts(t) for t in batch.column(0).to_pylist()]
            places = [np.flatnonzero(r) for r in rows]
            values = [r[p] for r, p in zip(rows, places, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), batch.column(1)],
                names=["places", "counts", "label"],
            )

    sample = labelled_sample(docs, labels, "quality", learn, per_class)
    found = sample.mapInArrow(run, "places array<int>, counts array<float>, label int").toArrow()
    found = found.combine_chunks()
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    if found.num_rows:
        places, values = (found.column(c).chunk(0) for c in ("places", "counts"))
        row = np.repeat(np.arange(found.num_rows), np.diff(places.offsets))
        counts[row, places.flatten()] = values.flatten()
    return fit(counts, found.column("label").to_numpy())


def _scores(model: Model, texts: list[str | None]) -> np.ndarray:
    blocks = (texts[i : i + BLOCK] for i in range(0, len(texts), BLOCK))
    return np.concatenate([model.scores(np.stack([term_counts(t) for t in b])) for b in blocks])


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Per document: doc_id and score, learned from the labels of rows where ``learn`` holds."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, learn))
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = _scores(model.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), pa.array(scores)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def drop_rejected(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; all rows without labels."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn))
    if not len(model.value.labels):
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(_scores(model.value, batch.column(place).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
