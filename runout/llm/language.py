"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit one binary classifier tells the languages with that bit from
the others by the log-odds of hashed character 2- and 3-grams (naive Bayes, the languages of a side
weighing equally), with a slope and offset fitted by logistic regression. Decoding adds, for every
codeword, the logistic losses of all bits, each weighted by how well its classifier did in training, and
takes the language of least loss. The score is the softmax of the negated losses; a text whose two best
codewords lie closer than ``margin`` is flagged as ambiguous.

Up to seven languages the code is exhaustive (all splits, 2^(L-1) - 1 bits, any two words half the bits
apart); beyond, the best of some seeded random codes. Training takes at most ``TRAIN_DOCS`` different
documents per language, those whose hash of id and text is lowest; each language has its own, so no language
is lost beside a larger one. Texts are read whole, however long, by tasks: the driver gets counts of grams per
language and, for the regressions, one number a bit and document.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; so is
every text if there is nothing to learn from; with one language learned every text with a letter has it,
with score 1; rows without an id are not learned from and count as held out; ties go to the language that
sorts first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runout.llm.common import arrow_schema, ship, slices, stored

#: Bound of the training sample, per language.
TRAIN_DOCS = 1000
BUCKETS = 1 << 16
PIECE = 1 << 20

_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed 2- and 3-grams of the lower-cased letters and word ends, in pieces; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    letter = _letter_table()[points]
    if not letter.any():
        return
    points = np.where(letter, points, 32).astype(np.uint32)
    blank = points == 32
    points = np.concatenate(([32], points[~(blank & np.append(True, blank[:-1]))], [32])).astype(np.uint32)
    for i in range(0, len(points) - 2, PIECE):
        p = points[i : i + PIECE + 2]
        two = p[:-1] * _A + p[1:] * _B
        yield two[:-1] >> 16
        yield (two[:-1] + p[2:] * _C) * _A >> 16


def codewords(languages: int, seed: int = 0) -> np.ndarray:
    """A row of +1 and -1 per language."""
    if languages <= 7:
        bits = np.arange(max(1, 2 ** (languages - 1) - 1))
        rest = [(bits >> i & 1) * 2 - 1 for i in range(languages - 1)]
        return np.array([np.ones(len(bits), int), *rest])
    rng, n = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (languages, n))
        apart = (n - code @ code.T) // 2 + n * np.eye(languages, dtype=int)
        if apart.min() > distance and (np.abs(code.sum(axis=0)) < languages).all():
            best, distance = code, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log-odds
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def margins(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(self.code.shape[1]), 0
        for piece in grams(text):
            total += self.weights[piece].sum(axis=0, dtype=np.float64)
            n += len(piece)
        return self.slope * total / np.sqrt(n + 4) + self.offset if n else None

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not self.languages:
            return "und", 0.0, False
        margins = self.margins(text)
        if margins is None:
            return "und", 0.0, False
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(axis=1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best, *rest = np.argsort(loss, kind="stable").tolist()
        close = bool(rest) and bool(loss[rest[0]] - loss[best] < margin)
        return self.languages[best], float(share[best]), close


def _slope_and_offset(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y (0 or 1) on z by Newton steps, with a small ridge."""
    theta, x = np.zeros(2), np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.02 * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(theta[0]), float(theta[1])


def bare_model(counts: dict[str, np.ndarray]) -> Model:
    """Log-odds of the grams for every bit, from counts of grams per language; languages sort by name."""
    languages = sorted(counts)
    code = codewords(len(languages)) if languages else np.zeros((0, 0), int)
    bits = code.shape[1]
    plain = (np.ones(bits), np.zeros(bits), np.ones(bits))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, bits), np.float32), *plain)
    shares = np.stack([counts[lang] for lang in languages]) + 0.1
    shares /= shares.sum(axis=1, keepdims=True)
    on = code > 0
    sides = [(shares.T @ side) / side.sum(axis=0) for side in (on.astype(float), (~on).astype(float))]
    return Model(languages, code, np.log(sides[0] / sides[1]).astype(np.float32), *plain)


def calibrated(bare: Model, scored: list[tuple[str, np.ndarray]]) -> Model:
    """Slopes, offsets and trust of the bits from (language, bare margins) of the training documents."""
    if len(bare.languages) < 2 or not scored:
        return bare
    place = {lang: i for i, lang in enumerate(bare.languages)}
    y = np.array([place[lang] for lang, _ in scored])
    z = np.array([m for _, m in scored])
    on = bare.code > 0
    weight = 1 / np.bincount(y, minlength=len(place))[y]
    fitted = [_slope_and_offset(z[:, b], on[y, b].astype(float), weight) for b in range(z.shape[1])]
    slope, offset = map(np.array, zip(*fitted, strict=True))
    right = ((z * slope + offset > 0) == on[y]).astype(float)
    accuracy = (right * weight[:, None]).sum(axis=0) / weight.sum()
    trust = np.maximum(2 * accuracy - 1, 0.01)
    return Model(bare.languages, bare.code, bare.weights, slope, offset, trust / trust.mean())


def gram_counts(rows: Iterable[tuple[str, str]]) -> dict[str, np.ndarray]:
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        total = counts.setdefault(lang, np.zeros(BUCKETS))
        for piece in grams(text):
            total += np.bincount(piece, minlength=BUCKETS)
    return counts


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows."""
    bare = bare_model(gram_counts(rows))
    return calibrated(bare, [(lang, m) for lang, t in rows if (m := bare.margins(t)) is not None])


def training_rows(docs: DataFrame, learn: Column, docs_per_language: int = TRAIN_DOCS) -> DataFrame:
    """(lang, lot, text) of a bounded number of different labelled documents per language.

    The lot is a hash of id and text, so copies are one document. Few lots pass the first filter in a large
    language and all do in a small one; the lowest of those that pass are counted off per language.
    """
    known = [F.col(c).isNotNull() for c in ("lang", "text", "doc_id")]
    rows = docs.where(learn & known[0] & known[1] & known[2])
    rows = rows.select("lang", F.xxhash64("doc_id", "text", F.lit("language")).alias("lot"), "text")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("lot").alias("n")).collect()
    if not sizes:
        return rows
    share = F.create_map(*(F.lit(v) for r in sizes for v in (r.lang, min(1.0, 4 * docs_per_language / max(1, r.n)))))
    place = F.pmod(F.col("lot"), F.lit(1 << 30)) / float(1 << 30)
    passed = rows.where(place < F.element_at(share, F.col("lang")))
    lowest = Window.partitionBy("lang").orderBy(place, "lot")
    chosen = passed.select("lang", "lot").distinct().withColumn("nth", F.row_number().over(lowest))
    chosen = chosen.where(F.col("nth") <= docs_per_language).select("lang", "lot")
    # bounded: docs_per_language rows of a name and a number per language
    found = passed.join(F.broadcast(chosen), ["lang", "lot"])
    return found.groupBy("lang", "lot").agg(F.first("text").alias("text"))


def train(docs: DataFrame, learn: Column, docs_per_language: int = TRAIN_DOCS) -> Model:
    """The model of a bounded sample of the rows where ``learn`` holds."""
    spark = docs.sparkSession
    ship(spark)
    rows = stored(training_rows(docs, learn, docs_per_language).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = gram_counts(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for lang, total in found.items():
                bucket = np.flatnonzero(total)
                columns = [pa.array([lang] * len(bucket)), pa.array(bucket), pa.array(total[bucket].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])
            if not found:
                continue
            # a language whose texts have no gram is known as well
            columns = [pa.array(list(found)), pa.array([0] * len(found)), pa.array([0] * len(found))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    totals = rows.mapInArrow(count, "lang string, bucket long, n long")
    totals = totals.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    langs = np.array(totals.column("lang").to_pylist(), object)
    for lang in set(langs):
        counts[lang] = np.zeros(BUCKETS)
        mine = langs == lang
        counts[lang][totals.column("bucket").to_numpy()[mine]] = totals.column("n").to_numpy()[mine]
    shared = spark.sparkContext.broadcast(bare_model(counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            margins = [shared.value.margins(t) for t in batch.column(1).to_pylist()]
            margins = pa.array([None if m is None else m.tolist() for m in margins], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), margins], names=["lang", "margins"])

    found = rows.mapInArrow(score, "lang string, margins array<double>").where("margins IS NOT NULL").collect()
    return calibrated(shared.value, sorted((r.lang, tuple(r.margins)) for r in found))


def identify(docs: DataFrame, learn: Column, margin: float = 0.5) -> DataFrame:
    """Per document: doc_id, lang_pred, score and ambiguous, learned from the rows where ``learn`` holds."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, learn))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [model.value.predict(t, margin) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), *columns], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
