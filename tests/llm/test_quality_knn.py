import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runout.llm import quality_knn as K
from runout.llm.common import held_out

FOLDER = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    test = held_out(F.col("doc_id"), 4, 2)
    found = K.score_documents(docs, labels, ~test).join(labels.where(test), "doc_id").collect()
    good, bad = [r for r in found if r.quality], [r for r in found if not r.quality]
    assert len(bad) > 80
    assert sum(r.score >= K.THRESHOLD for r in good) >= 0.99 * len(good)
    assert sum(r.score < K.THRESHOLD for r in bad) >= 0.96 * len(bad)


def test_votes_are_those_of_the_nearest_rows(monkeypatch):
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.01, (60, K.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    model = K.fit(counts, labels)
    queries = rng.poisson(0.01, (7, K.TERMS)).astype(np.float32)
    got = model.scores(queries)
    for q, score in zip(model.embed(queries), got, strict=True):
        cosine = model.vectors @ q
        near = np.argsort(-cosine)[: K.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0).astype(float) ** K.SHARPNESS
        assert np.isclose(score, (weight * model.labels[near]).sum() / weight.sum(), atol=1e-4)


@pytest.mark.parametrize(("n", "terms"), [(5, 40), (40, 5), (30, 30)])
def test_axes_are_singular_vectors(n, terms):
    rows = np.random.default_rng(n).normal(size=(n, terms)).astype(np.float32)
    got, want = K._axes(rows, 4), np.linalg.svd(rows)[2][:4]
    assert np.allclose(np.abs(np.sum(got.T * want, axis=1)), 1, atol=1e-3)
    assert K._axes(np.zeros((3, 7), np.float32), 4).shape[0] == 7


@pytest.mark.parametrize("kept", ["all", "words", "shapes"])
def test_words_alone_and_shapes_alone_say_less(spark, monkeypatch, kept):
    """What the README says of the two kinds of terms, on held-out rows."""
    whole = K.term_counts

    def some(text):
        out = whole(text)
        if kept == "words":
            out[: K.SHAPE_TERMS] = out[-2:] = 0
        elif kept == "shapes":
            out[K.SHAPE_TERMS : -2] = 0
        return out

    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").where("quality IS NOT NULL").collect()
    test = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]
    learned = [r for r, t in zip(rows, test, strict=True) if not t]
    bad = [r for r in learned if not r.quality]
    learned = bad[: K.TRAIN_DOCS] + [r for r in learned if r.quality][: K.TRAIN_DOCS]
    model = K.fit(np.stack([some(r.text) for r in learned]), np.array([r.quality for r in learned]))
    tested = [r for r, t in zip(rows, test, strict=True) if t]
    scores = np.concatenate([model.scores(np.stack([some(r.text) for r in tested[i : i + 200]])) for i in range(0, len(tested), 200)])
    quality = np.array([r.quality for r in tested])
    good, rejected = (scores[quality == 1] >= K.THRESHOLD).mean(), (scores[quality == 0] < K.THRESHOLD).mean()
    print(f"{kept}: kept {good:.4f} of the good, rejected {rejected:.4f} of the bad held-out rows")
    least = {"all": (0.99, 0.97), "shapes": (0.99, 0.97), "words": (0.98, 0.7)}[kept]
    assert good >= least[0] and rejected >= least[1]


def test_terms_are_counted_over_whole_texts():
    counts = K.term_counts("a b b b" + " Zz1\n" * 3)
    assert counts[-2] == 4 and counts[-1] == 4  # repeats next to each other, repeats at all
    assert counts[: K.SHAPE_TERMS].sum() == len("a b b b" + " Zz1\n" * 3)
    words = counts[K.SHAPE_TERMS : -2]
    assert words.sum() == 7 and words[zlib.crc32(b"b") % K.WORD_TERMS] == 3 and words[zlib.crc32(b"zz1") % K.WORD_TERMS] == 3
    assert not K.term_counts(None).any() and not K.term_counts("").any()


def test_edge_rows(spark, edge, labels):
    got = K.score_documents(edge, labels, ~held_out(F.col("doc_id"), 4, 2)).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in K.score_documents(edge, labels.where("false"), F.lit(True)).collect()} == {0.0}
    assert K.score_documents(edge.where("false"), labels, F.lit(True)).count() == 0
    kept = K.drop_rejected(edge, labels, F.lit(True))
    assert kept.columns == edge.columns
    assert K.drop_rejected(edge, labels.where("false"), F.lit(True)).count() == edge.count()
