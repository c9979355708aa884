from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from runout.llm import toxicity as T
from runout.llm.common import held_out

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("chunk", [2, 4, 64])
def test_marginals_against_all_labellings(monkeypatch, chunk):
    monkeypatch.setattr(T, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 9, 0, 3]
    odds, transitions = 3 * rng.normal(size=sum(lengths)), rng.normal(size=(2, 2))
    got, expected = T.marginals(odds, lengths, transitions)
    want, steps, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        o, at = odds[at : at + n], at + n
        total, ones, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in product((0, 1), repeat=n):
            w = np.exp(np.dot(o, s) + sum(transitions[a, b] for a, b in zip((0, *s), s, strict=False)))
            total, ones = total + w, ones + w * np.array(s)
            for a, b in zip((0, *s), s, strict=False):
                moves[a, b] += w
        want.extend(ones / total)
        steps += moves / total
    assert np.allclose(got, want) and np.allclose(expected, steps)
    assert T.marginals(np.empty(0), [0, 0], transitions)[0].size == 0


def test_telling_words_need_several_contexts():
    toxic = [f"copied passage w{i} idiot x{i}".split() for i in range(12)]
    clean = [f"w{i} nice x{i}".split() for i in range(200)]
    labels = T.label_tokens(toxic, clean)
    assert all(y.tolist() == [0, 0, 0, 1, 0] for y in labels)


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    test = held_out(F.col("doc_id"), 5, 0)
    found = T.score_documents(docs, labels, ~test).join(labels.where(test), "doc_id").collect()
    toxic = [r for r in found if r.toxic]
    clean = [r for r in found if not r.toxic]
    assert len(toxic) > 60
    assert sum(r.score >= 0.5 for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.score >= 0.5 for r in clean) <= 0.03 * len(clean)
    assert sum(bool(r.spans) for r in toxic) >= 0.85 * len(toxic)


def test_spans_are_offsets_of_words(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03d}")
    toxic = [(i, f"You {word(i)} Idiot {word(2 * i)}. Ünd {word(3 * i)} idiot!", 1) for i in range(1, 80)]
    clean = [(i, f"You {word(i)} nice {word(2 * i)}. Ünd {word(3 * i)} good!", 0) for i in range(80, 240)]
    df = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    for r in T.score_documents(df, df.select("doc_id", "toxic"), F.lit(True)).join(df, "doc_id").collect():
        assert (r.score >= 0.5) == bool(r.toxic)
        assert {r.text[s.start : s.end].lower() for s in r.spans} == ({"idiot"} if r.toxic else set())


def test_edge_rows(spark, edge, labels):
    got = T.score_documents(edge, labels, ~held_out(F.col("doc_id"), 5, 0)).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    flat = T.score_documents(edge, labels.where("toxic = 0"), F.lit(True)).collect()
    assert {r.score for r in flat} == {0.0} and not any(r.spans for r in flat)
    assert {r.score for r in T.score_documents(edge, labels.where("false"), F.lit(True)).collect()} == {0.0}
    assert T.score_documents(edge.where("false"), labels, F.lit(True)).count() == 0
