import math
import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from runout.llm import language as L
from runout.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in range(2, 8):
        code = L.codewords(n)
        assert code.shape == (n, 2 ** (n - 1) - 1)
        gaps = {int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]}
        assert gaps == {2 ** (n - 2)}
        assert all(abs(column.sum()) < n for column in code.T)
    code = L.codewords(20)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= code.shape[1] // 5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    test = held_out(F.col("doc_id"), 4, 2)
    found = L.identify(docs, ~test).join(docs.where(test).select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 150
    assert sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_edge_rows(spark, edge):
    got = L.identify(edge, ~held_out(F.col("doc_id"), 4, 2)).collect()
    texts = [r.text for r in edge.collect()]
    assert len(got) == len(texts)
    for r, text in zip(got, texts, strict=True):
        lettered = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not lettered)
        assert 0 <= r.score <= 1 and (lettered or r.score == 0)
    assert {r.lang_pred for r in L.identify(edge, F.lit(False)).collect()} == {"und"}
    assert L.identify(edge.where("false"), F.lit(True)).count() == 0


def prose(lang, i, words=12):
    rng = random.Random(f"{lang}{i}")
    letters = {"aa": "abcdefg", "mm": "hijklmn", "zz": "opqrstu"}[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(words))


def test_no_language_is_lost(spark):
    """Not beside ten thousand rows of one id, nor when all of its texts are long, nor with few documents."""
    rows = [(7, prose("aa", i), "aa") for i in range(10_000)] + [(8, prose("aa", -1), "aa")] * 5_000
    rows += [(1000 + i, prose("zz", i, 9000), "zz") for i in range(30)] + [(5000, prose("mm", 0), "mm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    sample = [r.lang for r in L.training_rows(docs, F.lit(True), 50).collect()]
    assert {x: sample.count(x) for x in set(sample)} == {"aa": 50, "zz": 30, "mm": 1}
    model = L.train(docs, F.lit(True), 50)
    assert model.languages == ["aa", "mm", "zz"]
    for lang in model.languages:
        assert all(model.predict(prose(lang, 100_000 + i), 0.1)[0] == lang for i in range(10))
    whole = L.training_rows(docs, F.lit(True)).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in whole} == {"aa": 1000, "zz": 30, "mm": 1}
    again = L.training_rows(docs.repartition(3), F.lit(True), 50)
    assert again.exceptAll(L.training_rows(docs, F.lit(True), 50)).count() == 0


def test_tasks_and_driver_learn_the_same(spark):
    rows = [(i, prose(lang, i, 3 + i % 9), lang) for lang in ("aa", "mm", "zz") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, want = L.train(docs, F.lit(True)), L.fit([(lang, t) for _, t, lang in rows])
    assert got.languages == want.languages and np.array_equal(got.weights, want.weights)
    assert np.allclose(got.slope, want.slope) and np.allclose(got.trust, want.trust)


def decoded(model, text):
    """Grams counted and codewords compared one by one."""
    clean = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    clean = re.sub(" +", " ", clean).lstrip(" ")  # a last character that is no letter ends the text with two blanks
    if not clean:
        return "und", 0.0
    points = [ord(c) for c in f" {clean} "]
    mask, margins, n = 0xFFFFFFFF, [0.0] * model.code.shape[1], 0
    for i in range(len(points) - 2):
        a, b, c = points[i : i + 3]
        two = (a * 2654435761 + b * 2246822519) & mask
        for bucket in (two >> 16, (((two + c * 3266489917) & mask) * 2654435761 & mask) >> 16):
            n += 1
            margins = [m + float(w) for m, w in zip(margins, model.weights[bucket], strict=True)]
    margins = [s * m / math.sqrt(n + 4) + o for s, m, o in zip(model.slope, margins, model.offset, strict=True)]
    losses = [
        sum(t * math.log1p(math.exp(-bit * m)) for t, bit, m in zip(model.trust, word, margins, strict=True))
        for word in model.code.tolist()
    ]
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    return model.languages[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_decoding_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 2000").limit(300)
    model = L.train(docs, ~held_out(F.col("doc_id"), 4, 2))
    texts = [r.text for r in docs.limit(60).collect()] + ["", "12 ?!", "a", "Ää Öö 中文", "the der la el", " x  y "]
    for text in texts:
        lang, score, _ = model.predict(text, 0.5)
        want, share = decoded(model, text)
        assert lang == want and math.isclose(score, share, rel_tol=1e-6, abs_tol=1e-9)


def test_one_language_and_ambiguity():
    assert L.fit([("en", "some text")]).predict("anything", 0.5) == ("en", 1.0, False)
    model = L.fit([("aa", "kaka lala"), ("bb", "momo nono"), ("cc", "riri sisi")] * 5)
    assert model.predict("kaka", 0.01)[0] == "aa" and model.predict("nono momo", 0.01)[0] == "bb"
    assert model.predict("xyz", 50.0)[2]


def test_pieces_of_long_texts_join_up(monkeypatch):
    text = "Lorem ipsum dolor sit amet 123 " * 40
    whole = sorted(h for piece in L.grams(text) for h in piece.tolist())
    monkeypatch.setattr(L, "PIECE", 7)
    assert sorted(h for piece in L.grams(text) for h in piece.tolist()) == whole
