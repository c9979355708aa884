"""The pipeline, stage by stage, against plain Python statements of its decisions, and its stages over edge rows."""

import itertools
import random
import re
import unicodedata

import corpus_pipeline as C
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_quality_rules import brute_repeat
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

from runout.llm import quality_knn
from runout.llm.common import held_out, stored
from runout.llm.token_blocks import default_tokenizer

SMALL = "/root/testdata/sf0.001"


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def votes(model, text):
    """The share of label 1 among the nearest vectors, one cosine after the other."""
    terms = np.log1p(quality_knn.term_counts(text).astype(float)) * model.idf
    point = terms @ model.axes.astype(float)
    cosines = [float(np.dot(point, v) / (np.linalg.norm(point) or 1)) for v in model.vectors.astype(float)]
    near = sorted(zip(cosines, model.labels, strict=True), reverse=True)[: quality_knn.NEIGHBOURS]
    weights = [max(c, 0) ** quality_knn.SHARPNESS for c, _ in near]
    return sum(w for w, (_, label) in zip(weights, near, strict=True) if label) / sum(weights) if sum(weights) else model.share


def passes_rules(text):
    words, chars = text.encode().split(), len(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    return not (
        len(words) < 10
        or 100 * brute_repeat(text) > 20 * len(words)
        or 100 * sum(text.count(c) for c in "#*$%&|<>") > 4 * chars
        or 100 * sum(unicodedata.category(c) == "Lu" for c in text) > 45 * chars
        or 100 * sum(unicodedata.category(c)[0] not in "LM" and c not in " \t\n\x0b\x0c\r" for c in text) > 55 * chars
        or chars > 26 * len(words)
        or 100 * (len(lines) - len(set(lines))) > 60 * max(len(lines), 1)
    )


def windows(text, most=10):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + most]) for i in range(max(1, len(words) - most + 1))} if words else set()


def contaminated(text, benchmark):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return any(tuple(words[i : i + len(w)]) == w for w in benchmark for i in range(len(words) - len(w) + 1))


def test_run_keeps_what_plain_python_keeps(spark):
    docs, labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality_knn.train(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    left = [set(rows)]
    left.append({i for i in rows if votes(model, rows[i]) >= quality_knn.THRESHOLD})
    left.append({i for i in left[-1] if passes_rules(rows[i])})
    prints = [(i, brute_fingerprint(rows[i])) for i in sorted(left[-1])]
    left.append({i for (i, _), least in zip(prints, brute_components(prints), strict=True) if i == least})
    known = set().union(*(windows(r.text) for r in benchmark.collect()))
    left.append({i for i in left[-1] if not contaminated(rows[i], known)})
    assert all(len(a) > len(b) for a, b in itertools.pairwise(left)) and len(left[-1]) > 50

    now = docs
    for (name, stage), want in zip(C.STAGES[:-1], left[1:], strict=True):
        now = stored(stage(spark, now, SMALL))
        assert {r.doc_id for r in now.select("doc_id").collect()} == want, name
        assert now.count() == len(want) and now.schema == docs.schema
    packed = C.run(spark, SMALL).collect()
    tokens = {i: sum(r.n_tokens for r in packed if r.doc_id == i) for i in left[-1]}
    coder = Tokenizer.from_file(default_tokenizer())
    assert {r.doc_id for r in packed} == left[-1]
    assert tokens == {i: len(coder.encode(rows[i], add_special_tokens=False).ids) + 1 for i in left[-1]}


@pytest.fixture(scope="module")
def folder(spark, edge, labels, benchmark, tmp_path_factory):
    rng = random.Random(0)
    prose = [" ".join(rng.choice("the a of hill river saw walked small old".split()) + rng.choice([",", "", "", "."]) + f" n{rng.randrange(500)}" for _ in range(40)) for _ in range(30)]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(prose)], edge.select(edge.columns[:5]).schema)
    root = tmp_path_factory.mktemp("edge")
    edge.unionByName(more, allowMissingColumns=True).write.parquet(f"{root}/documents.parquet")
    labels.unionAll(spark.createDataFrame([(1000 + i, 1, 0) for i in range(30)], labels.schema)).write.parquet(f"{root}/labels.parquet")
    benchmark.write.parquet(f"{root}/benchmark.parquet")
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{table}.parquet").where("false").write.parquet(f"{root}/empty/{table}.parquet")
    return str(root)


def test_stages_take_edge_rows_and_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema == docs.schema
        assert out.count() <= docs.count()
    assert C.run(spark, folder).count() > 0


def test_empty_tables(spark, folder):
    assert C.run(spark, f"{folder}/empty").count() == 0
    assert C.ORACLE_SQL is None
