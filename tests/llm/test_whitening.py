import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runout.llm import whitening as W

SMALL = "/root/testdata/sf0.01"


def brute(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    apart = [[int(n) * int(v) - int(t) for v, t in zip(row, s, strict=True)] for row in x]
    centred = np.array(apart, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return centred, [sum(v * v for v in row) for row in apart], values[::-1], axes[:, ::-1]


def test_rows_are_those_of_an_eigendecomposition(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    centred, deviation, values, axes = brute(list(vectors.values()))
    got = W.whiten_table(table).collect()
    assert len(got) == 32 * len(vectors)
    by_place = {(r.vec_id, r.component): r for r in got}
    for k in range(32):
        want = centred @ axes[:, k] / np.sqrt(values[k])
        rows = [by_place[i, k + 1] for i in vectors]
        found = np.array([r.whitened for r in rows])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-8
        assert {r.n for r in rows} == {len(vectors)} and [r.deviation for r in rows] == deviation
        assert abs(rows[0].explained / (values[k] / values.sum()) - 1) < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("d", [1, 2, 5, 24])
def test_factor_and_rotations(d):
    rng = np.random.default_rng(d)
    for rank in {1, max(1, d // 2), d}:
        rows = rng.normal(size=(50, rank)) @ rng.normal(size=(rank, d)) * rng.uniform(0.01, 100, d)
        scatter = rows.T @ rows
        factor = W.pivoted_cholesky(scatter)
        assert factor.shape == (d, rank)
        assert np.allclose(factor @ factor.T, scatter, rtol=1e-9, atol=1e-9 * scatter.max())
        order = np.argsort((factor == 0).sum(axis=1), kind="stable")[::-1]
        assert not np.triu(factor[order], 1).any()  # a triangle but for the order of its rows
        values, axes = W.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-8)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-9)
    assert W.pivoted_cholesky(np.zeros((d, d))).shape == (d, 0)


def test_every_pair_meets_once():
    for n in range(9):
        pairs = [(a, b) for i, j in W._rounds(n) for a, b in zip(i, j, strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        assert all(len({*i, *j}) == 2 * len(i) for i, j in W._rounds(n))


def test_edge_rows(spark):
    rng = random.Random(5)
    good = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(40)]
    good += [(None, [0.5, 0.25, -1.0]), (3, good[3][1]), (3, [0.0, 0.0, 0.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0])]
    bad += [(55, [1.0, 2.0]), (56, [1.0, 2.0, 3.0, 4.0]), (57, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    df = df.withColumns({"n": F.lit("x"), "component": F.lit(1), "vector": F.lit(2), "place": F.lit(None)})
    centred, deviation, values, axes = brute([v for _, v in good])
    got = W.whiten_table(df).collect()
    assert len(got) == 3 * len(good) and {r.n for r in got} == {len(good)}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    want = np.sort(np.abs(centred @ axes[:, 0] / np.sqrt(values[0])))
    assert np.allclose(np.sort([abs(r.whitened) for r in got if r.component == 1]), want)


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<float>")
    got = W.whiten_table(df).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert sorted({round(r.whitened, 9) for r in got}) == [-1, 1]
    for none in (df.where("vec_id = 0"), df.where("false"), df.where("vec_id % 2 = 0")):
        found = W.whiten_table(none)
        assert found.count() == 0 and found.columns == W.whiten_table(df).columns


def test_a_deviation_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [6e13]), (1, [-6e13])], "vec_id long, embedding array<double>")
    assert W.whiten_table(df.where("vec_id = 0")).count() == 0
    with pytest.raises(Exception, match="deviation exceeds a long"):
        W.whiten_table(df).collect()
