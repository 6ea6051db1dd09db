"""Whitening against plain exact fractions and the definition of its columns."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from galespark.llm import queries, whitening

TABLE = "vec_id bigint, embedding array<double>, vector string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], TABLE)


def covariance(matrix):
    n, d = matrix.shape
    x = [[int(c) for c in row] for row in matrix]
    s = [sum(r[j] for r in x) for j in range(d)]
    return np.array([[float(sum(Fraction(n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / Fraction(n) ** 3) for j in range(d)] for i in range(d)])


def check(got, vectors, k):
    """``got``: {(vec_id, component): row} of vectors {vec_id: list}."""
    x = np.array([np.floor(np.array(v) * 1024).astype(np.int64) + 100_000 for v in vectors.values()])
    n, s = len(x), [int(c) for c in x.sum(axis=0)]
    v = covariance(x)
    values = np.linalg.eigvalsh(v)[::-1]
    assert set(got) == {(i, c + 1) for i in vectors for c in range(k)}
    white = np.array([[got[i, c + 1].whitened for c in range(k)] for i in vectors])
    for i, row in zip(vectors, x):
        deviation = sum((n * int(a) - b) ** 2 for a, b in zip(row, s))
        assert {(got[i, c + 1].n, got[i, c + 1].deviation) for c in range(k)} == {(n, deviation if deviation < 1 << 63 else None)}
    for c in range(k):
        assert all(got[i, c + 1].explained == pytest.approx(values[c] / np.trace(v), rel=1e-9) for i in vectors)
    centred = x - np.array([b / n for b in s])
    axes = np.linalg.lstsq(centred, white * np.sqrt(values[:k]), rcond=None)[0]  # what the rows were projected on
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-9) and np.allclose(v @ axes, axes * values[:k], atol=1e-7 * values[0])
    error = np.abs(np.cov(white.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert error < 1e-9 and {r.identity_error < 1e-9 for r in got.values()} == {True} and len({r.identity_error for r in got.values()}) == 1


def collected(df):
    rows = df.collect()
    assert len({(r.vec_id, r.component) for r in rows}) == len(rows)
    return {(r.vec_id, r.component): r for r in rows}


def test_covariance_by_plain_fractions(spark):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.normal(size=5) * [1, 2, 30, 0.1, 5]).tolist() for i in range(60)}
    model = whitening.fit(whitening.rows_of(frame(spark, vectors.items()), "vec_id", "embedding"))
    x = np.array([np.floor(np.array(v) * 1024) + 100_000 for v in vectors.values()])
    assert np.array_equal(model.covariance, covariance(x))  # exact up to the last rounding
    check(collected(whitening.whiten(frame(spark, vectors.items()))), vectors, 5)


def test_large_entries_stay_exact(spark):
    rng = random.Random(2)
    vectors = {i: [rng.uniform(-1, 1) * 2.0**39, rng.uniform(-1, 1) * 2.0**38, rng.uniform(0, 1)] for i in range(40)}
    x = np.array([[int(np.floor(c * 1024)) + 100_000 for c in v] for v in vectors.values()])
    model = whitening.fit(whitening.rows_of(frame(spark, vectors.items()), "vec_id", "embedding"))
    assert np.array_equal(model.covariance, covariance(x))
    rows = whitening.whiten(frame(spark, vectors.items())).filter("component = 1").collect()
    assert len(rows) == 40 and all(r.deviation is None for r in rows)


def test_sums_fall_back_to_unbounded_integers():
    y = np.array([[1 << 31, 3], [-(1 << 31), 5], [1 << 30, -7]])
    exact = [[int(c) for c in r] for r in y]
    assert whitening.pair_sums(y).tolist() == [sum(a * a for a, _ in exact), sum((a + b) ** 2 for a, b in exact), sum(b * b for _, b in exact)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [0.1, 0.2, 0.9], 2: [0.3, -0.2, 0.1], 3: [0.3, -0.2, 0.1], 4: [-1.5, 0.0, 2.0], 9: [0.5, 0.5, 0.25]}
    bad = [(5, None), (6, [0.1, None, 0.2]), (7, [nan, 0.0, 0.0]), (8, [0.0, inf, 0.0]), (10, []), (11, [1.0]), (12, [1e300, 0.0, 0.0])]
    got = collected(whitening.whiten(frame(spark, [*good.items(), *bad])))
    check(got, good, 3)
    assert [got[2, c].whitened for c in (1, 2, 3)] == [got[3, c].whitened for c in (1, 2, 3)]
    twice = whitening.whiten(frame(spark, [(None, [0.1, 0.2]), (None, [0.4, 0.9]), (1, [0.4, 0.1])])).collect()
    assert sorted(str(r.vec_id) for r in twice) == ["1"] * 2 + ["None"] * 4


def test_no_variance_and_nothing(spark):
    alone = collected(whitening.whiten(frame(spark, [(1, [0.5, 0.5])])))
    assert all(r.whitened is None and r.explained is None and r.identity_error == 0 and r.deviation == 0 and r.n == 1 for r in alone.values())
    flat = collected(whitening.whiten(frame(spark, [(i, [i / 4, 7.0]) for i in range(4)])))
    assert all((flat[i, 1].whitened is None, flat[i, 2].whitened is None) == (False, True) for i in range(4))
    assert flat[0, 1].explained == 1 and flat[0, 2].explained == 0 and flat[0, 1].identity_error < 1e-12
    for rows in ([], [(1, None), (2, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_usable_of_sliced_arrays():
    a = pa.array([[9.0], [1.0, 2.0], None, [3.0, None], [4.0, 5.0]], pa.list_(pa.float64())).slice(1)
    at, matrix = whitening.usable(a, 2)
    assert at.tolist() == [0, 3] and matrix.tolist() == [[1, 2], [4, 5]]


def test_query_on_a_whole_table(spark):
    got = queries.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in table if r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all()}
    assert len(vectors) == len({r.vec_id for r in table if r.embedding is not None})
    rows = collected(got)
    x = np.array([np.floor(np.array(v, float) * 1024) + 100_000 for v in vectors.values()])
    v = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(v)
    for c in range(8):
        mine = np.array([rows[i, c + 1].whitened for i in vectors])
        plain = (x - x.mean(axis=0)) @ axes[:, -1 - c] / np.sqrt(values[-1 - c])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-6
        assert rows[next(iter(vectors)), c + 1].explained == pytest.approx(values[-1 - c] / np.trace(v), rel=1e-9)
