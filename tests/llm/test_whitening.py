"""Whitening against numpy's eigenvectors of a plain covariance, and the splitting on hard spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import queries, whitening


def plain(vectors):
    x = {tuple(math.floor(256 * c) for c in v) for v in vectors}
    x = np.array(sorted(x), dtype=np.int64)
    centred = x - x.mean(axis=0)
    values, found = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], found[:, ::-1]


@pytest.mark.parametrize("spectrum", ["random", "clustered", "graded", "repeated", "rank one", "negative"])
def test_components_of_hard_spectra(spectrum):
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 17, 64):
        values = {
            "random": rng.random(m), "clustered": 1 + 1e-9 * np.arange(m), "graded": 10.0 ** -np.arange(m), "repeated": np.array([5.0, 5.0, 5.0, 2.0, *[1.0] * m])[:m],
            "rank one": np.eye(1, m)[0] * 7, "negative": rng.standard_normal(m),
        }[spectrum]
        q = np.linalg.qr(rng.standard_normal((m, m)))[0]
        a = q * values @ q.T
        a = (a + a.T) / 2
        got, vectors = whitening.leading_components(a, 4)
        k = min(4, m)
        assert vectors.shape == (m, k)
        assert np.allclose(got, np.sort(values)[::-1][:k], atol=1e-13 * max(1, np.abs(values).max()))
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * got, atol=1e-12 * max(1, np.abs(values).max()))


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    values = np.array([*(10.0 ** -np.arange(10)), *(-(10.0 ** -np.arange(10)))])
    assert np.allclose(whitening.polar_factor(q * values @ q.T), q * np.sign(values) @ q.T, atol=1e-6)


def test_the_query_against_a_plain_computation(spark):
    folder = "/root/testdata/sf0.001"
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    x, values, vectors = plain(table.values())
    n, sums = len(x), x.sum(axis=0)
    rows = queries.op13_qdwh_whitening(spark, folder).collect()
    assert len(rows) == 4 * len(table)
    signs = {}
    for r in rows:
        own = np.array([math.floor(256 * c) for c in table[r.vec_id]])
        k = r.component - 1
        want = float((own - sums / n) @ vectors[:, k] / np.sqrt(values[k]))
        sign = signs.setdefault(k, 1 if want * r.whitened > 0 else -1)
        assert abs(r.whitened - sign * want) < 1e-9
        assert (r.n, r.deviation) == (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, sums, strict=True)))
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-10 and r.identity_error < 1e-10


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [[0.5, 0.25, 0.0], [-0.5, 1.0, 0.125], [0.5, 0.25, 0.0], [3.0, -2.0, 1.0], [-0.001, 2.0, 7.0]]
    bad = [None, [], [0.5, None, 1.0], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i if i else None, v) for i, v in enumerate([*good, *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("n"), "dim": F.lit(1), "packed": F.lit("x")})
    model = whitening.fit(df)
    x, values, _ = plain(good)
    assert (model.dim, model.n, len(model.values)) == (3, 4, 3) and np.allclose(model.values, values[:3])
    got = whitening.transform(df, model).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i if i else None) for i in range(5) for _ in range(3))
    by_id = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(by_id[None, k] == by_id[2, k] for k in (1, 2, 3))
    for empty in (df.limit(0), df.where("vec_id >= 5"), df.where("vec_id = 2 or vec_id is null")):
        assert whitening.transform(empty, whitening.fit(empty.where("size(embedding) = 3") if empty.count() > 2 else empty)).count() == 0


def test_long_values_stay_exact(spark):
    rows = [(1, [2.0**30, 1.0]), (2, [-(2.0**30), 3.0]), (3, [0.5, 2.0**44])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert model.sums == [128, 256 * 4 + 2**52]
    assert {r.deviation for r in whitening.transform(df, model).collect()} == {None}
