"""Whitening beside numpy's own solver and exact integer arithmetic."""

import math

import numpy as np
import pytest

from fleetfit.llm import queries, whitening
from conftest import TESTDATA

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def expected(rows):
    """Ids, integers and (values, vectors) of the usable rows by plain numpy."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    usual = max(set(lengths), key=lambda d: (lengths.count(d), d))
    kept = [(i, v) for i, v in kept if len(v) == usual]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], np.int64)
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / len(x))
    return [i for i, _ in kept], x, values[::-1], vectors[:, ::-1]


def check(found, ids, x, values, vectors, k):
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    exact = {}
    for i, row in zip(ids, x):
        exact.setdefault(i, []).append(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)))
    by_component = {}
    for r in found:
        by_component.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["deviation"] in exact[r["vec_id"]] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    assert sorted(by_component) == list(range(1, k + 1))
    projected = (x - x.mean(axis=0)) @ vectors[:, :k] / np.sqrt(values[:k])
    for c, rows in by_component.items():
        mine = np.array(sorted(r["whitened"] for r in rows))
        either = [np.sort(projected[:, c - 1]), np.sort(-projected[:, c - 1])]
        assert min(np.abs(mine - e).max() for e in either) < 1e-6


def test_given_embeddings(spark):
    found = queries.QUERIES["op13_whitening"](spark, TESTDATA).collect()
    rows = spark.read.parquet(f"{TESTDATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x, values, vectors = expected([(r[0], r[1]) for r in rows])
    assert len(found) == 32 * len(ids)
    check(found, ids, x, values, vectors, 32)
    whole = {}
    for r in found:
        whole.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    w = np.array([[whole[i][c] for c in range(1, 33)] for i in ids])
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9


def test_odd_rows(spark):
    """Nulls, no numbers, other lengths, repeated ids, a null id, entries beyond all bounds, extra columns."""
    random = np.random.default_rng(3)
    good = [(i, [float(v) for v in random.standard_normal(3) * (1, 2, 3)]) for i in range(40)]
    odd = [
        (100, None),
        (101, []),
        (102, [1.0, None, 2.0]),
        (103, [float("nan"), 1.0, 1.0]),
        (104, [float("inf"), 1.0, 1.0]),
        (105, [1.0, 2.0]),
        (106, [3e38, 1.0, 1.0]),
    ]
    more = [(7, good[7][1]), (7, [0.5, 0.25, -1.0]), (None, [0.1, 0.2, 0.3])]
    rows = good + odd + more
    df = spark.createDataFrame([(i, v, 1, 5, "x") for i, v in rows], SCHEMA).repartition(5)
    found = whitening.whitened(df).collect()
    ids, x, values, vectors = expected(good + more)
    assert len(found) == 3 * len(ids)
    check(found, ids, x, values, vectors, 3)
    assert whitening.whitened(df).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_without_variance(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)
    assert whitening.whitened(df).count() == 0


def test_long_integers(spark):
    """Deviations beyond a long are null, those that fit are exact."""
    big = [(0, [2.0**45, 0.0]), (1, [-(2.0**45), 1.0]), (2, [0.0, 2.0])]
    found = whitening.whitened(spark.createDataFrame([(i, v, 0, 0, "") for i, v in big], SCHEMA)).collect()
    x = [[64 * int(a) + 1_000_000, 64 * int(b) + 1_000_000] for _, (a, b) in big]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        exact = sum((3 * v - s) ** 2 for v, s in zip(x[r["vec_id"]], sums))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)


@pytest.mark.parametrize("spectrum", [[1.0], [2.0, 2.0], [4.0] * 5 + [1.0] * 5, [1.0, 1.0 - 1e-12, 1.0 - 2e-12, 0.5], list(range(1, 70))])
def test_eigenvectors(spectrum):
    """Tridiagonal form, Sturm counts and inverse iteration, with equal and nearly equal eigenvalues."""
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    matrix = q @ np.diag(spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.principal(matrix, 32)
    assert np.abs(values - np.sort(spectrum)[::-1][: len(values)]).max() < 1e-13 * max(spectrum) * d
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * max(spectrum) * d
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    diagonal, beside, _ = whitening.tridiagonal(matrix)
    points = np.array([0.0, 1.5, max(spectrum) + 1])
    assert list(whitening.smaller(diagonal, beside, points)) == [sum(s < p for s in spectrum) for p in points]
