"""Whitening against a dense eigendecomposition and exact integers; Jacobi-Davidson and MINRES by themselves."""

import math

import numpy as np
import pytest

from tests.llm.conftest import SF
from visitflow.llm import whitening
from visitflow.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, component int, n long, x array<int>, v double, i int, size int"


def expected(rows, components):
    """(vec_id, deviation), and the dense answer, of (vec_id, vector) rows that are all whole and of one length."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviations = sorted((i, int(d)) for (i, _), d in zip(rows, ((n * x - s) ** 2).sum(axis=1), strict=True))
    c = np.array([[float(e) for e in row] for row in (n * x - s)]) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return deviations, values, c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(found, rows, components=8):
    deviations, values, white, shares = expected(rows, components)
    found = found.collect()
    k = len(values)
    assert len(found) == k * len(rows)
    assert sorted((r.vec_id, r.deviation) for r in found if r.component == 1) == deviations
    assert {r.n for r in found} == {len(rows)} and len({r.identity_error for r in found}) == 1
    assert found[0].identity_error < 1e-10
    own = {(r.vec_id, r.component): r for r in found}
    for j in range(k):
        mine = np.array([own[i, j + 1].whitened for i, _ in rows])
        assert np.allclose(mine * np.sign(mine @ white[:, j]), white[:, j], rtol=0, atol=1e-7)
        assert all(math.isclose(own[i, j + 1].explained, shares[j], rel_tol=1e-9) for i, _ in rows[:3])


def test_query_equals_dense(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(QUERIES["op11_whitening"](spark, SF), rows)


def test_awkward_rows_and_other_lengths(spark):
    random = np.random.default_rng(3)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(random.normal(size=(40, 3)) * [9, 3, 1])]
    good.append(good[0])
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [float("-inf"), 0.0, 0.0]),
           (95, [1.0, 2.0]), (96, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, [3], 4.0, 5, 6) for i, v in [*good[:-1], *odd]], VECTORS).repartition(7)
    check(whitening.whiten(frame), good[:-1], 3)
    twice = spark.createDataFrame([(i, v, 1, 2, [3], 4.0, 5, 6) for i, v in good], VECTORS)
    rows = whitening.whiten(twice, components=2).collect()
    assert len(rows) == 82 and sum(r.vec_id == 0 for r in rows) == 4
    null = whitening.whiten(twice.selectExpr("nullif(vec_id, 1) vec_id", "embedding")).collect()
    assert sum(r.vec_id is None for r in null) == 3


def test_no_variance_gives_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 0.5]) for i in range(10)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1} and math.isclose(found[0].explained, 1)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v), 2500.0 * i]) for i, v in enumerate((6.0e5, -6.0e5, 3.0e5, 0.0))]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, 2)
    far = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>"))
    assert {r.deviation for r in far.collect()} == {None}


@pytest.mark.parametrize("spread", ["graded", "close", "repeated", "low rank"])
def test_jacobi_davidson(spread):
    random = np.random.default_rng(5)
    q = np.linalg.qr(random.normal(size=(120, 120)))[0]
    values = {
        "graded": np.geomspace(1e4, 1e-4, 120), "close": 1 + np.linspace(1, 0, 120) * 1e-2,
        "repeated": np.r_[np.full(6, 3.0), np.full(114, 1.0)], "low rank": np.r_[[5.0, 4.0], np.zeros(118)]}[spread]
    a = (q * values) @ q.T
    passes = []

    def product(columns):
        passes.append(columns.shape[1])
        return a @ columns

    theta, u, residuals = whitening.jacobi_davidson(product, 120, 8)
    assert np.allclose(theta, values[:8], rtol=0, atol=1e-13 * values[0])
    assert np.allclose(u.T @ u, np.eye(8), atol=1e-13) and residuals.max() < 1e-13 * values[0]
    assert len(passes) < 120


def test_minres_solves_each_column_with_its_own_shift():
    random = np.random.default_rng(7)
    a = random.normal(size=(30, 30))
    a, b, shifts = a + a.T, random.normal(size=(30, 4)), np.array([0.0, 1.5, -2.0, 40.0])
    b[:, 2] = 0
    x = whitening.minres(lambda v: a @ v - v * shifts, b, 60, 1e-12)
    assert np.allclose(a @ x - x * shifts, b, atol=1e-6)
