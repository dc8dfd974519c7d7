"""Lattice hashing against all pairs in double precision."""

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_simhash import brute_components
from visitflow.llm import lattice


def test_decoder_finds_the_nearest_point():
    random = np.random.default_rng(2)
    x = random.normal(size=(500, 8))
    near, roots = lattice.e8_decode(x), lattice.e8_roots()
    assert len(np.unique(roots, axis=0)) == 240 and np.allclose((roots ** 2).sum(axis=1), 2)
    assert (np.isclose(near % 1, 0).all(axis=1) | np.isclose(near % 1, 0.5).all(axis=1)).all() and (near.sum(axis=1) % 2 == 0).all()
    others = near[:, None] + roots[None]
    assert (((x - near) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - others) ** 2).sum(axis=2) + 1e-9).all()


def brute(vectors):
    units = np.array(vectors, float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    return units @ units.T >= 0.95


@pytest.mark.parametrize("dense,block", [(64, 256), (2, 2)])
def test_given_table(spark, dense, block):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = rows.select("vec_id", "embedding").collect()
    near = brute([r.embedding for r in data])
    found = {r.vec_id: r for r in lattice.near_vectors(rows, dense=dense, block=block).collect()}
    assert len(found) == len(data)
    wanted = near.sum(axis=1) - 1
    got = np.array([found[r.vec_id].n_links for r in data])
    assert (got <= wanted).all() and got.sum() >= 0.95 * wanted.sum()


def test_recall_at_the_threshold(spark):
    random = np.random.default_rng(4)
    base = random.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = random.normal(size=(300, 64))
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    other = 0.955 * base + np.sqrt(1 - 0.955 ** 2) * noise
    rows = [(i, x.tolist()) for i, x in enumerate(np.vstack([base, other]))]
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("n_links > 0").count()
    assert found >= 0.9 * 600


def test_special_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [0.0, 0.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, v string")
    found = {r.vec_id: tuple(r)[1:] for r in lattice.near_vectors(frame).collect()}
    assert len(found) == 13 and found[1] == (3, 1, True) and found[2] == (3, 1, False) and found[3] == (3, 1, False)
    assert found[None] == (3, 1, False)
    assert all(found[i] == (0, i, True) for i in range(4, 13))
    assert lattice.near_vectors(frame.limit(0)).count() == 0
    assert brute_components({1: 0, 2: 1}, 2) == {1: 1, 2: 1}


def test_a_pair_of_blocks_may_lack_a_side():
    row = {"id": 1, "home": True, "v": np.ones(2) / np.sqrt(2)}
    for part in (0, 1):
        found = lattice._compare(0.95)((7, 0, 1), pd.DataFrame([{**row, "part": part}]))
        assert list(found.columns) == ["a", "b"] and found.empty


def test_missing_and_shared_ids_are_vectors_of_their_own(spark):
    """Links, degrees and components by vector; the ids only name the components."""
    random = np.random.default_rng(6)
    a, b, c, d = np.linalg.qr(random.normal(size=(16, 4)))[0].T
    near = lambda x, y: (x + 0.1 * y).tolist()
    rows = [(1, a.tolist()), (1, near(a, b)), (None, near(a, c)), (2, b.tolist()), (2, c.tolist()), (3, near(c, d)), (4, near(b, d)),
            (None, d.tolist()), (None, near(d, a)), (5, None), (None, None)]
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    wanted = [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False),
              (4, 1, 2, False), (None, 1, None, False), (None, 1, None, False), (5, 0, 5, True), (None, 0, None, False)]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_blocks_and_pairs_decide_alike_at_the_limit():
    random = np.random.default_rng(8)
    v = random.normal(size=(60, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for least in [float((v[0] * x).cumsum()[-1]) for x in v[1:6]]:
        frame = pd.DataFrame({"id": range(60), "home": True, "v": list(v), "part": 0})
        pairs = {tuple(p) for p in lattice._compare(least)((1, 0, 0), frame).itertuples(index=False)}
        assert pairs == {(i, j) for i in range(60) for j in range(i) if np.cumsum(v[i] * v[j])[-1] >= least}
