import itertools

import numpy as np
import pytest

from lodestead.llm import embedding_dedup as E


def test_minimal_vectors_and_decoder():
    near = E.minimal_vectors()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(1), 2)
    points = np.vstack([np.zeros((1, 8)), near, (near[:, None] + near[None]).reshape(-1, 8)])
    points = np.unique(points, axis=0)
    x = np.random.default_rng(1).normal(size=(60, 8)) * 0.5
    best = ((x[:, None] - points[None]) ** 2).sum(2).min(1)
    assert np.allclose(((x - E.decode_e8(x)) ** 2).sum(1), best)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, v int, id int, dim int")


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    x = np.vstack([base, base[:60] + rng.normal(size=(60, 16)) * 0.3, base[:20] + rng.normal(size=(20, 16)) * 0.05, base[:5], base[:5] * 2]).astype(np.float32)
    out = {r.vec_id: r for r in E.near_duplicates(vectors(spark, [(i, v.tolist(), 0, 1, 2, 3) for i, v in enumerate(x)])).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = np.array([out[i].n_links for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    for i, j in itertools.combinations(range(len(x)), 2):
        if np.array_equal(x[i], x[j]):
            assert out[i].component_id == out[j].component_id
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


@pytest.mark.parametrize(("rows", "dim"), [(10_000, 64), (10**8, 64)])
def test_recall_at_the_threshold(rows, dim):
    tables, blocks, scale = E.plan_index(rows, dim, 0.9)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(400, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(400, dim))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    lattice = E.Lattice(dim, tables, blocks, scale)
    x, y = lattice.cells(a), lattice.cells(b)
    assert ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1).mean() >= 0.9


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, nan), (5, inf), (6, [None, 1.0]), (7, one), (8, one), (8, one), (9, [2.0, 0.1]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0])]
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(vectors(spark, [(i, v, 0, 1, 2, 3) for i, v in rows])).orderBy("vec_id").collect()]
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)]
    assert out == [*alone, (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 3, 7, False), (10, 0, 10, True), (11, 0, 11, True)]
    assert E.near_duplicates(vectors(spark, [(1, one, 0, 1, 2, 3)]).where("false")).count() == 0
