"""Exact nearest neighbours by cells that widen, against all pairs."""

import numpy as np
import pytest

from arborium.operators import geometry as G
from arborium.operators import spatial as S


def clouds():
    rng = np.random.default_rng(2)
    dense = np.concatenate([rng.normal(size=(300, 3)) * 1e-4, [[1e4, -1e4, 5.0]], rng.uniform(-50, 50, (40, 3))])
    return {
        1: rng.uniform(0, 1, (150, 3)), 2: dense, 3: np.zeros((200, 3)), 4: np.c_[rng.integers(0, 6, (150, 2)), np.zeros(150)].astype(float),
        5: np.c_[np.arange(60.0), np.zeros((60, 2))], 6: np.array([[1.0, 2.0, 3.0]]), 7: np.concatenate([np.zeros((100, 3)), rng.uniform(-1, 1, (30, 3))]), 8: rng.uniform(0, 1, (3, 3)) * 1e6,
    }


def table(spark, held):
    rows = [(g, i, *map(float, p)) for g, points in held.items() for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "g long, i long, x double, y double, z double")


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours(spark, k):
    held = clouds()
    got = {}
    for r in S.neighbours(table(spark, held), "i", "g", k).collect():
        got.setdefault((r.g, r.i), []).append((r["rank"], r.neighbour, r.d2))
    for g, points in held.items():
        gap = points[:, None] - points[None]
        d2 = gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2
        for i in range(len(points)):
            order = sorted(range(len(points)), key=lambda j: (d2[i, j], j))[:k]
            assert sorted(got[g, i]) == [(n + 1, j, d2[i, j]) for n, j in enumerate(order)]
    assert len(got) == sum(map(len, held.values()))


def test_nearest_of_others(spark):
    held = clouds()
    a = {g: p[::2] for g, p in held.items()}
    b = {g: p[1::2] + 0.25 for g, p in held.items() if g != 5} | {99: np.ones((3, 3))}
    got = {(r.g, r.i): r.d2 for r in S.nearest(table(spark, a), table(spark, b), "i", "g").collect()}
    want = {(g, i): min(((p - q) ** 2).sum() for q in b[g]) for g, points in a.items() if len(b.get(g, ())) for i, p in enumerate(points)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_tangents_against_brute_force(spark):
    rng = np.random.default_rng(4)
    held = {1: rng.normal(size=(60, 3)) * [5, 1, 0.2], 2: rng.uniform(0, 1, (25, 3))}
    for r in G.tangents(table(spark, held), "i", "g", 6).collect():
        points = held[r.g]
        near = points[np.argsort(((points - points[r.i]) ** 2).sum(1), kind="stable")[:6]]
        values, vectors = np.linalg.eigh(np.cov(near.T, bias=True))
        assert r.alpha == pytest.approx((values[2] - values[1]) / values.sum()) and abs(np.dot((r.vx, r.vy, r.vz), vectors[:, 2])) == pytest.approx(1)


def test_too_few_points_are_an_error(spark):
    with pytest.raises(ValueError, match="fewer than 5"):
        G.tangents(table(spark, {1: np.random.default_rng(0).normal(size=(9, 3)), 2: np.eye(3)}), "i", "g", 5)
