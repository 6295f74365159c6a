"""Affine parameters and splines of many landmarks."""

import numpy as np
import pytest

from arborium.operators import registration as A

# A matrix and its parameters as registration tools give them, the newer and the older way.
PARAMS = [100, 50, 10, 3, 3, 3, 1.1, 0.9, 1, 0.03, 0.1, 0.05, 10, 50, 50]
MATRIX = [[1.09698704245255, 0.0794174055868413, 0.151929624282028, 87.462778082031], [-0.0574906547972094, 0.895837910136773, -0.0103700734989691, 56.3015147160819], [-0.0575695518672382, 0.0454677297831557, 0.994640563641534, 8.57028084743792], [0, 0, 0, 1]]
OLD_PARAMS = [100, 50, 50, 3, 4, 5, 1, 1.1, 1.2, 0.1, 0.2, 0.3, 0, 0, 0]
OLD_MATRIX = [[0.993768017875764, 0.0997404961300905, 0.0778012981466213, 100], [0.0124333660488193, 1.10393643798483, -0.0620696470929289, 50], [0.1029140991094, 0.40556613106989, 1.19004163463567, 50], [0, 0, 0, 1]]


def test_composed_and_decomposed(spark):
    rng = np.random.default_rng(0)
    given = [PARAMS, [100, 50, 10, 3, 4, 5, -1.1, -0.9, -1, 0.05, 0.02, 0.03, 5, 10, 20]] + np.column_stack([rng.uniform(-50, 50, (40, 3)), rng.uniform(-80, 80, (40, 3)), rng.uniform(0.3, 2, (40, 3)), rng.uniform(-0.5, 0.5, (40, 3)), rng.uniform(-9, 9, (40, 3))]).tolist()
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(given)] + [(99, None, *map(float, PARAMS[1:]))], "k long, " + ", ".join(f"{c} double" for c in A.NAMES))
    made = A.composed(table)
    held = {r.k: r.matrix for r in made.collect()}
    assert held[99] is None and np.allclose(np.reshape(held[0], (4, 4)), MATRIX, atol=1e-9)
    back = {r.k: r for r in A.decomposed(made.select("k", "matrix", *A.NAMES[12:])).collect()}
    again = {r.k: r.matrix for r in A.composed(A.decomposed(made.select("k", "matrix", *A.NAMES[12:])).select("k", *A.NAMES)).collect()}
    for k, p in enumerate(given):
        assert np.allclose(again[k], held[k])
        if k != 1:
            assert np.allclose([back[k][c] for c in A.NAMES], p)
    assert back[99].tx is None


def test_legacy_and_singular():
    assert np.allclose(A.matrices(np.array([OLD_PARAMS], float), legacy=True)[0], OLD_MATRIX, atol=1e-4)
    with pytest.raises(ValueError, match="singular"):
        A.parameters(np.array([np.diag([1.0, 0.0, 1.0, 1.0])]))
    for angles in ((0, 90, 0), (20, 90, 0), (20, -90, 0)):
        m = A.matrices(np.array([[1, 2, 3, *angles, 1, 2, 3, 0.1, 0.2, 0.3, 0, 0, 0]], float))
        assert np.allclose(A.matrices(A.parameters(m)), m, atol=1e-7)


def test_a_thousand_landmarks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    source = rng.uniform(0, 100, (1000, 3))
    target = source + np.sin(source / 20)
    marks = spark.createDataFrame([(*map(float, s), *map(float, t)) for s, t in zip(source, target, strict=True)], "x double, y double, z double, to_x double, to_y double, to_z double")
    points = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(np.concatenate([source, rng.uniform(0, 100, (50, 3))]))], "k long, x double, y double, z double")
    monkeypatch.setattr(A, "AT_A_TIME", 5000)
    got = {r.k: (r.x, r.y, r.z) for r in A.spline(points, marks).collect()}
    assert np.allclose([got[k] for k in range(1000)], target, atol=1e-6)
    for r in points.filter("k >= 1000").collect():
        assert np.allclose(got[r.k], np.array([r.x, r.y, r.z]) + np.sin(np.array([r.x, r.y, r.z]) / 20), atol=0.15)
    monkeypatch.setattr(A, "MOST_LANDMARKS", 10)
    with pytest.raises(ValueError, match="at most"):
        A.spline(points, marks)
