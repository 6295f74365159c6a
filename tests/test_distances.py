"""Signed distances to meshes against a projection onto every triangle."""

import numpy as np
import pytest

from arborium.operators import distances as S
from arborium.plans import tables as D


def closest(p, a, b, c):
    """Least distance by regions of the triangle: corners, edges, inside."""
    ab, ac, ap = b - a, c - a, p - a
    ends = [np.linalg.norm(p - q) for q in (a, b, c)]
    for u, v in ((a, b), (b, c), (c, a)):
        d = v - u
        if d @ d > 0 and 0 <= (p - u) @ d <= d @ d:
            ends.append(np.linalg.norm(p - u - (p - u) @ d / (d @ d) * d))
    gram = np.array([[ab @ ab, ab @ ac], [ab @ ac, ac @ ac]])
    if np.linalg.det(gram) > 1e-12:
        s, t = np.linalg.solve(gram, [ab @ ap, ac @ ap])
        if s >= 0 and t >= 0 and s + t <= 1:
            ends.append(np.linalg.norm(ap - s * ab - t * ac))
    return min(ends)


def sphere(n):
    """A closed mesh: triangles between rings of a ball of radius 10 around (5, 5, 5)."""
    lat = np.linspace(0, np.pi, n)
    points = [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0)]
    ring = [[len(points) + i * n + j for j in range(n)] for i in range(n - 2)]
    for t in lat[1:-1]:
        points += [(np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)) for p in np.arange(n) * 2 * np.pi / n]
    faces = []
    for j in range(n):
        k = (j + 1) % n
        faces += [(0, ring[0][j], ring[0][k]), (1, ring[-1][k], ring[-1][j])]
        for i in range(n - 3):
            faces += [(ring[i][j], ring[i + 1][j], ring[i + 1][k]), (ring[i][j], ring[i + 1][k], ring[i][k])]
    return np.array(points) * 10 + 5, faces


def frames(spark, points, faces, mesh=1):
    v = spark.createDataFrame([(mesh, k, *map(float, p)) for k, p in enumerate(points)], "mesh_id long, vertex long, x double, y double, z double")
    f = spark.createDataFrame([(mesh, "r", k, *map(int, t)) for k, t in enumerate(faces)], "mesh_id long, region string, face long, v1 long, v2 long, v3 long")
    return f, v


def test_ball(spark):
    points, faces = sphere(12)
    f, v = frames(spark, points, faces)
    rng = np.random.default_rng(6)
    asked = np.concatenate([rng.uniform(-8, 18, (25, 3)), [[5, 5, 5], [200, 5, 5], [-1e5, 0, 0], points[4], (points[faces[3][0]] + points[faces[3][1]]) / 2]])
    frame = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(asked)], "mesh_id long, point long, x double, y double, z double")
    got = {r.point: r.distance for r in S.distances(frame, f, v).collect()}
    for k, p in enumerate(asked):
        want = min(closest(p, *(points[i] for i in t)) for t in faces)
        assert abs(got[k]) == pytest.approx(want, rel=1e-4, abs=1e-6)
        r = np.linalg.norm(p - 5)
        assert (got[k] > 0) == (r < 9.4) or 9.4 <= r <= 10.01


def test_tetrahedra_and_degenerate_triangles(spark):
    f, v = D.meshes(spark, "/root/testdata/sf0.001")
    more = spark.createDataFrame([(3, "none", 99, 1, 1, 1), (4, "none", 99, 1, 2, 2)], "mesh_id long, region string, face long, v1 long, v2 long, v3 long")
    rng = np.random.default_rng(7)
    asked = rng.uniform([-20, -20, -20], [60, 30, 30], (24, 3))
    frame = spark.createDataFrame([(3 + k % 3, k, *map(float, p)) for k, p in enumerate(asked)] + [(77, 0, 1.0, 1.0, 1.0)], "mesh_id long, point long, x double, y double, z double")
    got = {(r.mesh_id, r.point): r.distance for r in S.distances(frame, f.unionByName(more), v).collect()}
    corner = {(r.mesh_id, r.vertex): np.array([r.x, r.y, r.z]) for r in v.collect()}
    held = [(r.mesh_id, *(corner[r.mesh_id, c] for c in (r.v1, r.v2, r.v3))) for r in f.collect()]
    for k, p in enumerate(asked):
        m = 3 + k % 3
        assert abs(got[m, k]) == pytest.approx(min(closest(p, *t[1:]) for t in held if t[0] == m), rel=1e-4, abs=1e-5)
    assert got[77, 0] is None
