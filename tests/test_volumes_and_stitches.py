"""Points in closed meshes, and fragments joined by their shortest links."""

import itertools

import numpy as np
import pytest

from arborium.operators import stitching as H
from arborium.operators import surfaces as U
from arborium.operators import topology as T


def cube(spark):
    return U.box_mesh(spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "mesh_id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"))


def inside(spark, mesh, points):
    frame = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(points)], "mesh_id long, point long, x double, y double, z double")
    return [r.inside for r in U.points_inside(frame, *mesh).orderBy("point").collect()]


@pytest.mark.parametrize("bins", [1, 32])
def test_cube(spark, bins):
    steps = [-0.25, 0.0, 0.25, 0.4, 0.5, 0.75, 1.0, 1.25]
    points = list(itertools.product(steps, repeat=3))
    frame = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(points)], "mesh_id long, point long, x double, y double, z double")
    got = [r.inside for r in U.points_inside(frame, *cube(spark), bins=bins).orderBy("point").collect()]
    assert got == [all(0 <= c <= 1 for c in p) for p in points]


def test_sphere(spark):
    n, rings = 16, 9
    at = lambda i, j: (np.sin(np.pi * i / rings) * np.cos(2 * np.pi * j / n), np.sin(np.pi * i / rings) * np.sin(2 * np.pi * j / n), np.cos(np.pi * i / rings))
    vertex = {(i, j): 1 + i * n + j for i in range(rings + 1) for j in range(n)}
    vertices = [(1, v, *map(float, at(i, j))) for (i, j), v in vertex.items()]
    quads = [[vertex[a, b] for a, b in ((i, j), (i + 1, j), (i + 1, (j + 1) % n), (i, (j + 1) % n))] for i in range(rings) for j in range(n)]
    faces = [(1, "s", k, *t) for k, t in enumerate(t for q in quads for t in (q[:3], [q[0], *q[2:]]))]
    mesh = spark.createDataFrame(faces, "mesh_id long, region string, face long, v1 long, v2 long, v3 long"), spark.createDataFrame(vertices, "mesh_id long, vertex long, x double, y double, z double")
    rng = np.random.default_rng(1)
    points = [p for p in rng.uniform(-1.1, 1.1, (500, 3)) if not 0.9 < np.linalg.norm(p) < 1] + [np.array([0, 0, z]) for z in (-0.9, 0, 0.5, 1.05)]
    assert inside(spark, mesh, points) == [bool(np.linalg.norm(p) <= 0.9) for p in points]


def forest(spark, fragments):
    """Chains of points: lists of coordinates, numbered on."""
    rows, n = [], 0
    for chain in fragments:
        for k, p in enumerate(chain):
            n += 1
            rows.append((1, n, -1 if k == 0 else n - 1, *map(float, p)))
    return spark.createDataFrame(rows, "neuron_id long, point_no long, parent long, x double, y double, z double")


def test_spanning_tree(spark):
    rng = np.random.default_rng(6)
    chains = [[c + [k, 0, 0] for k in range(3)] for c in rng.uniform(0, 60, (9, 3))]
    v = forest(spark, chains)
    joined, links = H.stitch(v)
    ends = [(3 * f + k + 1, f, chains[f][k]) for f in range(9) for k in (0, 2)]
    gaps = sorted((float(np.linalg.norm(p - q)), a, b, f, g) for (a, f, p), (b, g, q) in itertools.combinations(ends, 2) if f != g)
    group, want = list(range(9)), set()
    for _, a, b, f, g in gaps:
        if group[f] != group[g]:
            want.add((min(a, b), max(a, b)))
            group = [group[f] if x == group[g] else x for x in group]
    assert {(r.a, r.b) for r in links.collect()} == want
    rows = {r.point_no: r.parent for r in joined.collect()}
    assert [p for p, q in rows.items() if q == -1] == [1]
    old = {(r.parent, r.point_no) for r in v.collect() if r.parent != -1}
    assert {(min(p, q), max(p, q)) for p, q in rows.items() if q != -1} == old | want
    assert {r.root for r in T.to_root(joined).collect()} == {1}


def test_links_up_to_a_length(spark):
    v = forest(spark, [[(0, 0, 0), (1, 0, 0)], [(2, 0, 0), (3, 0, 0)], [(50, 0, 0)]])
    joined, links = H.stitch(v, longest=5.0)
    assert [(r.a, r.b, r.gap) for r in links.collect()] == [(2, 3, 1.0)]
    assert {r.point_no: r.parent for r in joined.collect()} == {1: -1, 2: 1, 3: 2, 4: 3, 5: -1}
    assert H.stitch(v, longest=0.1)[1].count() == 0


def test_pair(spark):
    side = lambda chain: forest(spark, [chain]).withColumnRenamed("neuron_id", "pair")
    got = H.stitch_pair(side([(0, 0, 0), (1, 0, 0)]), side([(9, 0, 0), (5, 0, 0), (2, 0, 0)]))
    assert {r.point_no: r.parent for r in got.collect()} == {1: -1, 2: 1, 3: 4, 4: 5, 5: 2}


def test_circles_are_an_error(spark):
    v = spark.createDataFrame([(1, 1, 3, 0.0, 0.0, 0.0), (1, 2, 1, 1.0, 0.0, 0.0), (1, 3, 2, 2.0, 0.0, 0.0)], "neuron_id long, point_no long, parent long, x double, y double, z double")
    with pytest.raises(ValueError, match="circle"):
        T.to_root(v)
