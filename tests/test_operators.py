"""Operators that SQL doesn't express, against brute force on small trees."""

import math

import numpy as np
import pytest

from arborium.operators import editing as E
from arborium.operators import geometry as G
from arborium.operators import morphometry as M
from arborium.operators import topology as T
from arborium.plans import tables as D

SF = "/root/testdata/sf0.001"


def tree(spark, parents, points=None):
    rows = [(1, k, *map(float, points[k - 1] if points else (k, 0, 0)), 1.0, "a", p) for k, p in enumerate(parents, 1)]
    return spark.createDataFrame(rows, "neuron_id long, point_no long, x double, y double, z double, w double, label string, parent long")


def test_strahler_rule_for_three_children(spark):
    # two orders of two and one of one meet: not all equal, so the largest goes on; the classical rule rises
    parents = [-1, 1, 2, 2, 2, 3, 3, 4, 4]
    got = {r.point_no: r.strahler for r in T.strahler(tree(spark, parents)).collect()}
    assert [got[k] for k in (5, 6, 3, 4, 2, 1)] == [1, 1, 2, 2, 2, 2]
    classical = {r.point_no: r.strahler for r in T.strahler(tree(spark, parents), classical=True).collect()}
    assert classical[2] == 3


def test_strahler_of_the_heap(spark):
    v = D.trees(spark, SF, "heap")
    parent = {(r.neuron_id, r.point_no): r.parent for r in v.collect()}
    children = {}
    for (n, p), q in parent.items():
        children.setdefault((n, q), []).append((n, p))

    def order(k):
        below = [order(c) for c in children.get(k, [])]
        return 1 if not below else below[0] if len(below) == 1 else max(below) + (min(below) == max(below))

    for r in T.strahler(v).collect():
        assert r.strahler == order((r.neuron_id, r.point_no))


def test_simplify_keeps_longest_ways(spark):
    v = tree(spark, [-1, 1, 2, 2, 4, 1], [(0, 0, 0), (0, 1, 0), (0, 2, 0), (3, 1, 0), (9, 1, 0), (0, 0, 2)])
    assert {r.point_no for r in E.simplify(v, 0).collect()} == {1, 2, 4, 5}
    assert {r.point_no for r in E.simplify(v, 1).collect()} == {1, 2, 4, 5, 6}


def test_prune_twigs_and_reroot(spark):
    v = tree(spark, [-1, 1, 2, 2, 4, 5])
    assert {r.point_no for r in E.prune_twigs(v, 1.5).collect()} == {1, 2, 4, 5, 6}
    assert {r.point_no: r.parent for r in E.reroot(v, v.filter("point_no = 5")).collect()} == {5: -1, 6: 5, 4: 5, 2: 4, 1: 2, 3: 2}


def test_resample_spacing(spark):
    v = tree(spark, [-1, 1, 2], [(0, 0, 0), (4, 0, 0), (10, 0, 0)])
    assert [r.x for r in G.resample(v, 3.0).orderBy("pos").collect()] == pytest.approx([0, 3, 6, 9, 10])


def test_smooth_keeps_ends(spark):
    v = tree(spark, [-1, 1, 2], [(0, 0, 0), (1, 5, 0), (2, 0, 0)])
    got = {r.point_no: r for r in G.smooth(v, 3.0).collect()}
    assert got[1].y == 0 and got[3].y == 0 and 0 < got[2].y < 5


def test_tangents_of_a_line(spark):
    v = tree(spark, [-1, *range(1, 12)], [(k * 1.0, k * 2.0, 0.0) for k in range(12)])
    for r in G.tangents(v, "point_no", "neuron_id", 4).collect():
        assert r.alpha == pytest.approx(1) and abs(r.vx) == pytest.approx(1 / math.sqrt(5))


def test_thin_plate_meets_landmarks(spark):
    source = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]], float)
    target = source * 2 + 1
    target[4] += 0.5
    v = spark.createDataFrame([tuple(map(float, s)) for s in source], "x double, y double, z double")
    assert np.allclose(np.array(G.thin_plate(v, source, target).collect()), target)


def segment_gap(a, b, n=400):
    t = np.linspace(0, 1, n)
    p, q = (np.array(s[0])[None] + t[:, None] * (np.array(s[1]) - np.array(s[0])) for s in (a, b))
    return np.linalg.norm(p[:, None] - q[None], axis=2).min()


def test_segment_distance(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(tuple(map(float, p)) for p in rng.uniform(0, 5, (4, 3))) for _ in range(40)]
    point = "struct<x:double,y:double,z:double>"
    pairs = spark.createDataFrame(rows, f"p0 {point}, p1 {point}, q0 {point}, q1 {point}")
    for r in pairs.withColumn("gap", M.segment_distance(pairs)).collect():
        assert r.gap == pytest.approx(segment_gap((r.p0, r.p1), (r.q0, r.q1)), abs=0.02)


def test_points_inside_a_box(spark):
    faces, vertices = D.meshes(spark, SF)
    from arborium.operators import surfaces as U

    corner = {r.vertex: np.array([r.x, r.y, r.z]) for r in vertices.filter("mesh_id = 3").collect()}
    rng = np.random.default_rng(5)
    points = rng.uniform([0, 0, -1], [45, 10, 12], (300, 3))
    frame = spark.createDataFrame([(3, k, *map(float, p)) for k, p in enumerate(points)], "mesh_id long, point long, x double, y double, z double")
    m = np.linalg.inv(np.stack([corner[k] - corner[1] for k in (2, 3, 4)], 1))
    for r in U.points_inside(frame, faces, vertices).collect():
        u = m @ (np.array([r.x, r.y, r.z]) - corner[1])
        assert r.inside == bool((u >= 0).all() and u.sum() <= 1)
