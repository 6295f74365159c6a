"""Queries on two collections of trees, against brute force over all trees of a small fixture."""

import collections
import datetime
import math

import numpy as np
import pytest

from arborium.plans import catalog
from arborium.plans import tables as D


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Events of six users, none of which is 0 or 7 modulo 15, with short edges near each other."""
    rng, rows = np.random.default_rng(8), []
    for event in range(48):
        at = datetime.datetime(2024, 1, 1, int(rng.integers(0, 4)))
        rows.append((event, event % 6 + 1, at, "click", float(rng.uniform(0, 8)), f'{{"k": {rng.integers(0, 6)}}}'))
    path = f"{tmp_path_factory.mktemp('pairs')}"
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def trees(spark, sf):
    v = {(r.neuron_id, r.point_no): (np.array([r.x, r.y, r.z]), r.parent) for r in D.trees(spark, sf, "heap").collect()}
    edges = collections.defaultdict(list)
    for (n, _), (p, parent) in v.items():
        if parent != -1:
            edges[n].append((v[n, parent][0], p))
    points = collections.defaultdict(list)
    for (n, _), (p, _) in v.items():
        points[n].append(p)
    return points, edges


def crossed(of):
    return [(a, b) for a in of for b in of if a % 2 == 0 and b % 2 == 1]


def found(spark, sf, name, first, value):
    return {tuple(r[c] for c in first): r[value] for r in catalog.QUERIES[name](spark, sf).collect()}


def test_overlap_of_all_trees(spark, sf, trees):
    points, _ = trees
    want = {(a, b): sum(math.exp(-((p - q) @ (p - q)) / 2) for p in points[a] for q in points[b]) for a, b in crossed(points)}
    got = found(spark, sf, "overlap_score_whole", ("out_id", "in_id"), "score")
    assert len(got) == 9 and got == pytest.approx(want, abs=1e-4)


def test_expected_synapses_of_all_trees(spark, sf, trees):
    def term(e, f):
        u, v, r = e[1] - e[0], f[1] - f[0], (e[0] + e[1] - f[0] - f[1]) / 2
        return np.linalg.norm(np.cross(u, v)) * math.exp(-(r @ r) / 16) / (16 * math.pi) ** 1.5

    want = {(a, b): 4 * sum(term(e, f) for e in trees[1][a] for f in trees[1][b]) for a, b in crossed(trees[1])}
    got = found(spark, sf, "expected_synapses", ("a_id", "b_id"), "expected")
    assert len(got) == 9 and got == pytest.approx(want, abs=1e-3)


def gap(e, f, n=121):
    t = np.linspace(0, 1, n)[:, None]
    p, q = e[0] + t * (e[1] - e[0]), f[0] + t * (f[1] - f[0])
    return np.linalg.norm(p[:, None] - q[None], axis=2).min()


def test_potential_synapses_of_all_trees(spark, sf, trees):
    least, most = collections.Counter(), collections.Counter()
    for a, b in crossed(trees[1]):
        for e in trees[1][a]:
            for f in trees[1][b]:
                if (abs(e[0] - f[0]) <= 9).all():
                    g = gap(e, f)
                    least[a, b] += g <= 3.98
                    most[a, b] += g <= 4.15
    got = found(spark, sf, "potential_synapses", ("a_id", "b_id"), "n")
    assert len(got) == 9 and all(least[k] <= n <= most[k] for k, n in got.items()) and sum(got.values()) > 100
