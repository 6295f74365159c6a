"""What operators send as data grows: nothing with a row a point is broadcast or copied to cells around it without need."""

import re

import numpy as np
import pytest

from arborium.operators import distances, spatial
from arborium.plans import catalog

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def seen(monkeypatch):
    """The plans of all tables that nearest neighbours and mesh distances write, by name."""
    plans = {}
    for module in (spatial, distances):

        def record(df, name, write=module.written):
            plans.setdefault(name, []).append((optimized(df), planned(df)))
            return write(df, name)

        monkeypatch.setattr(module, "written", record)
    return plans


@pytest.mark.parametrize("name", ["dotprops", "knn", "prune_by_distance"])
def test_points_and_their_cells_are_not_broadcast(spark, seen, name):
    got = catalog.QUERIES[name](spark, SF)
    assert got.count()
    for _, plan in seen["near"]:
        met = plan[: plan.index("Generate")]
        assert "SortMergeJoin" in met and "Broadcast" not in met
    assert "BroadcastHashJoin" not in planned(got)


def test_points_are_not_copied_to_the_cells_around_them(spark, seen):
    assert catalog.QUERIES["mesh_distance"](spark, SF).count()
    assert seen["mesh-near"] and not any("Generate" in plan for plan, _ in seen["mesh-near"])


def test_numbers_of_cells_are_made_once_an_image(spark):
    plan = optimized(catalog.QUERIES["unmask"](spark, SF))
    assert "explode" in plan and not re.search(r"Aggregate \[image_id#\d+L?, pos", plan)


def test_many_triangles_are_joined_by_sorting(spark, monkeypatch):
    """The same distances whether the triangles' cells are broadcast or not."""
    rng = np.random.default_rng(3)
    faces = spark.createDataFrame([(1, "r", k, a, b, c) for k, (a, b, c) in enumerate([(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)])], "mesh_id long, region string, face long, v1 long, v2 long, v3 long")
    vertices = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 4.0, 0.0, 0.5), (1, 3, 0.0, 3.0, 0.0), (1, 4, 1.0, 1.0, 5.0)], "mesh_id long, vertex long, x double, y double, z double")
    points = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(rng.uniform(-3, 6, (80, 3)))], "mesh_id long, point long, x double, y double, z double")
    get = lambda: {r.point: r.distance for r in distances.distances(points, faces, vertices).collect()}
    want = get()
    monkeypatch.setattr(distances, "FEW_CELLS", 0)
    assert len(want) == 80 and get() == want
