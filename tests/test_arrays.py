"""Trees and graphs in arrays of a task: the same rows as by joins, in a number of tables that doesn't grow with the trees."""

import random

import pytest
from pyspark.sql import functions as F

from arborium import arrays as A
from arborium.operators import graphs as R
from arborium.operators import morphometry as M
from arborium.operators import ordering as O
from arborium.operators import stitching as H
from arborium.operators import topology as T
from arborium.operators import vector_clouds as V
from arborium.operators import geometry as G
from arborium.operators import editing as E
from arborium.plans import orders, tables
from arborium import scratch, skew

COLUMNS = "neuron_id long, point_no long, parent long, x double, y double, z double"


@pytest.fixture(scope="module")
def trees(spark):
    """Trees of 1 to 60 vertices: chains, stars, random ones, parents that are missing, several roots, points in no order."""
    rng, rows = random.Random(5), []
    for n in range(40):
        size = rng.choice([1, 2, 5, 30, 60])
        names = rng.sample(range(1, 500), size)
        for k, p in enumerate(names):
            up = names[k - 1] if n % 4 == 0 else names[0] if n % 4 == 1 else rng.choice(names[:k]) if k else -1
            up = -1 if k == 0 or rng.random() < 0.05 else 9999 if rng.random() < 0.02 else up
            rows.append((n, p, up, *(round(rng.uniform(0, 50), 3) for _ in range(3))))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def edges_of(v):
    more = v.filter("point_no % 4 = 0").select("neuron_id", F.col("point_no").alias("a"), (F.col("point_no") + 1).alias("b"))
    return orders.undirected(v).unionByName(more)


CASES = {
    "to_root": lambda v: T.to_root(v).withColumn("dist", F.round("dist", 9)),
    "subtree_max": lambda v: T.subtree_max(v, F.struct(F.when(F.col("x") > 10, F.col("x")).alias("x"), (-F.col("point_no")).alias("m"))),
    "subtree_flag": lambda v: T.subtree_max(v, F.col("x") > 45),
    "segments": T.segments,
    "segment_graph": lambda v: T.segment_graph(v).withColumn("length", F.round("length", 9)),
    "strahler": T.strahler,
    "strahler_classical": lambda v: T.strahler(v, classical=True),
    "depth_first": O.depth_first,
    "segment_order": O.segment_order,
    "renumbered": O.renumbered,
    "oriented": lambda v: R.oriented(v, edges_of(v), v.filter("point_no % 7 = 0")),
    "from_first_end": lambda v: R.oriented(v, edges_of(v)),
    "problems": lambda v: R.problems(v.unionByName(v.filter("point_no % 9 = 0")), edges_of(v)),
    "spine": M.spine,
    "spine_length": lambda v: M.spine_length(v).withColumn("spine_length", F.round("spine_length", 9)),
    "sholl": lambda v: M.sholl(v, 10.0, 100.0),
    "resample": lambda v: G.resample(v, 7.0).select("neuron_id", "tail", "pos", *(F.round(c, 8).alias(c) for c in "xyz")),
    "topology_features": lambda v: V.topology_features(v).withColumn("distance", F.round("distance", 9)),
    "prune_twigs": lambda v: E.prune_twigs(v, 40.0),
    "stitch": lambda v: H.stitch(v)[0],
    "stitch_links": lambda v: H.stitch(v, 30.0)[1],
}


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("case", CASES)
def test_arrays_give_what_joins_give(spark, trees, case, monkeypatch):
    monkeypatch.setattr(A, "BATCH_ROWS", 100)
    arrays = rows(CASES[case](trees))
    for module in (A, H):
        monkeypatch.setattr(module, "MOST_STITCHED", 25)
    monkeypatch.setattr(A, "MOST_ROWS", 25)
    assert arrays == rows(CASES[case](trees)) and (arrays or case == "stitch_links")


@pytest.mark.parametrize("case", ["to_root", "subtree_flag", "segments", "strahler", "depth_first", "from_first_end", "problems", "spine", "stitch"])
def test_tables_that_are_written_do_not_grow_with_the_depth(spark, case, monkeypatch):
    """By joins each doubling of the depth took one more shuffle and one more table of all rows."""
    count = []
    for module in (T, O, R, M, H, E, V, A):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", lambda df, name: count.append(name) or scratch.written(df, name))
    n_of = []
    for size in (4, 400):
        v = spark.createDataFrame([(1, p, p - 1 if p > 1 else -1, float(p % 7), float(p % 60), 0.0) for p in range(1, size + 1)], COLUMNS)
        count.clear()
        CASES[case](v).collect()
        n_of.append(len(count))
    assert n_of[0] == n_of[1] <= 16


def test_parts_that_number_rows_have_so_many_rows(spark, monkeypatch):
    """A part that sorts the events of users has a bounded number of rows: there are more parts where there are more rows."""
    monkeypatch.setattr(skew, "TASK_ROWS", 40)
    sf = "/root/testdata/sf0.001"
    assert tables.trees(spark, sf).rdd.getNumPartitions() >= tables.table(spark, sf, "events").count() // 40
    assert tables.clouds(spark, sf).rdd.getNumPartitions() >= tables.table(spark, sf, "lineitem").count() // 40
    resampled = G.resample(tables.trees(spark, sf, "caterpillar"), 10.0)
    assert resampled.rdd.getNumPartitions() >= tables.table(spark, sf, "events").count() // 40


def test_circles_are_an_error(spark):
    v = spark.createDataFrame([(1, 1, 3, 0.0, 0.0, 0.0), (1, 2, 1, 1.0, 0.0, 0.0), (1, 3, 2, 2.0, 0.0, 0.0)], COLUMNS)
    for call in (T.to_root, T.segments, T.strahler, O.depth_first):
        with pytest.raises(ValueError, match="circle"):
            call(v).collect()
