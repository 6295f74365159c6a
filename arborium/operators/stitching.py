"""Fragments of one tree joined at their closest points.

Fragments are the components of a vertex table: vertices with one root. All fragments of all trees are handled
together; a round is a set of joins, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrays import MOST_STITCHED, apart, in_arrays, stitched_rows
from ..scratch import written
from .editing import stitch_pairs
from .topology import KEY, narrow, nodes, to_root

AXES = ("x", "y", "z")


def gap(p: str, q: str) -> Column:
    return F.sqrt(sum((F.col(f"{p}{c}") - F.col(f"{q}{c}")) * (F.col(f"{p}{c}") - F.col(f"{q}{c}")) for c in AXES))


def turned(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """vertices with the links (neuron_id, a, b) as further edges and one root for what they connect, the smallest root of it.

    Links must not close a circle. Parents run away from the root: on undirected edges, found by walks that double.
    """
    from .topology import jump

    placed = written(to_root(vertices).select(*KEY, "root", "depth"), "placed")
    both = links.select("neuron_id", "a", "b").unionByName(links.select("neuron_id", F.col("b").alias("a"), F.col("a").alias("b")))
    of = lambda c, name: placed.select("neuron_id", F.col("point_no").alias(c), F.col("root").alias(name))
    between = both.join(of("a", "from_root"), ["neuron_id", "a"]).join(of("b", "to_root"), ["neuron_id", "b"])
    # The tree of fragments, hung from its smallest root: rounds from the root outwards, one for each fragment on the longest way.
    groups = fragment_groups(between)
    roots = groups.groupBy("neuron_id", "group").agg(F.min("root").alias("root")).select("neuron_id", "root")
    done = written(roots.select("neuron_id", "root"), "hung")
    hung = None
    front = done
    while True:
        step = between.join(front.withColumnRenamed("root", "from_root"), ["neuron_id", "from_root"]).join(done.withColumnRenamed("root", "to_root"), ["neuron_id", "to_root"], "left_anti")
        step = written(step.select("neuron_id", F.col("to_root").alias("root"), F.col("b").alias("entry"), F.col("a").alias("outer")), "hung")
        if not step.head(1):
            break
        hung = step if hung is None else hung.unionByName(step)
        front = step.select("neuron_id", "root")
        done = written(done.unionByName(front), "hung")
    if hung is None:
        return vertices
    # Inside a hung fragment, parents between its entry and its old root turn round.
    entries = hung.select("neuron_id", F.col("entry").alias("point_no"), "outer")
    from .editing import reroot_each

    return reroot_each(vertices, entries)


def fragment_groups(between: DataFrame) -> DataFrame:
    """(neuron_id, root, group): the fragments' connected components under links between their roots; each is named by its smallest root."""
    edges = written(between.select("neuron_id", F.col("from_root").alias("u"), F.col("to_root").alias("v")).distinct(), "fragment-links")
    state = written(edges.groupBy("neuron_id", F.col("u").alias("root")).agg(F.least(F.min("v"), F.col("u")).alias("group")), "fragments")
    while True:
        near = edges.join(state.select("neuron_id", F.col("root").alias("v"), F.col("group").alias("g")), ["neuron_id", "v"]).groupBy("neuron_id", F.col("u").alias("root")).agg(F.min("g").alias("g"))
        far = state.select("neuron_id", F.col("root").alias("group"), F.col("group").alias("g2"))
        joined = state.join(near, ["neuron_id", "root"]).withColumn("group", F.least("group", "g")).join(far, ["neuron_id", "group"], "left")
        after = written(joined.select("neuron_id", "root", F.least("group", F.coalesce("g2", "group")).alias("group")), "fragments")
        if not after.join(state.withColumnRenamed("group", "was"), ["neuron_id", "root"]).filter("group <> was").head(1):
            return after
        state = after


def stitch_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """One tree (neuron_id, point_no, parent, x, y, z) of each pair of trees: b's points are numbered after a's, and b is hung by its end that is closest to an end of a.

    a and b are vertex tables with column pair in place of neuron_id, one tree a pair.
    """
    from .editing import reroot_each

    best = stitch_pairs(a, b).select(F.col("pair").alias("neuron_id"), "a_point", "b_point")
    top = a.groupBy("pair").agg(F.max("point_no").alias("top"))
    shift = lambda c: (F.col(c) + F.coalesce("top", F.lit(0))).alias(c)
    later = b.join(top, "pair", "left").select(F.col("pair").alias("neuron_id"), shift("point_no"), F.when(F.col("parent") == -1, -1).otherwise(F.col("parent") + F.coalesce("top", F.lit(0))).alias("parent"), *AXES)
    both = a.select(F.col("pair").alias("neuron_id"), "point_no", "parent", *AXES).unionByName(later)
    entries = best.join(top.withColumnRenamed("pair", "neuron_id"), "neuron_id").select("neuron_id", shift("b_point"), "a_point").select("neuron_id", F.col("b_point").alias("point_no"), F.col("a_point").alias("outer"))
    return reroot_each(both, entries)


def stitch(vertices: DataFrame, longest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, links): each tree's fragments joined by the links of a minimum spanning tree over them, up to a length.

    Rounds of nearest links: each group of fragments takes its shortest link to another group (ends and isolated points
    count; ties go to smaller points), so groups at least halve in number each round. The links are those of the only minimum
    spanning tree by length and points, so small trees take them in that order, in arrays of a task (arrays.py).
    """
    vertices = written(vertices, "vertices")
    plain = narrow(vertices, *(F.col(c).cast("double").alias(c) for c in AXES))
    unknown = F.lit(False)
    for c in AXES:
        unknown = unknown | F.col(c).isNull()
    small, large = apart(plain, MOST_STITCHED, unknown)
    types = dict(plain.dtypes)
    solve = lambda table: stitched_rows(table, longest)
    found = written(in_arrays(small, solve, f"neuron_id {types['neuron_id']}, a {types['point_no']}, b {types['point_no']}, gap double, parent long"), "stitched")
    links = found.filter("b is not null").select("neuron_id", "a", "b", "gap")
    parents = found.filter("b is null").select("neuron_id", F.col("a").alias("point_no"), F.col("parent").alias("new"))
    near = vertices.join(parents, KEY).withColumn("parent", F.col("new").cast(dict(vertices.dtypes)["parent"])).select(*vertices.columns)
    if large is None:
        return near, links
    joined, more = stitch_by_joins(vertices.join(large.select("neuron_id").distinct(), "neuron_id", "left_semi"), longest)
    return near.unionByName(joined), links.unionByName(more)


def stitch_by_joins(vertices: DataFrame, longest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """stitch() of trees of any size."""
    known = nodes(vertices).filter("degree <= 1 or parent = -1").select(*KEY, *AXES)
    placed = written(known.join(to_root(vertices).select(*KEY, "root"), KEY), "ends")
    group = written(placed.select("neuron_id", "root").distinct().withColumn("group", F.col("root")), "groups")
    links = None
    while True:
        at = placed.join(group, ["neuron_id", "root"])
        side = lambda p, n: at.select("neuron_id", F.col("point_no").alias(n), F.col("group").alias(f"g{p}"), *(F.col(c).alias(f"{p}{c}") for c in AXES))  # noqa: B023, E731
        pairs = side("p", "a").join(side("q", "b"), "neuron_id").filter("gp <> gq").withColumn("gap", gap("p", "q"))
        pairs = pairs if longest is None else pairs.filter(F.col("gap") <= longest)
        best = pairs.groupBy("neuron_id", "gp").agg(F.min(F.struct("gap", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))).alias("m"))
        found = written(best.select("neuron_id", F.col("m.low").alias("a"), F.col("m.high").alias("b"), F.col("m.gap").alias("gap")).distinct(), "stitches")
        if not found.head(1):
            break
        links = found if links is None else links.unionByName(found)
        of = placed.join(group, ["neuron_id", "root"]).select(*KEY, "group")
        name = lambda c, g: of.select("neuron_id", F.col("point_no").alias(c), F.col("group").alias(g))  # noqa: B023, E731
        joined = found.join(name("a", "from_root"), ["neuron_id", "a"]).join(name("b", "to_root"), ["neuron_id", "b"])
        both = joined.select("neuron_id", "from_root", "to_root").unionByName(joined.select("neuron_id", F.col("to_root").alias("from_root"), F.col("from_root").alias("to_root")))
        merged = fragment_groups(both).select("neuron_id", F.col("root").alias("group"), F.col("group").alias("new"))
        group = written(group.join(merged, ["neuron_id", "group"], "left").select("neuron_id", "root", F.coalesce("new", "group").alias("group")), "groups")
    if links is None:
        empty = placed.limit(0).select("neuron_id", F.col("point_no").alias("a"), F.col("point_no").alias("b"), F.lit(0.0).alias("gap"))
        return vertices, empty
    links = written(links, "stitches")
    return turned(vertices, links), links
