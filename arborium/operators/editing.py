"""Edits of trees: each takes a vertex table and gives one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import written
from .topology import KEY, edges, jump, nodes, segment_graph, strahler, subtree_max, to_root


def keep(vertices: DataFrame, kept: DataFrame) -> DataFrame:
    """The vertices named in kept; a child whose parent goes becomes a root."""
    left = vertices.join(kept.select(*KEY), KEY, "left_semi")
    alive = left.select("neuron_id", F.col("point_no").alias("parent"), F.lit(True).alias("alive"))
    return left.join(alive, ["neuron_id", "parent"], "left").withColumn("parent", F.when(F.col("alive"), F.col("parent")).otherwise(F.lit(-1))).select(*vertices.columns)


def prune_vertices(vertices: DataFrame, gone: DataFrame, invert: bool = False) -> DataFrame:
    """Without the vertices named in gone, or with invert those alone."""
    return keep(vertices, gone if invert else vertices.join(gone.select(*KEY), KEY, "left_anti"))


def subset(vertices: DataFrame, where: Column, invert: bool = False) -> DataFrame:
    """The vertices for which a predicate holds; null counts as false."""
    holds = F.coalesce(where, F.lit(False))
    return keep(vertices, vertices.filter(~holds if invert else holds))


def prune_edges(vertices: DataFrame, cut: DataFrame) -> DataFrame:
    """Without the edges (neuron_id, a, b), whatever their direction; vertices left without any edge go."""
    both = cut.select("neuron_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.lit(True).alias("cut")).distinct()
    keyed = vertices.withColumns({"low": F.least("point_no", "parent"), "high": F.greatest("point_no", "parent")}).join(both, ["neuron_id", "low", "high"], "left")
    left = keyed.withColumn("parent", F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("parent"))).select(*vertices.columns)
    return keep(left, nodes(left).filter("degree > 0"))


def prune_strahler(vertices: DataFrame, orders: tuple[int, ...] = (1, 2), classical: bool = False) -> DataFrame:
    return keep(vertices, strahler(vertices, classical).filter(~F.col("strahler").isin(*orders)))


def ancestors_of(vertices: DataFrame, marked: DataFrame) -> DataFrame:
    """neuron_id, point_no of the marked vertices and of all vertices between them and their roots."""
    flagged = vertices.join(marked.select(*KEY, F.lit(True).alias("marked")).distinct(), KEY, "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    return subtree_max(flagged, F.col("marked")).filter("best").select(*KEY)


def distal_to(vertices: DataFrame, at: DataFrame) -> DataFrame:
    """neuron_id, point_no of the vertices at and beyond those named in at."""
    named = at.select(*KEY, F.lit(True).alias("stop")).distinct()
    linked = vertices.join(named, KEY, "left")
    alive = vertices.select("neuron_id", F.col("point_no").alias("parent"), F.lit(True).alias("alive"))
    links = linked.join(alive, ["neuron_id", "parent"], "left").select("neuron_id", F.col("point_no").alias("node"), F.when(F.col("stop").isNull() & F.col("alive"), F.col("parent")).alias("next"), F.lit(0.0).alias("dist"))
    reached = jump(links).select("neuron_id", F.col("last").alias("point_no"), "node")
    return reached.join(named, KEY, "left_semi").select("neuron_id", F.col("node").alias("point_no"))


def reroot_each(vertices: DataFrame, entries: DataFrame) -> DataFrame:
    """Each entry (neuron_id, point_no, outer) becomes the child of outer; parents are turned round on the way to its old root.

    A tree may have several entries, one a fragment at most; all other parents stay.
    """
    way = ancestors_of(vertices, entries)
    turned = vertices.select("neuron_id", F.col("point_no").alias("below"), F.col("parent").alias("point_no")).join(way.select("neuron_id", F.col("point_no").alias("below")), ["neuron_id", "below"], "left_semi")
    found = vertices.join(way.withColumn("on_way", F.lit(True)), KEY, "left").join(turned, KEY, "left").join(entries.select(*KEY, "outer"), KEY, "left")
    return found.withColumn("parent", F.coalesce("outer", F.when(F.col("on_way"), F.col("below")).otherwise(F.col("parent")))).select(*vertices.columns)


def reroot(vertices: DataFrame, at: DataFrame) -> DataFrame:
    """With the vertices named in at (one a tree) as roots: parents are turned round on the way to the old root."""
    way = ancestors_of(vertices, at)
    turned = vertices.select("neuron_id", F.col("point_no").alias("below"), F.col("parent").alias("point_no")).join(way.select("neuron_id", F.col("point_no").alias("below")), ["neuron_id", "below"], "left_semi")
    on_way = way.withColumn("on_way", F.lit(True))
    found = vertices.join(on_way, KEY, "left").join(turned, KEY, "left")
    return found.withColumn("parent", F.when(F.col("on_way"), F.coalesce("below", F.lit(-1))).otherwise(F.col("parent"))).select(*vertices.columns)


def reroot_nearest(vertices: DataFrame, x: float, y: float, z: float) -> DataFrame:
    """With each tree's vertex nearest to a point as its root; ties go to the smaller vertex."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)
    return reroot(vertices, vertices.groupBy("neuron_id").agg(F.min(F.struct(d2.alias("d2"), "point_no")).alias("m")).select("neuron_id", F.col("m.point_no").alias("point_no")))


def prune_twigs(vertices: DataFrame, length: float) -> DataFrame:
    """Without twigs up to a length: a leaf with a branch point within it goes, back to the farthest such branch point.

    Ways up within the length are joined to ways twice as long while there are any, and each leaf then takes the longest
    that still fits, next the next longest: joins follow the logarithm of the number of branch points within the length.
    """
    vertices = written(vertices, "vertices")
    graph = written(segment_graph(vertices).select("neuron_id", "head", "tail", "length"), "segment-graph")
    known = written(nodes(vertices).select(*KEY, "n_children", "is_branch", "parent"), "nodes")
    leaves = known.filter("n_children = 0 and parent <> -1")
    branch = known.filter("is_branch").select("neuron_id", F.col("point_no").alias("head"))
    within = graph.filter(F.col("length") <= length).join(branch, ["neuron_id", "head"], "left_semi")
    ways = [written(within.select("neuron_id", F.col("tail").alias("at"), F.col("head").alias("to"), F.col("length").alias("far")), "ways")]
    while ways[-1].head(1):
        on = ways[-1].select("neuron_id", F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"))
        twice = ways[-1].join(on, ["neuron_id", "to"]).select("neuron_id", "at", F.col("beyond").alias("to"), (F.col("far") + F.col("more")).alias("far"))
        ways.append(written(twice.filter(F.col("far") <= length), "ways"))
    front = leaves.select("neuron_id", F.col("point_no").alias("leaf"), F.col("point_no").alias("at"), F.lit(0.0).alias("far"))
    for way in reversed(ways[:-1]):
        step = way.select("neuron_id", "at", "to", F.col("far").alias("more"))
        fits = F.col("to").isNotNull() & (F.col("far") + F.col("more") <= length)
        front = written(front.join(step, ["neuron_id", "at"], "left").select("neuron_id", "leaf", F.when(fits, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(fits, F.col("far") + F.col("more")).otherwise(F.col("far")).alias("far")), "twig-walk")
    chosen = front.filter("at <> leaf").select("neuron_id", "leaf", F.col("at").alias("point_no"))
    if not chosen.head(1):
        return vertices
    stay = leaves.join(chosen.select("neuron_id", F.col("leaf").alias("point_no")), KEY, "left_anti").select(*KEY)
    roots = vertices.filter("parent = -1").select(*KEY)
    return keep(vertices, ancestors_of(vertices, stay.unionByName(chosen.select(*KEY)).unionByName(roots)))


def simplify(vertices: DataFrame, n: int, invert: bool = False) -> DataFrame:
    """The n + 1 longest root-to-leaf ways, each counted without what longer ones have taken.

    A vertex belongs to the way of the farthest leaf beyond it, so ways and their own lengths need one pass up.
    """
    vertices = written(vertices, "vertices")
    far = to_root(vertices).select(*KEY, "dist")
    placed = written(vertices.join(far, KEY), "placed")
    leaf = F.struct(F.col("dist").alias("dist"), (-F.col("point_no")).alias("minus"))
    owner = subtree_max(placed, leaf).select(*KEY, (-F.col("best.minus")).alias("leaf"), F.col("best.dist").alias("reach"))
    steps = owner.join(edges(vertices).select(*KEY, "length"), KEY, "left")
    own = steps.groupBy("neuron_id", "leaf").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("own"))
    best = own.withColumn("k", F.row_number().over(W.partitionBy("neuron_id").orderBy(F.desc("own"), "leaf"))).filter(F.col("k") <= n + 1)
    kept = owner.join(best.select("neuron_id", "leaf"), ["neuron_id", "leaf"], "left_semi")
    return keep(vertices, owner.join(kept, KEY, "left_anti") if invert else kept)


def stitch_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair, a_point, b_point, gap: the closest end points of the two trees of each pair.

    a and b are vertex tables with column pair in place of neuron_id; the ends of one pair are compared.
    """
    ends = lambda v, s: nodes(v.withColumnRenamed("pair", "neuron_id")).filter("is_end").select("neuron_id", F.col("point_no").alias(f"{s}_point"), *(F.col(c).alias(f"{s}{c}") for c in "xyz"))
    joined = ends(a, "a").join(ends(b, "b"), "neuron_id")
    gap = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"))
    best = joined.groupBy("neuron_id").agg(F.min(F.struct(gap.alias("gap"), "a_point", "b_point")).alias("m"))
    return best.select(F.col("neuron_id").alias("pair"), "m.a_point", "m.b_point", "m.gap")
