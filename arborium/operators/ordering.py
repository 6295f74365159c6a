"""Depth-first order of trees by Euler tours: segments in order, renumbering.

A tour passes each edge twice, down to the child and up again. Each passage knows the one before it from its
siblings, children and parent, so tours are linked lists, and ranks in them by doubling give the order: about log2 of the
tree's size in joins, for all trees at once, whatever their shape. Children are visited by ascending point.

Defined results: a vertex whose parent isn't in the table is a root; an isolated vertex is a tree, and a segment, of one point;
parents that run in circles are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import apart, facts, without_circles
from ..ranking import list_sums, numbered, running
from ..scratch import written
from .topology import KEY, narrow


def rooted(vertices: DataFrame) -> DataFrame:
    """neuron_id, point_no, parent; parent is null for roots."""
    there = vertices.select("neuron_id", F.col("point_no").alias("parent"), F.lit(True).alias("there"))
    return vertices.select(*KEY, "parent").join(there, ["neuron_id", "parent"], "left").select(*KEY, F.when(F.col("there"), F.col("parent")).alias("parent"))


def siblings(known: DataFrame) -> DataFrame:
    """neuron_id, point_no, parent, place, older: each child with its parent's child before it, from a table of rooted()."""
    kids = written(numbered(known.filter("parent is not null"), ["neuron_id", "parent", "point_no"], "place"), "children")
    shifted = kids.select((F.col("place") + 1).alias("place"), F.col("neuron_id").alias("n2"), F.col("parent").alias("p2"), F.col("point_no").alias("before"))
    same = (F.col("neuron_id") == F.col("n2")) & (F.col("parent") == F.col("p2"))
    return kids.join(shifted, "place", "left").select(*KEY, "parent", "place", F.when(same, F.col("before")).alias("older"))


def depth_first(vertices: DataFrame) -> DataFrame:
    """neuron_id, point_no, parent, root, pre, size, depth, closed of each vertex.

    pre counts from 0 at the tree's root in depth-first order, size is the number of vertices in the subtree, and closed how many
    vertices up to this one, the root not, end a segment there (branches and ends).
    """
    small, large = apart(narrow(vertices))
    wanted = "neuron_id, point_no, above, root, pre long, size long, depth long, closed long, circle boolean"
    near = without_circles(facts(small, "order", wanted), "depth-first", "a list runs in a circle").withColumnRenamed("above", "parent")
    return near if large is None else near.unionByName(depth_first_by_tours(large))


def depth_first_by_tours(vertices: DataFrame) -> DataFrame:
    """depth_first() of trees of any size."""
    known = written(rooted(vertices), "rooted")
    kids = written(siblings(known), "siblings")
    below = kids.groupBy("neuron_id", F.col("parent").alias("point_no")).agg(F.max("point_no").alias("last"), F.count(F.lit(1)).alias("n"))
    above = kids.select("neuron_id", F.col("point_no").alias("parent"), F.lit(True).alias("inner"))
    arcs = kids.join(below, KEY, "left").join(above, ["neuron_id", "parent"], "left")
    down, up = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    before_down = F.when(F.col("older").isNotNull(), up("older")).when(F.col("inner"), down("parent"))
    before_up = F.when(F.col("last").isNotNull(), up("last")).otherwise(down("point_no"))
    ends = (F.coalesce("n", F.lit(0)) != 1).cast("long")
    root = F.when(F.col("inner").isNull() & F.col("older").isNull(), F.col("parent"))
    zero = F.lit(0).cast("long")
    going = lambda arc, before, root, pre, depth, closed: F.struct(arc.alias("arc"), before.alias("before"), root.alias("root"), pre.alias("pre"), depth.cast("long").alias("depth"), closed.alias("closed"))
    both = F.array(going(down("point_no"), before_down, root, zero + 1, F.lit(1), ends), going(up("point_no"), before_up, F.lit(None).cast("long"), zero, F.lit(-1), zero))
    tour = arcs.select("neuron_id", F.explode(both).alias("a")).select("neuron_id", "a.*")
    ranked = list_sums(tour, "arc", "before", "root", ["pre", "depth", "closed"]).withColumn("point_no", F.floor(F.col("arc") / 2))
    downs = F.pmod("arc", F.lit(2)) == 0
    first = lambda c: F.max(F.when(downs, F.col(c))).alias(c)
    inside = ranked.groupBy(*KEY).agg(F.max("root").alias("root"), first("pre"), (F.max(F.when(~downs, F.col("pre"))) - F.max(F.when(downs, F.col("pre"))) + 1).alias("size"), first("depth"), first("closed"))
    inside = written(inside.join(kids.select(*KEY, "parent"), KEY).select(*KEY, "parent", "root", "pre", "size", "depth", "closed"), "depth-first")
    trees = inside.groupBy("neuron_id", F.col("root").alias("point_no")).agg((F.count(F.lit(1)) + 1).alias("size"))
    roots = known.filter("parent is null").select(*KEY).join(trees, KEY, "left")
    tops = roots.select(*KEY, F.lit(None).cast("long").alias("parent"), F.col("point_no").alias("root"), zero.alias("pre"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), zero.alias("depth"), zero.alias("closed"))
    return inside.unionByName(tops)


def segment_order(vertices: DataFrame) -> DataFrame:
    """neuron_id, root, seg_id, pos, point_no: each tree's segments in depth-first order, heads included.

    A segment is closed by a vertex whose degree isn't 2; the next starts with the parent of the vertex that follows in the order.
    """
    walked = depth_first(vertices)
    children = walked.filter("parent is not null").groupBy("neuron_id", F.col("parent").alias("point_no")).agg(F.count(F.lit(1)).alias("n"))
    inner = walked.filter("parent is not null").join(children, KEY, "left")
    placed = written(inner.select("neuron_id", "root", *KEY[1:], "parent", "pre", (F.col("closed") - (F.coalesce("n", F.lit(0)) != 1).cast("long") + 1).alias("seg_id")), "segment-members")
    run = ["neuron_id", "root", "seg_id"]
    starts = placed.groupBy(*run).agg(F.min(F.struct("pre", "parent")).alias("s")).select(*run, F.col("s.pre").alias("from"), F.col("s.parent").alias("head"))
    one = F.lit(1).cast("long")
    points = placed.join(starts, run).select(*run, (F.col("pre") - F.col("from") + 2).alias("pos"), "point_no")
    heads = starts.select(*run, one.alias("pos"), F.col("head").alias("point_no"))
    alone = walked.filter("parent is null and size = 1").select("neuron_id", "root", one.alias("seg_id"), one.alias("pos"), "point_no")
    return points.unionByName(heads).unionByName(alone)


def tree_starts(trees: DataFrame) -> DataFrame:
    """neuron_id, root, before: of trees (neuron_id, root, size) the vertices in their neuron's larger trees, ties by root."""
    summed = running(trees, [F.col("neuron_id"), F.col("size").desc(), F.col("root")], "size", "so_far")
    own = written(summed.select("neuron_id", "root", "so_far"), "tree-starts")
    first = own.groupBy("neuron_id").agg(F.min("so_far").alias("first"))
    return own.join(first, "neuron_id").select("neuron_id", "root", (F.col("so_far") - F.col("first")).alias("before"))


def renumbered(vertices: DataFrame, only_if_needed: bool = False) -> DataFrame:
    """vertices with points numbered from 1 in depth-first order, the largest tree of a neuron first; parents come before their children.

    With only_if_needed the neurons whose parents come before their children already keep their numbers.
    """
    vertices = written(vertices, "vertices")
    walked = depth_first(vertices)
    starts = tree_starts(walked.filter("parent is null").select("neuron_id", "root", "size"))
    new = written(walked.join(starts, ["neuron_id", "root"]).select(*KEY, "parent", (F.col("before") + F.col("pre") + 1).alias("new")), "new-numbers")
    if only_if_needed:
        wrong = new.filter("parent >= point_no").select("neuron_id").distinct().withColumn("wrong", F.lit(True))
        new = new.join(wrong, "neuron_id", "left").withColumn("new", F.when(F.col("wrong"), F.col("new")).otherwise(F.col("point_no"))).drop("wrong")
    above = new.select("neuron_id", F.col("point_no").alias("parent"), F.col("new").alias("new_parent"))
    moved = new.join(above, ["neuron_id", "parent"], "left").select(*KEY, "new", F.coalesce("new_parent", F.lit(-1)).alias("new_parent"))
    out = vertices.join(moved, KEY)
    return out.select(*(F.col("new").alias(c) if c == "point_no" else F.col("new_parent").cast("long").alias(c) if c == "parent" else F.col(c) for c in vertices.columns))
