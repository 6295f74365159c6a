"""Undirected graphs as tables of vertices and edges: components, spanning forests, and trees that run away from an origin.

Graphs are many and are handled together. A spanning forest comes from rounds in which each component takes its least edge to
another one (at least halving their number); its Euler tour, a linked list of passages from vertex to vertex,
gives each edge its direction. Graphs of few vertices and edges take these rounds in arrays of a task (arrays.py).

Defined results: edges are unordered, repeated ones count once, and those from a vertex to itself are left out; an edge whose end
isn't a vertex is reported and left out; names that are repeated are reported and count once; circles are reported, and
the edge of a circle that is least needed (the largest by smaller and larger end) is left out of the forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import Graphs, apart, component_rows, in_arrays, oriented_rows, problem_rows
from ..ranking import list_sums, numbered
from ..scratch import remove, written

#: Rounds of halving that any graph within 64-bit numbers needs.
MOST_ROUNDS = 66


def rows_apart(vertices: DataFrame, edges: DataFrame, origins: DataFrame | None = None) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame] | None]:
    """Rows (neuron_id, kind, a, b) of small graphs, and the vertices, edges and origins of the others, None if there are none."""
    none = F.lit(None).cast("long")
    kind = lambda k: F.lit(k).cast("tinyint").alias("kind")
    rows = vertices.select("neuron_id", kind(Graphs.VERTICES), F.col("point_no").cast("long").alias("a"), none.alias("b"))
    rows = rows.unionByName(edges.select("neuron_id", kind(Graphs.EDGES), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    if origins is not None:
        rows = rows.unionByName(origins.select("neuron_id", kind(Graphs.ORIGINS), F.col("point_no").cast("long").alias("a"), none.alias("b")))
    small, large = apart(written(rows, "graphs"))
    if large is None:
        return small, None
    of = lambda k: large.filter(F.col("kind") == k)
    point = lambda df: df.select("neuron_id", F.col("a").alias("point_no"))
    return small, (point(of(Graphs.VERTICES)), of(Graphs.EDGES).select("neuron_id", "a", "b"), point(of(Graphs.ORIGINS)))


def checked(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (neuron_id, point_no) and (neuron_id, a, b), a < b, without repeats and without edges whose end is missing."""
    points = written(vertices.select("neuron_id", "point_no").distinct(), "graph-points")
    once = edges.select("neuron_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    named = lambda c: points.withColumnRenamed("point_no", c)
    return points, written(once.join(named("a"), ["neuron_id", "a"], "left_semi").join(named("b"), ["neuron_id", "b"], "left_semi").select("neuron_id", "a", "b"), "graph-edges")


def ends_of(links: DataFrame) -> DataFrame:
    """(neuron_id, node, last) of links (neuron_id, node, next), each node's last one; next of a last node is itself."""
    state = written(links.select("neuron_id", "node", "next"), "hooks")
    for _ in range(MOST_ROUNDS):
        far = state.select("neuron_id", F.col("node").alias("next"), F.col("next").alias("beyond"))
        new = written(state.join(far, ["neuron_id", "next"]).select("neuron_id", "node", F.col("beyond").alias("next"), (F.col("beyond") != F.col("next")).alias("moved")), "hooks")
        remove(state)
        state = new
        if not state.filter("moved").head(1):
            return state.select("neuron_id", "node", F.col("next").alias("last"))
    raise ValueError("the links run in a circle")


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (neuron_id, point_no, component), a component named by one of its vertices, and (neuron_id, a, b) of the forest's edges."""
    small, large = rows_apart(vertices, edges)
    found = written(in_arrays(small, component_rows, f"neuron_id {dict(small.dtypes)['neuron_id']}, a long, b long, component long"), "forest")
    of, forest = found.filter("b is null").select("neuron_id", F.col("a").alias("point_no"), "component"), found.filter("b is not null").select("neuron_id", "a", "b")
    if large is None:
        return of, forest
    more_of, more = forest_by_joins(*large[:2])
    return of.unionByName(more_of), forest.unionByName(more)


def forest_by_joins(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spanning_forest() of graphs of any size."""
    points, once = checked(vertices, edges)
    of = written(points.withColumn("component", F.col("point_no")), "components")
    open_ = once.select("neuron_id", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    chosen = None
    for _ in range(MOST_ROUNDS):
        sides = open_.select("neuron_id", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("other")))).alias("s"), "a", "b")
        best = written(sides.select("neuron_id", "s.c", "s.other", "a", "b").groupBy("neuron_id", "c").agg(F.min(F.struct("a", "b", "other")).alias("m")).select("neuron_id", "c", "m.*"), "least-edges")
        if not best.head(1):
            break
        found = best.select("neuron_id", "a", "b").distinct()
        chosen = found if chosen is None else chosen.unionByName(found)
        back = best.select("neuron_id", F.col("c").alias("other"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        mutual = (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col("c") < F.col("other"))
        hooks = best.join(back, ["neuron_id", "other"], "left").select("neuron_id", F.col("c").alias("node"), F.when(mutual, F.col("c")).otherwise(F.col("other")).alias("next"))
        roots = written(ends_of(hooks), "merged")
        new = lambda df, c: df.join(roots.select("neuron_id", F.col("node").alias(c), "last"), ["neuron_id", c], "left").withColumn(c, F.coalesce("last", c)).drop("last")  # noqa: B023, E731
        of = written(new(of, "component").select("neuron_id", "point_no", "component"), "components")
        open_ = written(new(new(open_, "ca"), "cb").filter("ca <> cb").select("neuron_id", "a", "b", "ca", "cb"), "open-edges")
    forest = once.limit(0) if chosen is None else written(chosen, "forest")
    return of, forest


def problems(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """neuron_id, vertices, edges, components, circles, repeated_names, loose_edges of each graph; circles counts edges beyond a forest."""
    small, large = rows_apart(vertices, edges)
    counted = "".join(f", {c} long" for c in ("vertices", "edges", "components", "circles", "repeated_names", "loose_edges"))
    near = in_arrays(small, problem_rows, f"neuron_id {dict(small.dtypes)['neuron_id']}{counted}")
    return near if large is None else near.unionByName(problems_by_joins(*large[:2]))


def problems_by_joins(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """problems() of graphs of any size."""
    points, once = checked(vertices, edges)
    of, _ = forest_by_joins(points, once)
    count = lambda df, name: df.groupBy("neuron_id").agg(F.count(F.lit(1)).alias(name))
    given = vertices.groupBy("neuron_id", "point_no").agg(F.count(F.lit(1)).alias("n")).groupBy("neuron_id").agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("n") > 1).alias("repeated_names"))
    proper = edges.select("neuron_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    out = given.join(count(once, "edges"), "neuron_id", "left").join(count(proper, "proper"), "neuron_id", "left").join(of.groupBy("neuron_id").agg(F.count_distinct("component").alias("components")), "neuron_id")
    edges_, proper_ = F.coalesce("edges", F.lit(0)), F.coalesce("proper", F.lit(0))
    return out.select("neuron_id", "vertices", edges_.alias("edges"), "components", (edges_ - F.col("vertices") + F.col("components")).alias("circles"), "repeated_names", (proper_ - edges_).alias("loose_edges"))


def component_roots(of: DataFrame, forest: DataFrame, origins: DataFrame | None) -> DataFrame:
    """neuron_id, component, root, size, master of each component.

    The root is the smallest origin (neuron_id, point_no) in the component, else its first end, else its only vertex. The master
    component holds an origin, else it has the most vertices; ties go to the smaller first vertex.
    """
    degree = forest.select("neuron_id", F.explode(F.array("a", "b")).alias("point_no")).groupBy("neuron_id", "point_no").agg(F.count(F.lit(1)).alias("degree"))
    known = of.join(degree, ["neuron_id", "point_no"], "left")
    known = known.withColumn("given", F.lit(False)) if origins is None else known.join(origins.select("neuron_id", "point_no").distinct().withColumn("given", F.lit(True)), ["neuron_id", "point_no"], "left")
    given, ends = F.when(F.col("given"), F.col("point_no")), F.when(F.coalesce("degree", F.lit(0)) <= 1, F.col("point_no"))
    parts = known.groupBy("neuron_id", "component").agg(F.min(given).alias("origin"), F.min(ends).alias("end"), F.min("point_no").alias("first"), F.count(F.lit(1)).alias("size"))
    better = F.struct(F.col("origin").isNotNull().alias("given"), F.col("size").alias("size"), (-F.col("first")).alias("minus"))
    top = parts.groupBy("neuron_id").agg(F.max_by("component", better).alias("top"))
    return parts.join(top, "neuron_id").select("neuron_id", "component", F.coalesce("origin", "end", "first").alias("root"), "size", (F.col("component") == F.col("top")).alias("master"))


def oriented(vertices: DataFrame, edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """neuron_id, point_no, parent, root, size, master of each vertex: the graph's spanning forest as trees that run away from their roots."""
    small, large = rows_apart(vertices, edges, origins)
    near = written(in_arrays(small, oriented_rows, f"neuron_id {dict(small.dtypes)['neuron_id']}, point_no long, parent long, root long, size long, master boolean"), "oriented")
    return near if large is None else near.unionByName(oriented_by_tours(*large[:2], None if origins is None else large[2]))


def oriented_by_tours(vertices: DataFrame, edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """oriented() of graphs of any size."""
    of, forest = forest_by_joins(vertices, edges)
    parts = written(component_roots(of, forest, origins), "component-roots")
    placed = written(of.join(parts, ["neuron_id", "component"]).select("neuron_id", "point_no", "root", "size", "master"), "graph-trees")
    arcs = forest.select("neuron_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(forest.select("neuron_id", F.col("b").alias("u"), F.col("a").alias("v")))
    out_of = written(numbered(arcs, ["neuron_id", "u", "v"], "place"), "passages")
    spans = out_of.groupBy("neuron_id", "u").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    starts = parts.select("neuron_id", F.col("root").alias("u"), F.lit(True).alias("starts"))
    # Before u -> v comes the passage into u from its neighbour before v, in a circle; the root's first one starts the list.
    turned = out_of.join(spans, ["neuron_id", "u"]).join(starts, ["neuron_id", "u"], "left")
    first = F.col("place") == F.col("low")
    asked = turned.select("neuron_id", "u", "v", F.when(~(first & F.coalesce("starts", F.lit(False))), F.when(first, F.col("high")).otherwise(F.col("place") - 1)).alias("place"))
    seen = out_of.select("place", F.col("v").alias("w"))
    arc = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    one = F.lit(1).cast("long")
    inner = asked.filter("place is not null").join(seen, "place").select("neuron_id", arc("u", "v").alias("arc"), arc("w", "u").alias("before"), one.alias("at"))
    heads = asked.filter("place is null").select("neuron_id", arc("u", "v").alias("arc"), F.lit(None).cast("struct<u:bigint,v:bigint>").alias("before"), one.alias("at"))
    ranked = list_sums(inner.unionByName(heads).withColumn("nothing", F.lit(0)), "arc", "before", "nothing", ["at"])
    pair = ranked.select("neuron_id", F.col("arc.u").alias("u"), F.col("arc.v").alias("v"), "at").groupBy("neuron_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min_by(F.struct("u", "v"), "at").alias("down"))
    parents = pair.select("neuron_id", F.col("down.v").alias("point_no"), F.col("down.u").alias("parent"))
    return placed.join(parents, ["neuron_id", "point_no"], "left").select("neuron_id", "point_no", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), "root", "size", "master")
