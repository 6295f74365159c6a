"""Trees as tables of vertices.

A vertex table has neuron_id, point_no, parent (-1 for a root) and further columns. All operators take
and give DataFrames keyed by neuron_id, so one tree and millions run through the same plan. Walks
along a tree double their reach each round (pointer jumping): a tree of depth d takes about log2(d)
joins, whatever its size. Trees of few vertices take the same rounds in arrays of a task (arrays.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..arrays import apart, facts, without_circles
from ..scratch import remove, written

KEY = ["neuron_id", "point_no"]


def distance(*names: tuple[str, str]) -> Column:
    """Euclidean distance between two sets of coordinate columns."""
    return F.sqrt(sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in names))


def edges(vertices: DataFrame) -> DataFrame:
    """A row for each vertex that has its parent in the table: neuron_id, point_no, parent, both ends, length."""
    up = vertices.select("neuron_id", F.col("point_no").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return vertices.join(up, ["neuron_id", "parent"]).withColumn("length", distance(("x", "px"), ("y", "py"), ("z", "pz")))


def nodes(vertices: DataFrame) -> DataFrame:
    """Vertices with n_children, degree and the flags is_root, is_end, is_branch; isolated ones are neither root nor end."""
    children = vertices.filter("parent <> -1").groupBy("neuron_id", F.col("parent").alias("point_no")).agg(F.count(F.lit(1)).alias("n_children"))
    known = vertices.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    degree = F.col("n_children") + (F.col("parent") != -1).cast("long")
    return known.withColumns({"degree": degree}).withColumns(
        {"is_root": (F.col("parent") == -1) & (F.col("degree") > 0), "is_end": F.col("degree") == 1, "is_branch": F.col("degree") > 2}
    )


def jump(links: DataFrame, key: str = "node") -> DataFrame:
    """Follows links (neuron_id, node, next, dist, hops) to their ends.

    next is null where a walk ends. Gives neuron_id, node, last, dist, hops: the last node that is
    reached, the summed distance and the number of steps. Walks that have ended are joined no more.
    """
    walks = links.select("neuron_id", key, F.coalesce("next", key).alias("last"), F.when(F.col("next").isNull(), 0.0).otherwise(F.col("dist")).alias("dist"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"))
    state = written(walks.withColumn("there", F.col("hops") == 0), "walk")
    done, open_, n = state.filter("there"), state.filter("not there"), state.count()
    for _ in range(max(n, 2).bit_length() + 2):
        if not open_.head(1):
            return done.drop("there")
        far = state.select("neuron_id", F.col(key).alias("last"), F.col("last").alias("l2"), F.col("dist").alias("d2"), F.col("hops").alias("h2"), F.col("there").alias("t2"))
        joined = open_.join(far, ["neuron_id", "last"], "left")
        moved = written(joined.select("neuron_id", key, F.coalesce("l2", "last").alias("last"), (F.col("dist") + F.coalesce("d2", F.lit(0.0))).alias("dist"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), F.coalesce("t2", F.lit(True)).alias("there")), "walk")
        done, open_ = done.unionByName(moved.filter("there")), moved.filter("not there")
        state = done.unionByName(open_)
    raise ValueError("the links run in a circle")


def narrow(vertices: DataFrame, *columns: str | Column) -> DataFrame:
    """neuron_id, point_no, parent and the columns of vertices as a table."""
    return written(vertices.select(*KEY, "parent", *columns), "vertices")


def placed(vertices: DataFrame) -> DataFrame:
    """neuron_id, point_no, parent, x, y, z of vertices as a table."""
    return narrow(vertices, *(F.col(c).cast("double").alias(c) for c in "xyz"))


def to_root(vertices: DataFrame) -> DataFrame:
    """neuron_id, point_no, root, dist (along the tree) and depth of each vertex."""
    small, large = apart(placed(vertices))
    near = without_circles(facts(small, "walks", "neuron_id, point_no, root, dist double, depth long, circle boolean"), "walks")
    return near if large is None else near.unionByName(to_root_by_joins(large))


def to_root_by_joins(vertices: DataFrame) -> DataFrame:
    """to_root() of trees of any size."""
    linked = vertices.join(edges(vertices).select(*KEY, "length"), KEY, "left")
    links = linked.select("neuron_id", F.col("point_no").alias("node"), F.when(F.col("length").isNotNull(), F.col("parent")).alias("next"), F.col("length").alias("dist"))
    return jump(links).select("neuron_id", F.col("node").alias("point_no"), F.col("last").alias("root"), "dist", F.col("hops").alias("depth"))


def sums_from_root(vertices: DataFrame) -> DataFrame:
    """neuron_id, point_no, dist: the lengths from the root to each vertex, added one after another in that order.

    to_root() adds them in another order, which differs in the last bits. Here each vertex hands its way on to the child with
    the largest subtree, so trees fall into runs, and from a root to any vertex there are at most log2(n) + 1 of them, whatever the
    tree's shape: a round adds along all runs that begin beside those known.
    """
    from .ordering import depth_first

    walked = depth_first(vertices).select(*KEY, "parent", "pre", "size", "depth")
    kept = walked.filter("parent is not null").groupBy("neuron_id", "parent").agg(F.max(F.struct("size", (-F.col("point_no")).alias("minus"))).alias("m")).select("neuron_id", (-F.col("m.minus")).alias("point_no"), F.lit(True).alias("goes_on"))
    marked = walked.join(edges(vertices).select(*KEY, "length"), KEY, "left").join(kept, KEY, "left")
    links = written(marked.select("neuron_id", F.col("point_no").alias("node"), F.when(F.col("goes_on"), F.col("parent")).alias("next"), F.lit(0.0).alias("dist"), "parent", "length", "depth"), "run-links")
    runs = jump(links.select("neuron_id", "node", "next", "dist")).select("neuron_id", "node", F.col("last").alias("run"))
    waiting = written(links.join(runs, ["neuron_id", "node"]).select("neuron_id", F.col("node").alias("point_no"), "run", "parent", "length", "depth"), "runs")
    order = W.partitionBy("neuron_id", "run").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = waiting.filter("parent is null").select("neuron_id", "run", F.lit(0.0).alias("from"))
    done = None
    while True:
        ready = waiting.join(starts, ["neuron_id", "run"])
        step = F.when(F.col("point_no") == F.col("run"), F.col("from") + F.coalesce("length", F.lit(0.0))).otherwise(F.col("length"))
        found = written(ready.withColumn("step", step).select(*KEY, F.sum("step").over(order).alias("dist")), "sums")
        if not found.head(1):
            return done
        done = found if done is None else done.unionByName(found)
        begun = waiting.filter("point_no = run and parent is not null").select("neuron_id", "run", F.col("parent").alias("point_no"))
        starts = written(begun.join(found, KEY).join(starts.select("neuron_id", F.col("run")), ["neuron_id", "run"], "left_anti").select("neuron_id", "run", F.col("dist").alias("from")), "run-starts")


def subtree_max(vertices: DataFrame, value: Column) -> DataFrame:
    """neuron_id, point_no, best: the largest value in each vertex's subtree; value may be a struct."""
    small, large = apart(narrow(vertices, value.alias("best")))
    near = written(facts(small, "largest", "neuron_id, point_no, best"), "largest")
    return near if large is None else near.unionByName(subtree_max_by_joins(large))


def subtree_max_by_joins(vertices: DataFrame) -> DataFrame:
    """subtree_max() of trees of any size that have their values in the column best."""
    state = written(vertices.select(*KEY, F.when(F.col("parent") != -1, F.col("parent")).alias("up"), "best"), "upward")
    while True:
        sent = state.filter("up is not null").groupBy("neuron_id", F.col("up").alias("point_no")).agg(F.max("best").alias("sent"))
        beyond = state.select("neuron_id", F.col("point_no").alias("up"), F.col("up").alias("up2"))
        joined = state.join(sent, KEY, "left").join(beyond, ["neuron_id", "up"], "left")
        state = written(joined.select(*KEY, F.col("up2").alias("up"), F.when(F.col("sent") > F.col("best"), F.col("sent")).otherwise(F.coalesce("best", "sent")).alias("best")), "upward")
        if not state.filter("up is not null").head(1):
            return state.select(*KEY, "best")


def segments(vertices: DataFrame) -> DataFrame:
    """A row for each edge's child: neuron_id, point_no, parent, length, tail.

    A segment is an unbranched run between vertices that are roots, ends or branches; it is named by the
    vertex at its far end, tail. Its head is the parent of its first edge.
    """
    return runs_of(vertices, "length").drop("head")


def runs_of(vertices: DataFrame, *columns: str) -> DataFrame:
    """neuron_id, point_no, parent, tail, head of each edge's child, and of length, dist, depth, start (dist of the head), x, y, z, px, py, pz those that are named."""
    small, large = apart(placed(vertices))
    kinds = {"length": " double", "dist": " double", "depth": " long", "start": " double"} | {f"p{c}": " double" for c in "xyz"}
    walks = "walks " * any(c in ("dist", "depth", "start") for c in columns)
    wanted = ", ".join(["neuron_id", "point_no", "parent", "tail", "head", *(c + kinds.get(c, "") for c in columns), "edge boolean", "circle boolean"])
    near = without_circles(facts(small, f"{walks}segments", wanted), "runs").filter("edge").drop("edge")
    if large is None:
        return near
    runs = segments_by_joins(large)
    heads = segment_graph(large, runs).select("neuron_id", "tail", "head")
    far = runs.join(heads, ["neuron_id", "tail"]).join(edges(large).select(*KEY, *(f"{p}{c}" for p in ("", "p") for c in "xyz")), KEY)
    if walks:
        walked = to_root_by_joins(large).select(*KEY, "dist", "depth")
        far = far.join(walked, KEY).join(walked.select("neuron_id", F.col("point_no").alias("head"), F.col("dist").alias("start")), ["neuron_id", "head"])
    return near.unionByName(far.select(*near.columns))


def segments_by_joins(vertices: DataFrame) -> DataFrame:
    """segments() of trees of any size."""
    known = nodes(vertices)
    keyed = known.filter("parent <> -1").select(*KEY, "parent", "degree")
    inner = keyed.select("neuron_id", F.col("parent").alias("node"), F.col("point_no").alias("child"))
    links = known.select("neuron_id", F.col("point_no").alias("node"), "degree", "parent").join(inner, ["neuron_id", "node"], "left")
    through = F.when((F.col("degree") == 2) & (F.col("parent") != -1), F.col("child"))
    walked = jump(links.select("neuron_id", "node", through.alias("next"), F.lit(0.0).alias("dist")).groupBy("neuron_id", "node").agg(F.max("next").alias("next"), F.max("dist").alias("dist")))
    tails = walked.select("neuron_id", F.col("node").alias("point_no"), F.col("last").alias("tail"))
    return edges(vertices).select(*KEY, "parent", "length").join(tails, KEY)


def segment_graph(vertices: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """neuron_id, head, tail, n_points, length of each segment; runs is segments(vertices), if it is known already."""
    if runs is None:
        runs = runs_of(vertices, "length")
        return runs.groupBy("neuron_id", "tail").agg(F.max("head").alias("head"), (F.count(F.lit(1)) + 1).alias("n_points"), F.sum("length").alias("length"))
    inner = runs.select("neuron_id", F.col("point_no").alias("parent"), F.col("tail").alias("above"))
    first = runs.join(inner, ["neuron_id", "parent"], "left")
    head = F.max(F.when(F.col("above").isNull() | (F.col("above") != F.col("tail")), F.col("parent")))
    return first.groupBy("neuron_id", "tail").agg(head.alias("head"), (F.count(F.lit(1)) + 1).alias("n_points"), F.sum("length").alias("length"))


def order_of(n: Column, low: Column, top: Column, n_top: Column, classical: bool) -> Column:
    """Order of a branch with n children whose orders have this least and largest value, n_top times; of an end (n = 0) it is 1."""
    rises = (n_top > 1) if classical else ((low == top) & (n > 1))
    return F.when(n == 0, 1).otherwise(top + rises.cast("int"))


def branch_orders(graph: DataFrame, classical: bool = False) -> DataFrame:
    """neuron_id, node, strahler of the ends and branches of a segment graph (neuron_id, head, tail), by tree contraction.

    A node is known once all its children are (rake). A node that waits for one child only is a function of that child's
    order, a list of its values for all orders that are possible; lists of neighbours are composed, so what a node looks at
    gets twice as far away each round (compress). Rounds follow the logarithm of the number of nodes, whatever the tree's shape.
    """
    tails = graph.select("neuron_id", F.col("tail").alias("node"), F.col("head").alias("up"))
    roots = graph.select("neuron_id", F.col("head").alias("node")).distinct().join(tails, ["neuron_id", "node"], "left_anti").withColumn("up", F.lit(None).cast("long"))
    nothing = {"known": F.lit(None).cast("int"), "ptr": F.lit(None).cast("long"), "way": F.lit(None).cast("array<int>")}
    state = written(tails.unionByName(roots).withColumns(nothing), "orders")
    most = max(2, state.count()).bit_length() + 1
    values = F.array(*(F.lit(k) for k in range(1, most + 1)))
    while state.filter("known is null").head(1):
        by = state.filter("up is not null").groupBy("neuron_id", F.col("up").alias("node"), F.col("known").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("some"))
        there = F.col("value").isNotNull()
        seen = by.groupBy("neuron_id", "node").agg(
            F.sum("n").alias("n"), F.min("value").alias("low"), F.max(F.when(there, F.struct("value", "n"))).alias("top"), F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("wait"), F.min(F.when(there, None).otherwise(F.col("some"))).alias("child")
        )
        met = state.join(seen, ["neuron_id", "node"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "wait": F.coalesce("wait", F.lit(0))})
        top, n_top = F.coalesce("top.value", F.lit(0)), F.coalesce("top.n", F.lit(0))

        def with_one(x: Column) -> Column:
            """The order if the one child that isn't known has order x."""
            low_, top_ = F.least(F.coalesce("low", x), x), F.greatest(top, x)  # noqa: B023
            return F.least(order_of(F.col("n"), low_, top_, F.when(x > top, 1).when(x == top, n_top + 1).otherwise(n_top), classical), F.lit(most)).cast("int")  # noqa: B023

        new = F.col("known").isNull() & F.col("ptr").isNull() & (F.col("wait") == 1)
        stepped = met.withColumns({"known": F.coalesce("known", F.when(F.col("wait") == 0, order_of(F.col("n"), F.col("low"), top, n_top, classical)).cast("int")), "ptr": F.when(new, F.col("child")).otherwise(F.col("ptr")), "way": F.when(new, F.transform(values, with_one)).otherwise(F.col("way"))})
        raked = written(stepped.select("neuron_id", "node", "up", "known", "ptr", "way"), "orders")
        open_ = F.col("known").isNull() & F.col("ptr").isNotNull()
        ahead = raked.select("neuron_id", F.col("node").alias("ptr"), F.col("known").alias("k2"), F.col("ptr").alias("p2"), F.col("way").alias("w2"))
        looked = raked.filter(open_).join(ahead, ["neuron_id", "ptr"], "left")
        further = F.col("k2").isNull() & F.col("p2").isNotNull()
        moved = looked.select(
            "neuron_id", "node", "up", F.when(F.col("k2").isNotNull(), F.element_at("way", F.col("k2"))).alias("known"), F.when(further, F.col("p2")).otherwise(F.col("ptr")).alias("ptr"), F.when(further, F.transform("w2", lambda y: F.element_at("way", y))).otherwise(F.col("way")).alias("way")
        )
        after = written(moved.unionByName(raked.filter(~open_)), "orders")
        remove(raked)
        remove(state)
        state = after
    return state.select("neuron_id", "node", F.col("known").cast("long").alias("strahler"))


def strahler(vertices: DataFrame, classical: bool = False) -> DataFrame:
    """neuron_id, point_no, strahler of each vertex.

    From the ends up: where all children of a branch have one order the next order begins, else the
    largest goes on; classical asks for two largest children only. Inner points of a segment have the
    smaller order of its two ends.
    """
    small, large = apart(narrow(vertices, *(F.col(c) for c in "xyz")))
    near = without_circles(facts(small.select(*KEY, "parent"), "orders", "neuron_id, point_no, strahler long, circle boolean", classical), "strahler")
    return near if large is None else near.unionByName(strahler_by_joins(large, classical))


def strahler_by_joins(vertices: DataFrame, classical: bool = False) -> DataFrame:
    """strahler() of trees of any size."""
    runs = written(segments_by_joins(vertices).select(*KEY, "parent", "length", "tail"), "segments")
    graph = written(segment_graph(vertices, runs).select("neuron_id", "head", "tail"), "segment-graph")
    order = branch_orders(graph, classical)
    tails = order.select("neuron_id", F.col("node").alias("tail"), F.col("strahler").alias("t"))
    heads = graph.join(order.select("neuron_id", F.col("node").alias("head"), F.col("strahler").alias("h")), ["neuron_id", "head"]).select("neuron_id", "tail", "h")
    inside = runs.join(tails, ["neuron_id", "tail"]).join(heads, ["neuron_id", "tail"]).select(*KEY, F.when(F.col("point_no") == F.col("tail"), F.col("t")).otherwise(F.least("t", "h")).alias("inner"))
    roots = order.select("neuron_id", F.col("node").alias("point_no"), "strahler")
    return vertices.select(*KEY).join(inside, KEY, "left").join(roots, KEY, "left").select(*KEY, F.coalesce("inner", "strahler", F.lit(1)).cast("long").alias("strahler"))
