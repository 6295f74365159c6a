"""Trees of few vertices, many at once, as arrays in a task; larger trees go by joins, and both give the same rows.

Walks by joins send all rows through a shuffle and a table each round. A tree of up to MOST_ROWS rows needs none of that: Spark
deals trees to tasks, and a task doubles walks in arrays of about BATCH_ROWS rows. No tree beyond MOST_ROWS is ever put into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

MOST_ROWS, BATCH_ROWS = 1 << 16, 1 << 17
#: Rows of trees whose ends are compared with each other in one task.
MOST_STITCHED = 1 << 11


def apart(df: DataFrame, most: int | None = None, other: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of neurons that have most rows (MOST_ROWS) at most and none for which other holds, and those of the others, None if there are no others.

    df is read several times.
    """
    hold = F.coalesce(F.bool_or(F.lit(False) if other is None else other), F.lit(False))
    counted = df.groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"), hold.alias("other"))
    large = written(counted.filter((F.col("n") > (most or MOST_ROWS)) | F.col("other")).select("neuron_id"), "large-trees")
    if not large.head(1):
        return df, None
    return df.join(large, "neuron_id", "left_anti"), df.join(large, "neuron_id", "left_semi")


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values have equal numbers from 0, null has -1."""
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def in_arrays(df: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """solve() of tables that hold all rows of their neurons; a table has the rows of many neurons."""
    most = BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(held)
            neuron = codes(table["neuron_id"])
            other = np.flatnonzero(neuron != neuron[-1])
            if len(other):
                yield from solve(table.slice(0, other[-1] + 1).combine_chunks()).to_batches()
                table = table.slice(other[-1] + 1)
            held, rows = table.to_batches(), table.num_rows
        if rows:
            yield from solve(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return df.repartition("neuron_id").sortWithinPartitions("neuron_id").mapInArrow(run, schema)


def ints(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, and where they aren't null."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(), pc.is_valid(column).to_numpy()


def rows_of(neuron: np.ndarray, node: np.ndarray, at: np.ndarray, wanted: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The row in which (neuron, node) is (at, wanted), -1 where there is none."""
    names, number = np.unique(np.concatenate([node, wanted]), return_inverse=True)
    key, ask = neuron * len(names) + number[: len(node)], at * len(names) + number[len(node) :]
    order = np.argsort(key, kind="stable")
    place = np.minimum(np.searchsorted(key[order], ask), max(len(key) - 1, 0))
    return np.where(valid & (at >= 0) & (key[order][place] == ask), order[place], -1) if len(key) else np.full(len(ask), -1)


def climbed(up: np.ndarray, *steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of rows and the rows above them (-1: none) the last one, the number of steps (-1 in a circle) and sums of steps, by doubling."""
    going = up >= 0
    last, hops, sums = np.where(going, up, np.arange(len(up))), going.astype(np.int64), [np.where(going, s, s.dtype.type(0)) for s in steps]
    for _ in range(len(up).bit_length() + 1):
        further = last[last]
        if np.array_equal(further, last):
            break
        hops, sums, last = hops + hops[last], [s + s[last] for s in sums], further
    return last, np.where(going[last], -1, hops), sums


def levels(depth: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of equal depth, the deepest first, without those of depth 0."""
    order = np.argsort(-depth, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[: -1 if len(depth) and depth.min() == 0 else None]


def hung(u: np.ndarray, v: np.ndarray, roots: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n vertices' parent, -1 for roots: the edges of a forest hung from its roots, level by level."""
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    to = b[np.argsort(a, kind="stable")]
    n_near = np.bincount(a, minlength=n)
    start = np.cumsum(n_near) - n_near
    parent, front = np.full(n, -1), roots
    while len(front):
        many = n_near[front]
        came = np.repeat(front, many)
        near = to[np.repeat(start[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        on = near != parent[came]
        parent[near[on]] = came[on]
        front = near[on]
    return parent


class Trees:
    """The trees of a table (neuron_id, point_no, parent, and for lengths x, y, z), one row a vertex."""

    def __init__(self, table: pa.Table):
        self.table, self.n = table, table.num_rows
        self.neuron = codes(table["neuron_id"])
        self.node, _ = ints(table["point_no"])
        parent, there = ints(table["parent"])
        self.has_parent = there & (parent != -1)
        self.up = rows_of(self.neuron, self.node, self.neuron, parent, self.has_parent)
        self.child = np.flatnonzero(self.up >= 0)
        self.n_children = np.bincount(self.up[self.child], minlength=self.n)
        self.degree = self.n_children + self.has_parent
        self.made: dict[str, pa.Array] = {}

    def point(self, rows: np.ndarray) -> pa.Array:
        """The points of rows, null where there is none."""
        return self.table["point_no"].take(pa.array(rows, mask=rows < 0))

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """The length of the edge to the parent, and where it is known."""
        total, known = 0.0, self.up >= 0
        for c in "xyz":
            valid, values = pc.is_valid(self.table[c]).to_numpy(), pc.fill_null(self.table[c], 0.0).to_numpy()
            d, known = values - values[self.up], known & valid & valid[self.up]
            total = total + d * d
        return np.sqrt(total), known

    def walks(self) -> None:
        """root, dist, depth as to_root() has them: an edge of unknown length ends a walk."""
        length, known = self.lengths()
        self.last, self.hops, (self.dist,) = climbed(np.where(known, self.up, -1), length)
        self.made |= {"root": self.point(self.last), "dist": pa.array(self.dist), "depth": pa.array(self.hops), "circle": pa.array(self.hops < 0)}

    def segments(self) -> None:
        """length, tail, head, after walks() also start (dist of the head), and the parent's coordinates of each edge's child; nothing in the other rows."""
        length, known = self.lengths()
        below = np.full(self.n, -1)
        below[self.up[self.child]] = self.child
        tail, hops, _ = climbed(np.where((self.degree == 2) & self.has_parent, below, -1))
        edge = self.up >= 0
        first = edge & ((self.up[self.up] < 0) | (tail[self.up] != tail))
        head = np.full(self.n, -1)
        head[tail[first]] = self.up[first]
        self.tail, self.head = np.where(edge, tail, -1), np.where(edge, head[tail], -1)
        self.made |= {"length": pa.array(length, mask=~known), "tail": self.point(self.tail), "head": self.point(self.head), "edge": pa.array(edge)}
        self.made |= {f"p{c}": self.table[c].take(pa.array(self.up, mask=~edge)) for c in "xyz"}
        if "dist" in self.made:
            self.made["start"] = pa.array(self.dist[self.head], mask=~edge)
        self.made["circle"] = pa.array((hops < 0) | np.asarray(self.made.get("circle", np.zeros(self.n, bool))))

    def order(self) -> None:
        """above (the parent, if it is there), root, pre, size, depth, closed as depth_first() has them."""
        last, depth, _ = climbed(self.up)
        size = np.ones(self.n, np.int64)
        for rows in levels(depth) if (depth >= 0).all() else ():
            np.add.at(size, self.up[rows], size[rows])
        kids = self.child[np.lexsort((self.node[self.child], self.up[self.child]))]
        before = np.cumsum(size[kids]) - size[kids]
        starts = np.flatnonzero(np.diff(self.up[kids], prepend=-1))
        step = np.zeros(self.n, np.int64)
        step[kids] = 1 + before - np.repeat(before[starts], np.diff(np.append(starts, len(kids))))
        _, _, (pre,) = climbed(self.up, step)
        along = np.lexsort((pre, last))
        ends = np.cumsum(((self.n_children != 1) & (self.up >= 0))[along])
        closed = np.empty(self.n, np.int64)
        closed[along] = ends
        closed -= closed[last]
        self.made |= {"above": self.point(self.up), "root": self.point(last), "circle": pa.array(depth < 0)}
        self.made |= {"pre": pa.array(pre), "size": pa.array(size), "depth": pa.array(depth), "closed": pa.array(closed)}

    def orders(self, classical: bool) -> None:
        """strahler of each vertex; a vertex with one child has that child's."""
        _, depth, _ = climbed(self.up)
        low, top, n_top = np.full(self.n, self.n), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        rises = lambda k: n_top[k] > 1 if classical else (low[k] == top[k]) & (self.n_children[k] > 1)
        order_of = lambda k: np.where(self.n_children[k] == 0, 1, top[k] + rises(k))
        for rows in levels(depth) if (depth >= 0).all() else ():
            own, up = order_of(rows), self.up[rows]
            np.minimum.at(low, up, own)
            np.maximum.at(top, up, own)
            np.add.at(n_top, up, own == top[up])
        self.made |= {"strahler": pa.array(order_of(np.arange(self.n)).astype(np.int64)), "circle": pa.array(depth < 0)}

    def largest(self) -> None:
        """best: the largest value in each vertex's subtree; null is less than all else, also inside of a struct."""
        value = self.table["best"].combine_chunks()
        value = value.chunk(0) if isinstance(value, pa.ChunkedArray) else value
        rank = np.zeros(self.n, np.int64)
        for field in value.flatten() if pa.types.is_struct(value.type) else [value]:
            valid = pc.is_valid(field).to_numpy(zero_copy_only=False)
            filled = field.fill_null(False if pa.types.is_boolean(field.type) else 0).to_numpy(zero_copy_only=False)
            names, number = np.unique(filled, return_inverse=True)
            _, rank = np.unique(rank * (len(names) + 1) + np.where(valid, number + 1, 0), return_inverse=True)
        rank = np.where(pc.is_valid(value).to_numpy(zero_copy_only=False), rank + 1, 0)
        _, some, best = np.unique(rank, return_index=True, return_inverse=True)
        up = self.up
        for _ in range(self.n.bit_length() + 1):
            going = up >= 0
            if not going.any():
                break
            np.maximum.at(best, up[going], best[going])
            up = np.where(going, up[up], -1)
        self.made["best"] = value.take(pa.array(some[best]))


class Graphs:
    """Graphs of a table (neuron_id, kind, a, b): vertices a, EDGES from a to b and ORIGINS a, with the results that graphs.py defines."""

    VERTICES, EDGES, ORIGINS = range(3)

    def __init__(self, table: pa.Table):
        neuron, kind, (a, a_there), (b, b_there) = codes(table["neuron_id"]), ints(table["kind"])[0], ints(table["a"]), ints(table["b"])
        given = np.flatnonzero(kind == self.VERTICES)
        by = given[np.lexsort((a[given], neuron[given]))]
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(neuron[by]) != 0) | (np.diff(a[by]) != 0)
        at = by[new]
        self.table, self.at, self.n = table, at, len(at)
        self.neuron, self.node, self.times = neuron[at], a[at], np.diff(np.append(np.flatnonzero(new), len(by)))
        e = np.flatnonzero((kind == self.EDGES) & a_there & b_there & (a != b))
        low, high = np.minimum(a[e], b[e]), np.maximum(a[e], b[e])
        order = np.lexsort((high, low, neuron[e]))
        whose, low, high = neuron[e][order], low[order], high[order]
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(whose) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        self.proper, low, high = whose[once], low[once], high[once]
        every = np.ones(len(low), bool)
        u, v = (rows_of(self.neuron, self.node, self.proper, end, every) for end in (low, high))
        both = (u >= 0) & (v >= 0)
        self.u, self.v = u[both], v[both]
        o = np.flatnonzero((kind == self.ORIGINS) & a_there)
        found = rows_of(self.neuron, self.node, neuron[o], a[o], np.ones(len(o), bool))
        self.origin = np.zeros(self.n, bool)
        self.origin[found[found >= 0]] = True

    def forest(self) -> None:
        """component (its smallest vertex's row) of each vertex, and the rows of u and v that the forest keeps: each component takes its least edge."""
        m, of = len(self.u), np.arange(self.n)
        cu, cv, kept, open_ = self.u.copy(), self.v.copy(), np.zeros(m, bool), np.arange(m)
        while len(open_):
            best = np.full(self.n, m)
            np.minimum.at(best, cu[open_], open_)
            np.minimum.at(best, cv[open_], open_)
            c = np.flatnonzero(best < m)
            e = best[c]
            kept[e] = True
            hook = np.arange(self.n)
            hook[c] = cu[e] + cv[e] - c
            mutual = c[(hook[hook[c]] == c) & (c < hook[c])]
            hook[mutual] = mutual
            while not np.array_equal(further := hook[hook], hook):
                hook = further
            of, cu, cv = hook[of], hook[cu], hook[cv]
            open_ = open_[cu[open_] != cv[open_]]
        first = np.full(self.n, self.n)
        np.minimum.at(first, of, np.arange(self.n))
        self.component, self.kept = first[of], np.flatnonzero(kept)

    def point(self, rows: np.ndarray) -> pa.Array:
        return self.table["a"].take(pa.array(self.at[rows], mask=rows < 0) if self.n else pa.array(rows))

    def name(self) -> pa.Array:
        return self.table["neuron_id"].take(pa.array(self.at))

    def roots(self) -> None:
        """root (a row), size and master of each vertex's component."""
        degree = np.bincount(self.u[self.kept], minlength=self.n) + np.bincount(self.v[self.kept], minlength=self.n)
        rows, of = np.arange(self.n), self.component

        def least(where: np.ndarray) -> np.ndarray:
            found = np.full(self.n, self.n)
            np.minimum.at(found, of[where], rows[where])
            return found

        origin, end, first = least(self.origin), least(degree <= 1), least(np.ones(self.n, bool))
        size = np.bincount(of, minlength=self.n)
        part = np.unique(of)
        best = part[np.lexsort((first[part], -size[part], origin[part] == self.n, self.neuron[part]))]
        top = best[np.diff(self.neuron[best], prepend=-1) != 0]
        master = np.zeros(self.n, bool)
        master[top] = True
        root = np.where(origin < self.n, origin, np.where(end < self.n, end, first))
        self.root, self.size, self.master = root[of], size[of], master[of]


def component_rows(table: pa.Table) -> pa.Table:
    """neuron_id, a, b, component: vertices (with a component) and the forest's edges (with b)."""
    g = Graphs(table)
    g.forest()
    u, v, none = g.u[g.kept], g.v[g.kept], np.full(len(g.kept), -1)
    neuron = table["neuron_id"].take(pa.array(g.at[np.concatenate([np.arange(g.n), u])]))
    return pa.table([neuron, g.point(np.concatenate([np.arange(g.n), u])), g.point(np.concatenate([np.full(g.n, -1), v])), g.point(np.concatenate([g.component, none]))], names=["neuron_id", "a", "b", "component"])


def oriented_rows(table: pa.Table) -> pa.Table:
    """neuron_id, point_no, parent, root, size, master."""
    g = Graphs(table)
    g.forest()
    g.roots()
    parent = pc.fill_null(g.point(hung(g.u[g.kept], g.v[g.kept], np.unique(g.root), g.n)).cast(pa.int64()), -1)
    return pa.table([g.name(), g.point(np.arange(g.n)), parent, g.point(g.root), pa.array(g.size), pa.array(g.master)], names=["neuron_id", "point_no", "parent", "root", "size", "master"])


def problem_rows(table: pa.Table) -> pa.Table:
    """neuron_id, vertices, edges, components, circles, repeated_names, loose_edges."""
    g = Graphs(table)
    g.forest()
    some, first = np.unique(g.neuron, return_index=True)
    count = lambda whose: np.bincount(whose[whose >= 0], minlength=some[-1] + 1 if len(some) else 0)[some]
    vertices, edges, components = count(g.neuron), count(g.neuron[g.u]), count(g.neuron[np.unique(g.component)])
    columns = [vertices, edges, components, edges - vertices + components, count(g.neuron[g.times > 1]), count(g.proper) - edges]
    return pa.table([table["neuron_id"].take(pa.array(g.at[first])), *(pa.array(c) for c in columns)], names=["neuron_id", "vertices", "edges", "components", "circles", "repeated_names", "loose_edges"])


def stitched_rows(table: pa.Table, longest: float | None) -> pa.Table:
    """neuron_id, a, b, gap, parent: fragments joined by their shortest links; vertices a with their parent, and links from a to b with their gap."""
    t = Trees(table)
    t.walks()
    place = [table[c].to_numpy() for c in "xyz"]
    ends = np.flatnonzero((t.degree <= 1) | ~t.has_parent)
    ends = ends[np.lexsort((t.node[ends], t.neuron[ends]))]
    group = np.arange(t.n)
    links: list[tuple[int, int, float]] = []
    for some in np.split(ends, np.flatnonzero(np.diff(t.neuron[ends])) + 1):
        fragments, of = np.unique(t.last[some], return_inverse=True)
        if len(fragments) < 2:
            continue
        low, high = np.triu_indices(len(some), 1)
        apart_ = of[low] != of[high]
        low, high = low[apart_], high[apart_]
        gap = np.sqrt(sum((p[some[low]] - p[some[high]]) * (p[some[low]] - p[some[high]]) for p in place))
        if longest is not None:
            low, high, gap = low[gap <= longest], high[gap <= longest], gap[gap <= longest]
        order = np.lexsort((high, low, gap))
        pair = np.minimum(of[low], of[high]) * len(fragments) + np.maximum(of[low], of[high])
        # Of each two fragments the first link only; then the shortest that join two groups.
        _, first = np.unique(pair[order], return_index=True)
        for k in order[np.sort(first)]:
            g, h = (group[fragments[of[e[k]]]] for e in (low, high))
            if g != h:
                g, h = (g, h) if t.node[g] < t.node[h] else (h, g)
                mine = fragments[group[fragments] == h]
                group[mine] = g
                links.append((some[low[k]], some[high[k]], gap[k]))
    a, b = (np.array([link[k] for link in links], np.int64) for k in (0, 1))
    own = np.flatnonzero(t.up >= 0)
    parent = hung(np.concatenate([own, a]), np.concatenate([t.up[own], b]), np.unique(group[t.last]), t.n)
    parents = np.where(parent < 0, ints(table["parent"])[0], t.node[parent])
    rows, none = np.concatenate([np.arange(t.n), a]), np.zeros(t.n)
    made = np.arange(len(rows)) >= t.n
    columns = [t.point(np.concatenate([np.full(t.n, -1), b])), pa.array(np.concatenate([none, [link[2] for link in links]]), mask=~made), pa.array(np.concatenate([parents, np.zeros(len(a), np.int64)]), mask=made)]
    return pa.table([table["neuron_id"].take(pa.array(rows)), t.point(rows), *columns], names=["neuron_id", "a", "b", "gap", "parent"])


def facts(vertices: DataFrame, of: str, columns: str, *given) -> DataFrame:
    """Rows of vertices (whose trees are small) with columns that Trees finds by the methods named in of, separated by blanks."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = dict(vertices.dtypes)
    kept = [c for c in names if c in types and c != "best"]
    schema = ", ".join(f"{c} {types[c]}" if c in types else c if " " in c else f"{c} {types['point_no']}" for c in columns.split(", "))

    def solve(table: pa.Table) -> pa.Table:
        trees = Trees(table)
        for method in of.split():
            getattr(trees, method)(*given)
        return pa.table([table[c] if c in kept else trees.made[c] for c in names], names=names)

    return in_arrays(vertices, solve, schema)


def without_circles(found: DataFrame, name: str, what: str = "the links run in a circle") -> DataFrame:
    """found as a table, without its column circle, which is nowhere true."""
    done = written(found, name)
    if done.filter("circle").head(1):
        raise ValueError(what)
    return done.drop("circle")
