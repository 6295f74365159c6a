"""Signed distances of points to meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .surfaces import AXES, corners, cross, minus, points_inside

#: Triangles that a cell of the grid over a mesh's box holds on average.
A_CELL = 8
#: Cells that one triangle may be put into before the grid is made wider.
MOST_CELLS = 64
#: Triangles in cells that are broadcast; more are joined by sorting.
FEW_CELLS = 100_000
#: Rounds in which cells get twice as wide; then they cover any mesh.
MOST_ROUNDS = 80


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(p, q) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def triangle_distance2(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Squared distance of p from the triangle a b c (structs x, y, z), degenerate ones included: to its plane if p lies over it, else to its nearest edge."""

    def edge(u: Column, v: Column) -> Column:
        d, w = minus(v, u), minus(p, u)
        length = dot(d, d)
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(w, d) / length))).otherwise(0.0)
        return let(t, lambda s: sum((w[k] - s * d[k]) * (w[k] - s * d[k]) for k in range(3)))

    n = cross(minus(b, a), minus(c, a))
    parts = F.struct(*(v.alias(k) for v, k in zip(n, AXES, strict=True)))

    def over(normal: Column) -> Column:
        m = tuple(normal[k] for k in AXES)
        size = dot(m, m)
        side = lambda u, v: dot(cross(minus(v, u), minus(p, u)), m) >= 0
        height = dot(minus(p, a), m)
        flat = F.when((size > 0) & side(a, b) & side(b, c) & side(c, a), height * height / size)
        return F.coalesce(flat, F.least(edge(a, b), edge(b, c), edge(c, a)))

    return let(parts, over)


def grid_sizes(triangles: DataFrame, by: str) -> DataFrame:
    """by, the meshes' boxes and size: cells that hold A_CELL triangles on average, if the box's sides are alike, and none less than a usual triangle."""
    low, high = (lambda c, f: f(*(F.col(k)[c] for k in "abc")) for _ in range(2))
    spans = triangles.select(by, *(low(c, F.least).alias(f"lo_{c}") for c in AXES), *(high(c, F.greatest).alias(f"hi_{c}") for c in AXES))
    wide = F.greatest(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in AXES))
    box = spans.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(wide).alias("usual"), F.max(wide).alias("widest"), *(F.min(f"lo_{c}").alias(f"lo_{c}") for c in AXES), *(F.max(f"hi_{c}").alias(f"hi_{c}") for c in AXES))
    extent = F.greatest(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in AXES))
    # Triangles lie on a surface: n of them fill about n / A_CELL cells of a square grid.
    size = F.greatest(extent / F.sqrt(F.greatest(F.col("n") / A_CELL, F.lit(1.0))), F.col("usual"), F.col("widest") / MOST_CELLS ** (1 / 3))
    return box.withColumn("size", F.when(size > 0, size).otherwise(1.0)).drop("n", "usual", "widest")


def distances(points: DataFrame, faces: DataFrame, vertices: DataFrame, by: str = "mesh_id") -> DataFrame:
    """points (mesh_id, point, x, y, z) with distance: to the nearest triangle of their mesh, positive inside, negative outside.

    Triangles are put into the cells of a grid over their mesh that they reach and the cells beside these; a point looks at its own
    cell, so no point is copied, and is done once its nearest triangle is nearer than any that the cell lacks can be, or the cells
    around it cover the mesh. The others go on with cells twice as wide. A point on the surface has distance 0; points of a mesh without triangles have none.
    """
    triangles = written(corners(faces, vertices).select(by, "face", "a", "b", "c"), "triangles")
    sized = written(grid_sizes(triangles, by), "mesh-grids")
    once = written(points.select(by, "point", *AXES).distinct(), "mesh-points")
    active = once.join(sized, by)
    done = None
    for _ in range(MOST_ROUNDS):
        grids = active.select(by, "size").distinct()
        at = lambda c, f: F.floor(f(*(F.col(k)[c] for k in "abc")) / F.col("size")).cast("long")
        held = triangles.join(grids, by)
        for c in AXES:
            held = held.withColumn(f"c{c}", F.explode(F.sequence(at(c, F.least) - 1, at(c, F.greatest) + 1)))
        held = written(held.select(by, "cx", "cy", "cz", "a", "b", "c"), "triangle-cells")
        held = F.broadcast(held) if held.count() <= FEW_CELLS else held.hint("merge")
        cells = active.withColumns({f"c{c}": F.floor(F.col(c) / F.col("size")).cast("long") for c in AXES})
        edge = F.least(*(F.least(F.col(c) - (F.col(f"c{c}") - 1) * F.col("size"), (F.col(f"c{c}") + 2) * F.col("size") - F.col(c)) for c in AXES))
        whole = None
        for c in AXES:
            inside = ((F.col(f"c{c}") - 1) * F.col("size") <= F.col(f"lo_{c}")) & ((F.col(f"c{c}") + 2) * F.col("size") > F.col(f"hi_{c}"))
            whole = inside if whole is None else whole & inside
        placed = cells.select(by, "point", *AXES, "cx", "cy", "cz", (edge * edge).alias("safe"), whole.alias("whole"))
        gap = triangle_distance2(F.struct(*AXES), F.col("a"), F.col("b"), F.col("c"))
        best = placed.join(held, [by, "cx", "cy", "cz"]).withColumn("d2", gap).groupBy(by, "point").agg(F.min("d2").alias("d2"), F.max("safe").alias("safe"), F.max("whole").alias("whole"))
        found = written(best.filter((F.col("d2") <= F.col("safe")) | F.col("whole")).select(by, "point", "d2"), "mesh-near")
        done = found if done is None else done.unionByName(found)
        active = written(active.join(found.select(by, "point").hint("merge"), [by, "point"], "left_anti").withColumn("size", 2 * F.col("size")), "mesh-far")
        if not active.head(1):
            break
    else:
        raise ValueError("coordinates that aren't finite have no distance")
    length = F.sqrt("d2")
    signed = points_inside(once, faces, vertices, by).select(by, "point", "inside").join(done.hint("merge"), [by, "point"]).select(by, "point", F.when(F.col("inside"), length).otherwise(-length).alias("distance"))
    return points.join(signed.hint("merge"), [by, "point"], "left")
