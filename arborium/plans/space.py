"""Queries on distances to meshes and on registrations, registered in the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distances as S
from ..operators import registration as A
from ..operators import topology as T
from . import tables as D
from .catalog import TETRA, WITHIN, on_meshes, query, rounded


def triangle_sql(corner: tuple[int, int, int]) -> str:
    """Squared distance of (x, y, z) from the triangle of a tetrahedron's corners."""
    at = lambda n: tuple(f"{c}{n}" for c in "xyz")
    less = lambda p, q: tuple(f"({u} - {v})" for u, v in zip(p, q, strict=True))
    dot = lambda p, q: "(" + " + ".join(f"{u} * {v}" for u, v in zip(p, q, strict=True)) + ")"
    cross = lambda p, q: tuple(f"({p[i]} * {q[j]} - {p[j]} * {q[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))
    a, b, c = map(at, corner)
    p = ("x", "y", "z")

    def edge(u, v):
        d, w = less(v, u), less(p, u)
        t = f"greatest(0.0, least(1.0, {dot(w, d)} / {dot(d, d)}))"
        return "(" + " + ".join(f"({m} - {t} * {k}) ** 2" for m, k in zip(w, d, strict=True)) + ")"

    n = cross(less(b, a), less(c, a))
    over = " AND ".join(f"{dot(cross(less(v, u), less(p, u)), n)} >= 0" for u, v in ((a, b), (b, c), (c, a)))
    return f"CASE WHEN {over} THEN {dot(less(p, a), n)} ** 2 / {dot(n, n)} ELSE least({edge(a, b)}, {edge(b, c)}, {edge(c, a)}) END"


@on_meshes("mesh_distance", f", {TETRA}, c AS ({D.CLOUD.format(lineitem='lineitem')}), p AS (SELECT image_id % 25 AS mesh_id, image_id * 1000000 + point AS point, x, y, z FROM c) SELECT p.mesh_id, p.point, round(CASE WHEN {WITHIN} THEN 1 ELSE -1 END * sqrt(least({', '.join(triangle_sql(t) for t in ((1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)))})), 4) + 0.0 AS distance FROM p JOIN h ON h.mesh_id = p.mesh_id")
def mesh_distance(faces, vertices, spark, sf_dir):
    points = D.clouds(spark, sf_dir).select((F.col("image_id") % 25).alias("mesh_id"), (F.col("image_id") * 1_000_000 + F.col("point")).alias("point"), "x", "y", "z")
    return rounded(S.distances(points, faces, vertices).select("mesh_id", "point", "distance"), "distance")


#: A registration a supplier: what its parameters are, from its keys.
PARAMETERS = {
    "tx": "CAST(s_suppkey % 100 AS DOUBLE)", "ty": "CAST(s_suppkey % 17 AS DOUBLE)", "tz": "CAST(s_nationkey AS DOUBLE)", "rx": "CAST(s_suppkey % 80 - 40 AS DOUBLE)", "ry": "CAST(s_suppkey % 120 - 60 AS DOUBLE)", "rz": "CAST(s_suppkey % 170 - 85 AS DOUBLE)",
    "sx": "CASE WHEN s_suppkey % 2 = 0 THEN -1.25 ELSE 0.75 END", "sy": "CAST(1 + s_suppkey % 3 AS DOUBLE)", "sz": "CAST(0.5 AS DOUBLE)", "shx": "CAST(s_suppkey % 5 AS DOUBLE) / 10", "shy": "CAST(s_suppkey % 7 AS DOUBLE) / 20", "shz": "CAST(s_nationkey AS DOUBLE) / 50",
    "cx": "CAST(s_nationkey AS DOUBLE)", "cy": "CAST(10 AS DOUBLE)", "cz": "CAST(s_suppkey % 9 AS DOUBLE)",
}


def registrations(spark, sf_dir):
    return D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", *(f"cast({e} as double) as {c}" for c, e in PARAMETERS.items()))


@query("affine_parameters", f"SELECT s_suppkey, {', '.join(f'round({e}::DOUBLE, 4) + 0.0 AS {c}' for c, e in PARAMETERS.items())} FROM supplier")
def affine_parameters(spark, sf_dir):
    made = A.composed(registrations(spark, sf_dir)).select("s_suppkey", "matrix", *A.NAMES[12:])
    return rounded(A.decomposed(made).select("s_suppkey", *A.NAMES), *A.NAMES)


@query("affine_centres", f"SELECT s_suppkey, round(cx + tx, 4) + 0.0 AS x, round(cy + ty, 4) + 0.0 AS y, round(cz + tz, 4) + 0.0 AS z FROM (SELECT s_suppkey, {', '.join(f'{e}::DOUBLE AS {c}' for c, e in PARAMETERS.items())} FROM supplier)")
def affine_centres(spark, sf_dir):
    """A registration takes its centre to the centre plus its shift."""
    held = A.composed(registrations(spark, sf_dir))
    row = lambda r: sum(F.col("matrix")[4 * r + k] * F.col(c) for k, c in enumerate(A.NAMES[12:])) + F.col("matrix")[4 * r + 3]
    return rounded(held.select("s_suppkey", *(row(r).alias(c) for r, c in enumerate("xyz"))), "x", "y", "z")


def landmarks(spark, sf_dir):
    """A landmark a nation, moved by an affine map."""
    return D.table(spark, sf_dir, "nation").selectExpr("cast(4 * n_nationkey as double) as x", "cast(n_nationkey * n_nationkey % 37 as double) as y", "cast(n_nationkey % 11 as double) as z").selectExpr("x", "y", "z", "2 * x + 1 as to_x", "y - x as to_y", "z / 2 as to_z")


@query("spline_of_landmarks", f"WITH v AS ({D.tree_sql('heap')}) SELECT neuron_id, point_no, round(2 * x + 1, 3) + 0.0 AS x, round(y - x, 3) + 0.0 AS y, round(z / 2, 3) + 0.0 AS z FROM v", None)
def spline_of_landmarks(spark, sf_dir):
    """Landmarks that follow an affine map: so does the spline."""
    v = D.trees(spark, sf_dir).select(*T.KEY, "x", "y", "z")
    return rounded(A.spline(v, landmarks(spark, sf_dir)), "x", "y", "z", digits=3)
