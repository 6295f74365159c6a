"""Coordinates: arithmetic, boxes, planes, affine maps, resampling, smoothing, tangents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..skew import dealt
from .topology import KEY, edges, runs_of

AXES = ("x", "y", "z")


def arithmetic(points: DataFrame, op: str, values: Sequence[float]) -> DataFrame:
    """x, y, z (and w with a fourth value) with an operator +, -, *, /, ^ or a comparison and one, three or four values."""
    if len(values) not in (1, 3, 4):
        raise ValueError("one, three or four values are needed")
    by = dict(zip((*AXES, "w"), values if len(values) > 1 else values * 3, strict=False))
    does = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": F.pow, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}[op]
    return points.withColumns({c: does(F.col(c), F.lit(float(v))) for c, v in by.items()})


def replace_xyz(points: DataFrame, values: DataFrame, key: Sequence[str]) -> DataFrame:
    """points with the coordinates that values (key, x, y, z) has for them; a point without new ones is an error."""
    new = values.select(*key, F.struct(*AXES).alias("_new"))
    given = lambda c: F.when(F.col("_new").isNull(), F.raise_error(F.lit("a point has no new coordinates")).cast("double")).otherwise(F.col(f"_new.{c}"))
    return points.join(new, list(key), "left").withColumns({c: given(c) for c in AXES}).select(*points.columns)


def scale(points: DataFrame, by: str) -> DataFrame:
    """Coordinates less their mean, over their sample standard deviation, within each group."""
    group = W.partitionBy(by)
    return points.withColumns({c: (F.col(c) - F.avg(c).over(group)) / F.stddev_samp(c).over(group) for c in AXES})


def bounding_box(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))


def affine(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Coordinates under a 4 x 4 matrix that acts on columns (x, y, z, 1)."""
    m = np.asarray(matrix, float)
    row = lambda r: F.col("x") * float(m[r, 0]) + F.col("y") * float(m[r, 1]) + F.col("z") * float(m[r, 2]) + float(m[r, 3])
    return points.withColumns({c: row(r) for r, c in enumerate(AXES)})


def folded(chain: Sequence[tuple[np.ndarray, bool]]) -> np.ndarray:
    """One matrix for a sequence of (matrix, swapped): later ones act on what earlier ones give; swapped ones are inverted."""
    out = np.eye(4)
    for matrix, swapped in chain:
        out = (np.linalg.inv(matrix) if swapped else np.asarray(matrix, float)) @ out
    return out


def inverted(chain: Sequence[tuple[np.ndarray, bool]]) -> list[tuple[np.ndarray, bool]]:
    return [(m, not s) for m, s in reversed(chain)]


def mirror(points: DataFrame, axis: str, size: float) -> DataFrame:
    """The axis reflected: size less the coordinate; size is the sum of the axis range."""
    return points.withColumn(axis, F.lit(float(size)) - F.col(axis))


def plane_coefficients(point: Sequence[float], normal: Sequence[float]) -> tuple[float, float, float, float]:
    """a, b, c, d of the plane a x + b y + c z + d = 0."""
    return (*map(float, normal), -float(np.dot(normal, point)))


def plane_crossings(vertices: DataFrame, plane: Sequence[float]) -> DataFrame:
    """neuron_id, point_no, x, y, z where the edge from a vertex's parent to it meets a plane."""
    a, b, c, d = map(float, plane)
    e = edges(vertices)
    at = lambda x, y, z: a * F.col(x) + b * F.col(y) + c * F.col(z) + d
    slope = at("x", "y", "z") - at("px", "py", "pz")
    u = -at("px", "py", "pz") / F.when(slope != 0, slope)
    hit = e.withColumn("u", u).filter((F.col("u") >= 0) & (F.col("u") <= 1))
    return hit.select(*KEY, *((F.col(f"p{k}") + F.col("u") * (F.col(k) - F.col(f"p{k}"))).alias(k) for k in AXES))


def nearest_crossing(crossings: DataFrame, to: Sequence[float]) -> DataFrame:
    """Of each tree the crossing nearest to a point."""
    d2 = sum((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(AXES, to, strict=True))
    best = crossings.groupBy("neuron_id").agg(F.min(F.struct(d2.alias("d2"), "point_no", *AXES)).alias("m"))
    return best.select("neuron_id", "m.point_no", "m.x", "m.y", "m.z")


def along_segments(vertices: DataFrame) -> DataFrame:
    """A row for each vertex of each segment, heads included: neuron_id, tail, point_no, at (length from the head), x, y, z."""
    runs = runs_of(vertices, "dist", "start", *AXES, *(f"p{c}" for c in AXES))
    heads = runs.filter(F.col("parent") == F.col("head"))
    rows = runs.select("neuron_id", "tail", "point_no", (F.col("dist") - F.col("start")).alias("at"), *AXES)
    return rows.unionByName(heads.select("neuron_id", "tail", F.col("head").alias("point_no"), (F.col("start") - F.col("start")).alias("at"), *(F.col(f"p{c}").alias(c) for c in AXES)))


def resample(vertices: DataFrame, step: float) -> DataFrame:
    """neuron_id, tail, pos, x, y, z: each segment with points every step of its length, its ends kept.

    A segment no longer than step keeps all its points. pos counts from the head.
    """
    rows = dealt(along_segments(vertices), "neuron_id", "tail")
    run = W.partitionBy("neuron_id", "tail").orderBy("at", "point_no")
    whole = W.partitionBy("neuron_id", "tail")
    marked = rows.withColumns({"length": F.max("at").over(whole), "next": F.struct(F.lead("at").over(run).alias("at"), *(F.lead(c).over(run).alias(c) for c in AXES)), "first": F.row_number().over(run) == 1})
    keep = marked.filter((F.col("length") <= step) | F.col("first") | F.col("next.at").isNull()).select("neuron_id", "tail", "at", *AXES)
    low, high = F.floor(F.col("at") / step) + 1, F.ceil(F.col("next.at") / step) - F.when(F.col("next.at") == F.col("length"), 1).otherwise(0)
    top = F.when(F.col("next.at") == F.col("length"), high).otherwise(F.floor(F.col("next.at") / step))
    inside = marked.filter((F.col("length") > step) & F.col("next.at").isNotNull()).withColumns({"low": low.cast("long"), "top": top.cast("long")}).filter("low <= top")
    made = inside.withColumn("k", F.explode(F.sequence("low", "top")))
    u = (F.col("k") * step - F.col("at")) / (F.col("next.at") - F.col("at"))
    new = made.select("neuron_id", "tail", (F.col("k") * step).alias("at2"), *((F.col(c) + u * (F.col(f"next.{c}") - F.col(c))).alias(c) for c in AXES)).withColumnRenamed("at2", "at")
    return keep.unionByName(new).withColumn("pos", F.row_number().over(W.partitionBy("neuron_id", "tail").orderBy("at"))).select("neuron_id", "tail", F.col("pos").cast("long").alias("pos"), *AXES)


def smooth(vertices: DataFrame, sigma: float) -> DataFrame:
    """neuron_id, tail, point_no, x, y, z: inner points of segments as Gaussian means of their segment by length; ends stay."""
    rows = along_segments(vertices)
    other = rows.select("neuron_id", "tail", F.col("at").alias("at2"), *(F.col(c).alias(f"{c}2") for c in AXES))
    weight = F.exp(-(F.col("at") - F.col("at2")) * (F.col("at") - F.col("at2")) / (2 * sigma * sigma))
    means = rows.join(other, ["neuron_id", "tail"]).withColumn("w", weight).groupBy("neuron_id", "tail", "point_no", "at").agg(*((F.sum(F.col("w") * F.col(f"{c}2")) / F.sum("w")).alias(f"m{c}") for c in AXES))
    whole = W.partitionBy("neuron_id", "tail")
    ends = rows.withColumn("inner", (F.col("at") > 0) & (F.col("at") < F.max("at").over(whole)))
    return ends.join(means.drop("at"), ["neuron_id", "tail", "point_no"]).select("neuron_id", "tail", "point_no", *(F.when(F.col("inner"), F.col(f"m{c}")).otherwise(F.col(c)).alias(c) for c in AXES))


def tangents(points: DataFrame, key: str, by: str, k: int = 20) -> DataFrame:
    """by, key, alpha, vx, vy, vz of each point: main direction of its k nearest points and how clear it is.

    Scatter matrices are sums in Spark; a small vectorised function takes their eigenvectors. A group with
    fewer than k points is an error.
    """
    from .spatial import neighbours

    if points.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k).head(1):
        raise ValueError(f"a group has fewer than {k} points")

    near = neighbours(points, key, by, k).join(points.select(by, F.col(key).alias("neighbour"), *AXES).hint("merge"), [by, "neighbour"])
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = near.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{c}") for c in AXES), *(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs))
    scatter = sums.select(by, key, *((F.col(a + b) - F.col(f"m{a}") * F.col(f"m{b}")).alias(a + b) for a, b in pairs))

    def eigen(frames):
        for f in frames:
            m = np.empty((len(f), 3, 3))
            for i, a in enumerate(AXES):
                for j, b in enumerate(AXES):
                    m[:, i, j] = f[a + b if a + b in f else b + a]
            values, vectors = np.linalg.eigh(m)
            total = values.sum(1)
            alpha = np.where(total > 0, (values[:, 2] - values[:, 1]) / np.where(total > 0, total, 1), 0.0)
            yield f[[by, key]].assign(alpha=alpha, vx=vectors[:, 0, 2], vy=vectors[:, 1, 2], vz=vectors[:, 2, 2])

    kinds = {c: t for c, t in points.dtypes}
    return scatter.mapInPandas(eigen, f"{by} {kinds[by]}, {key} {kinds[key]}, alpha double, vx double, vy double, vz double")


def spline_kernel(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and affine part of the thin-plate spline (3-D, kernel r) that takes source points to target points."""
    n = len(source)
    r = np.linalg.norm(source[:, None] - source[None], axis=2)
    p = np.hstack([np.ones((n, 1)), source])
    system = np.block([[r, p], [p.T, np.zeros((4, 4))]])
    solved = np.linalg.solve(system, np.vstack([target, np.zeros((4, 3))]))
    return solved[:n], solved[n:]


def thin_plate(points: DataFrame, source: np.ndarray, target: np.ndarray) -> DataFrame:
    """Coordinates under a thin-plate spline; landmarks are few, so each is one term of an expression."""
    weights, flat = spline_kernel(np.asarray(source, float), np.asarray(target, float))

    def moved(axis: int) -> Column:
        out = float(flat[0, axis]) + sum(F.col(c) * float(flat[1 + k, axis]) for k, c in enumerate(AXES))
        for s, w in zip(np.asarray(source, float), weights, strict=True):
            out = out + float(w[axis]) * F.sqrt(sum((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(AXES, s, strict=True)))
        return out

    return points.withColumns({c: moved(k) for k, c in enumerate(AXES)})
