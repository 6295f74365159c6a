"""Vector clouds (neuron_id, point_no, x, y, z, alpha, vx, vy, vz), and features of trees for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .geometry import AXES, scale, tangents
from .topology import KEY, narrow, strahler, to_root

VECTOR = ("vx", "vy", "vz")
FIELDS = (*AXES, "alpha", *VECTOR)


def cloud(points: DataFrame, k: int = 20) -> DataFrame:
    """The cloud of points (neuron_id, point_no, x, y, z): main direction of the k nearest, the point included."""
    return points.select(*KEY, *AXES).join(tangents(points, "point_no", "neuron_id", k), KEY)


def checked(table: DataFrame) -> DataFrame:
    """A table as a cloud: its fields as doubles, others after them; a missing field is an error."""
    if missing := [c for c in (*KEY, *FIELDS) if c not in table.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return table.select(*KEY, *(F.col(c).cast("double").alias(c) for c in FIELDS), *(c for c in table.columns if c not in (*KEY, *FIELDS)))


def subset(vectors: DataFrame, where: Column, invert: bool = False) -> DataFrame:
    """The vectors for which a predicate holds; null counts as false. Vectors aren't computed anew."""
    holds = F.coalesce(where, F.lit(False))
    return vectors.filter(~holds if invert else holds)


def scaled(vectors: DataFrame, k: int = 20) -> DataFrame:
    """Points less their mean, over their standard deviation, in each cloud, with vectors computed anew."""
    return cloud(scale(vectors.select(*KEY, *AXES), "neuron_id"), k)


def differing(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """neuron_id of the clouds that aren't equal: other points, or places, alphas or directions that differ by more; a direction has no sign."""
    both = a.select(*KEY, *FIELDS).join(b.select(*KEY, *(F.col(c).alias(f"{c}_b") for c in FIELDS)), KEY, "full")
    far = F.lit(False)
    for c in (*AXES, "alpha"):
        far = far | F.coalesce(F.abs(F.col(c) - F.col(f"{c}_b")) > tolerance * F.greatest(F.abs(c), F.lit(1.0)), F.lit(True))
    along = F.abs(sum(F.col(c) * F.col(f"{c}_b") for c in VECTOR))
    size = F.sqrt(sum(F.col(c) * F.col(c) for c in VECTOR)) * F.sqrt(sum(F.col(f"{c}_b") * F.col(f"{c}_b") for c in VECTOR))
    return both.withColumn("off", far | F.coalesce(along < (1 - tolerance) * size, F.lit(True))).groupBy("neuron_id").agg(F.max("off").alias("off")).filter("off").select("neuron_id")


def topology_features(vertices: DataFrame) -> DataFrame:
    """neuron_id, point_no, distance along the tree to the root, and reversed order: 0 for the neuron's highest Strahler order."""
    vertices = narrow(vertices, *"xyz")
    order = strahler(vertices)
    top = order.groupBy("neuron_id").agg(F.max("strahler").alias("top"))
    ranked = order.join(top, "neuron_id").select(*KEY, (F.col("top") - F.col("strahler")).alias("reversed_order"))
    return to_root(vertices).select(*KEY, F.col("dist").alias("distance")).join(ranked, KEY)
