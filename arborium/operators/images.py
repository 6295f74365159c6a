"""Voxel grids: tables of (image_id, i, j, k, value), indices from 1, over a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELL = ["i", "j", "k"]


def voxel_size(low: Sequence[float], high: Sequence[float], dims: Sequence[int]) -> list[float]:
    """Box sides over dims - 1 (at least 1): boxes run through voxel centres."""
    return [(h - lo) / max(n - 1, 1) for lo, h, n in zip(low, high, dims, strict=True)]


def histogram(points: DataFrame, by: str, origin: Sequence[float], size: Sequence[float], dims: Sequence[int]) -> DataFrame:
    """by, i, j, k, n of points in cells around voxel centres, closed on the right; points outside are dropped."""
    at = {c: F.ceil((F.col(a) - (float(o) - float(s) / 2)) / float(s)).cast("long") for c, a, o, s in zip(CELL, "xyz", origin, size, strict=True)}
    counted = points.withColumns(at)
    for c, n in zip(CELL, dims, strict=True):
        counted = counted.filter(F.col(c).between(1, n))
    return counted.groupBy(by, *CELL).agg(F.count(F.lit(1)).alias("n"))


def linear_index(dims: Sequence[int]) -> Column:
    """Index from 1, i running fastest."""
    return F.col("i") + (F.col("j") - 1) * dims[0] + (F.col("k") - 1) * dims[0] * dims[1]


def from_linear(index: Column, dims: Sequence[int]) -> dict[str, Column]:
    zero = index - 1
    return {"i": F.pmod(zero, F.lit(dims[0])) + 1, "j": F.pmod(F.floor(zero / dims[0]), F.lit(dims[1])) + 1, "k": F.floor(zero / (dims[0] * dims[1])) + 1}


def to_index(points: DataFrame, origin: Sequence[float], size: Sequence[float], dims: Sequence[int], clamp: bool = False) -> DataFrame:
    """points with i, j, k and index of the nearest voxel, halves to even; outside is an error unless clamped."""
    out = points
    for c, a, o, s, n in zip(CELL, "xyz", origin, size, dims, strict=True):
        at = (F.bround((F.col(a) - float(o)) / float(s)) + 1).cast("long")
        out = out.withColumn(c, F.greatest(F.lit(1), F.least(F.lit(n), at)) if clamp else F.when(at.between(1, n), at).otherwise(F.raise_error(F.lit(f"{a} out of range")).cast("long")))
    return out.withColumn("index", linear_index(dims))


def centres(voxels: DataFrame, origin: Sequence[float], size: Sequence[float]) -> DataFrame:
    """voxels with the coordinates of their centres."""
    return voxels.withColumns({a: float(o) + (F.col(c) - 1) * float(s) for c, a, o, s in zip(CELL, "xyz", origin, size, strict=True)})


def projection(voxels: DataFrame, by: str, axis: str, how: str = "sum", step: float = 1.0) -> DataFrame:
    """One axis collapsed by sum, mean, max or integrate (sum times step)."""
    does = {"sum": F.sum("value"), "mean": F.avg("value"), "max": F.max("value"), "integrate": F.sum("value") * step}[how]
    return voxels.groupBy(by, *(c for c in CELL if c != axis)).agg(does.alias("value"))


def sliced(voxels: DataFrame, axis: str, at: Sequence[int]) -> DataFrame:
    return voxels.filter(F.col(axis).isin(*at))


def flipped(voxels: DataFrame, axis: str, n: int) -> DataFrame:
    return voxels.withColumn(axis, n + 1 - F.col(axis))


def masked(voxels: DataFrame, mask: DataFrame, by: str, levels: Sequence[int] | None = None, invert: bool = False) -> DataFrame:
    """Values where the mask is not zero (or has one of some levels), zero elsewhere; invert turns it round."""
    on = F.col("mask").isin(*levels) if levels else F.col("mask") != 0
    keep = F.coalesce(on, F.lit(False))
    joined = voxels.join(mask.select(by, *CELL, F.col("value").alias("mask")), [by, *CELL], "left")
    return joined.withColumn("value", F.when(~keep if invert else keep, F.col("value")).otherwise(F.lit(0).cast(dict(voxels.dtypes)["value"]))).select(*voxels.columns)


def unmasked(values: DataFrame, mask: DataFrame, by: str, dims: Sequence[int]) -> DataFrame:
    """values (by, pos, value) scattered to the cells where the mask isn't zero, in storage order; null elsewhere."""
    hit = mask.filter("value <> 0").withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy(linear_index(dims))))
    placed = hit.select(by, *CELL, F.col("pos").cast("long").alias("pos")).join(values, [by, "pos"], "left").select(by, *CELL, "value")
    return mask.select(by, *CELL).join(placed, [by, *CELL], "left")


def threshold(voxels: DataFrame, least: float) -> DataFrame:
    return voxels.withColumn("value", (F.col("value") > least).cast("int"))


def clamped_max(value: Column, low: float, high: float) -> Column:
    """Largest value, clamped; null if it is infinite or there is none."""
    top = F.max(value)
    return F.when(F.abs(top) == float("inf"), None).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), top)))


def label_statistics(voxels: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """by, label, n, mean, low, high of the values under each label that isn't zero."""
    joined = voxels.join(labels.select(by, *CELL, F.col("value").alias("label")).filter("label <> 0"), [by, *CELL])
    return joined.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def all_cells(spark, dims: Sequence[int]) -> DataFrame:
    """i, j, k of all voxels of a grid, made in parallel from their indices."""
    index = spark.range(1, dims[0] * dims[1] * dims[2] + 1).withColumnRenamed("id", "index")
    return index.select(*(v.cast("long").alias(c) for c, v in from_linear(F.col("index"), dims).items()))


def empty_cells(voxels: DataFrame, by: str, dims: Sequence[int]) -> DataFrame:
    """by, n: the voxels of each grid that the table has no value for, counted without making them."""
    inside = voxels.filter(F.col("value").isNotNull() & (F.col("i").between(1, dims[0])) & (F.col("j").between(1, dims[1])) & (F.col("k").between(1, dims[2])))
    held = inside.select(by, *CELL).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("held"))
    total = dims[0] * dims[1] * dims[2]
    return voxels.select(by).distinct().join(held, by, "left").select(by, (F.lit(total).cast("long") - F.coalesce("held", F.lit(0))).alias("n"))


def material_table(labels: DataFrame, names: DataFrame) -> DataFrame:
    """id, name, level, n: the materials (id, name, level) of a label grid with their numbers of voxels, 0 for those without."""
    return names.join(labels.groupBy(F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n")), "level", "left").select("id", "name", "level", F.coalesce("n", F.lit(0)).alias("n"))


def masked_by_name(voxels: DataFrame, mask: DataFrame, by: str, names: DataFrame, wanted: Sequence[str], invert: bool = False) -> DataFrame:
    """masked() by the names of materials; a name that isn't there is an error."""
    level = {r["name"]: r["level"] for r in names.filter(F.col("name").isin(*wanted)).collect()}
    if missing := [w for w in wanted if w not in level]:
        raise ValueError(f"no such materials: {missing}")
    return masked(voxels, mask, by, [level[w] for w in wanted], invert)


def differing(a: DataFrame, b: DataFrame, by: str, tolerance: float = 1e-6) -> DataFrame:
    """by of the grids that aren't equal: one has a voxel that the other lacks, or the mean relative difference of values exceeds a tolerance."""
    both = a.select(by, *CELL, F.col("value").cast("double").alias("va")).join(b.select(by, *CELL, F.col("value").cast("double").alias("vb")), [by, *CELL], "full")
    off = (F.count_if(F.col("va").isNull() != F.col("vb").isNull()) > 0) | F.coalesce(F.sum(F.abs(F.col("va") - F.col("vb"))) > tolerance * F.greatest(F.sum(F.abs("va")), F.lit(tolerance)), F.lit(False))
    return both.groupBy(by).agg(off.alias("off")).filter("off").select(by)
