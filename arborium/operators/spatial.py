"""Joins by distance in space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ranking import numbered
from ..scratch import written


def celled(points: DataFrame, size: float, around: bool) -> DataFrame:
    """points with their grid cell, or once for each of the 27 cells around them."""
    at = {f"c{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"}
    if not around:
        return points.withColumns(at)
    near = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip((i, j, k), "ijk", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    spread = points.withColumn("near", F.explode(near))
    return spread.withColumns({n: v + F.col(f"near.{d}") for (n, v), d in zip(at.items(), "ijk", strict=True)}).drop("near")


def grid_join(a: DataFrame, b: DataFrame, reach: float, box: bool = False) -> DataFrame:
    """Pairs of rows of a and b whose points (x, y, z) lie within reach, with the squared distance d2.

    Equi-join on grid cells as wide as reach, b being spread to the 27 cells around each point; with box the
    test is on each axis. Column names of a and b must differ but for x, y, z, which are dropped.
    """
    left = celled(a, reach, False).withColumnsRenamed({c: f"{c}_a" for c in "xyz"})
    right = celled(b, reach, True).withColumnsRenamed({c: f"{c}_b" for c in "xyz"})
    gaps = [F.col(f"{c}_a") - F.col(f"{c}_b") for c in "xyz"]
    d2 = sum(g * g for g in gaps)
    joined = left.join(right, ["cx", "cy", "cz"]).withColumn("d2", d2)
    close = (F.abs(gaps[0]) <= reach) & (F.abs(gaps[1]) <= reach) & (F.abs(gaps[2]) <= reach) if box else F.col("d2") <= reach * reach
    return joined.filter(close).drop("cx", "cy", "cz", *(f"{c}_{s}" for c in "xyz" for s in "ab"))


#: For each neighbour that is asked for: rows of a location beyond which it gives that many candidates only, and candidates of a cell beyond which it is cut.
CROWDED, FULL = 16, 32
#: Cells aren't cut below this part of the coordinates.
FINEST = 1e-12
#: Steps of cutting and of widening that doubles allow.
MOST_STEPS = 80


def with_cells(points: DataFrame) -> DataFrame:
    """points with cells cx, cy, cz of column size."""
    return points.withColumns({f"c{c}": F.floor(F.col(c) / F.col("size")).cast("long") for c in "xyz"})


def spread_cells(cells: DataFrame) -> DataFrame:
    """cells (cx, cy, cz and other columns) once for each of the 27 cells nx, ny, nz around them."""
    near = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip((i, j, k), "ijk", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    others = [c for c in cells.columns if c not in ("cx", "cy", "cz")]
    return cells.withColumn("near", F.explode(near)).select(*others, *((F.col(f"c{c}") + F.col(f"near.{d}")).alias(f"n{c}") for c, d in zip("xyz", "ijk", strict=True)))


def thinned(candidates: DataFrame, by: str, k: int) -> DataFrame:
    """candidates (by, neighbour, x, y, z) with at most k, those of the smallest neighbours, at a location that many share."""
    place = [by, "x", "y", "z"]
    crowd = written(candidates.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED * k).drop("n"), "crowded")
    if not crowd.head(1):
        return candidates
    many = numbered(candidates.join(crowd, place, "left_semi"), [*place, "neighbour"], "place_no")
    many = written(many, "crowds")
    first = many.groupBy(*place).agg(F.min("place_no").alias("first"))
    few = many.join(first, place).filter(F.col("place_no") - F.col("first") < k).select(*candidates.columns)
    return candidates.join(crowd, place, "left_anti").unionByName(few)


def cell_sizes(candidates: DataFrame, by: str, k: int) -> DataFrame:
    """by, size, and the box of each group's candidates: cells that hold about k on average, and none of them many times more."""
    box = candidates.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m}_{c}") for c in "xyz" for m, f in (("lo", F.min), ("hi", F.max))))
    wide = [F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]
    dims = sum(F.when(w > 0, 1).otherwise(0) for w in wide)
    volume = F.pow(F.lit(1.0), 1.0)
    for w in wide:
        volume = volume * F.when(w > 0, w).otherwise(1.0)
    size = F.when(dims == 0, 1.0).otherwise(F.pow(volume * k / F.col("n"), 1.0 / F.greatest(dims, F.lit(1))))
    sized = written(box.withColumn("size", F.when(size > 0, size).otherwise(F.lit(1.0))).drop("n"), "cell-sizes")
    for _ in range(MOST_STEPS):
        held = with_cells(candidates.join(sized.select(by, "size"), by)).groupBy(by, "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))
        far = F.greatest(*(F.abs(f"{m}_{c}") for c in "xyz" for m in ("lo", "hi")))
        able = sized.filter(F.col("size") > 4 * FINEST * far).select(by)
        full = written(held.filter(F.col("n") > FULL * k).select(by).distinct().join(able, by).withColumn("cut", F.lit(True)), "full-cells")
        if not full.head(1):
            break
        sized = written(sized.join(full, by, "left").withColumn("size", F.when(F.col("cut"), F.col("size") / 4).otherwise(F.col("size"))).drop("cut"), "cell-sizes")
    return sized


def k_nearest(queries: DataFrame, candidates: DataFrame, key: str, by: str, k: int) -> DataFrame:
    """by, key, neighbour, rank, d2: of each row of queries (by, key, x, y, z) the k nearest rows of candidates (by, neighbour, x, y, z) in its group.

    Exact, ties by neighbour. A query looks at the 27 cells around it; it is done once its k-th neighbour lies nearer than any
    point beyond these cells can, or they cover the whole group. The others go on with cells twice as wide. Cell
    sizes are a group's own and follow its densest cell, so pairs are made for close points alone. Groups with fewer than
    k candidates give all of them, queries without a candidate nothing. Tables with a row a point are joined by sorting: their files
    are so small that Spark would take them, and even their 27 cells, for tables to broadcast.
    """
    candidates = written(thinned(written(candidates.select(by, "neighbour", "x", "y", "z"), "candidates"), by, k), "candidates")
    sized = cell_sizes(candidates, by, k)
    active = written(queries.select(by, key, "x", "y", "z").join(sized, by), "queries")
    done = None
    for _ in range(MOST_STEPS):
        groups = active.select(by, "size").distinct()
        there = with_cells(candidates.join(groups, by)).select(by, F.col("neighbour"), *(F.col(c).alias(f"{c}_b") for c in "xyz"), *(F.col(f"c{c}").alias(f"n{c}") for c in "xyz"))
        edge = F.least(*(F.least(F.col(c) - (F.col(f"c{c}") - 1) * F.col("size"), (F.col(f"c{c}") + 2) * F.col("size") - F.col(c)) for c in "xyz"))
        whole = None
        for c in "xyz":
            inside = ((F.col(f"c{c}") - 1) * F.col("size") <= F.col(f"lo_{c}")) & ((F.col(f"c{c}") + 2) * F.col("size") > F.col(f"hi_{c}"))
            whole = inside if whole is None else whole & inside
        placed = with_cells(active).select(by, key, "x", "y", "z", "cx", "cy", "cz", (edge * edge).alias("safe"), whole.alias("whole"))
        d2 = sum((F.col(c) - F.col(f"{c}_b")) * (F.col(c) - F.col(f"{c}_b")) for c in "xyz")
        met = spread_cells(placed).hint("merge").join(there.hint("merge"), [by, "nx", "ny", "nz"]).withColumn("d2", d2)
        order = W.partitionBy(by, key).orderBy("d2", "neighbour")
        near = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        near = written(near.select(by, key, "neighbour", F.col("rank").cast("long").alias("rank"), "d2", "safe", "whole"), "near")
        sure = near.groupBy(by, key).agg(((F.count(F.lit(1)) == k) & (F.max("d2") < F.max("safe")) | F.max("whole")).alias("sure")).filter("sure").select(by, key)
        sure = written(sure, "sure")
        found = near.join(sure.hint("merge"), [by, key], "left_semi").select(by, key, "neighbour", "rank", "d2")
        done = found if done is None else done.unionByName(found)
        active = written(active.join(sure.hint("merge"), [by, key], "left_anti").withColumn("size", 2 * F.col("size")), "queries")
        if not active.head(1):
            return done
    raise ValueError("coordinates that aren't finite have no neighbours")


def nearest(a: DataFrame, b: DataFrame, key: str, by: str) -> DataFrame:
    """Least squared distance d2 from each row key of a to the rows of b in the same group by."""
    return k_nearest(a, b.withColumn("neighbour", F.monotonically_increasing_id()), key, by, 1).select(by, key, "d2")


def neighbours(points: DataFrame, key: str, by: str, k: int) -> DataFrame:
    """by, key, neighbour, rank, d2: the k nearest points of the same group, the point itself included."""
    return k_nearest(points, points.withColumn("neighbour", F.col(key)), key, by, k)
