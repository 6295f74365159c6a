"""Trees with points at even steps along their segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ranking import running
from ..scratch import written
from .ordering import depth_first, segment_order, tree_starts
from .topology import KEY, sums_from_root

VALUES = ("x", "y", "z", "w")


def resample_tree(vertices: DataFrame, step: float) -> DataFrame:
    """neuron_id, point_no, parent, x, y, z, w, label: each segment with points every step of its length from its head.

    Heads and tails stay, inner points give way to new ones on the lines between them; a new point that would lie on the tail is
    left out. A segment no longer than step keeps all its points. w is interpolated, null if a value of the segment is
    missing; points have the label of their segment's head. Points are numbered from 1 in depth-first order, the largest tree of
    a neuron first, so parents come before their children. Segments, not trees, are what a window spans.
    """
    if not step > 0:
        raise ValueError("the step is a positive length")
    order = written(segment_order(vertices), "segment-order")
    far = written(sums_from_root(vertices), "distances")
    placed = order.join(vertices.select(*KEY, *VALUES, "label"), KEY).join(far, KEY)
    seg = ["neuron_id", "root", "seg_id"]
    run = W.partitionBy(*seg).orderBy("pos")
    whole = W.partitionBy(*seg)
    at = F.col("dist") - F.first("dist").over(run)
    measured = placed.withColumn("at", at)
    finite = F.min((F.coalesce(F.abs("w"), F.lit(float("inf"))) < float("inf")).cast("int")).over(whole) == 1
    ahead = F.struct(F.lead("at").over(run).alias("at"), *(F.lead(c).over(run).alias(c) for c in VALUES))
    marked = written(measured.withColumns({"length": F.max("at").over(whole), "finite": finite, "next": ahead, "named": F.first("label").over(run), "n": F.count(F.lit(1)).over(whole)}), "marked")
    tail = F.col("pos") == F.col("n")
    stay = marked.filter((F.col("pos") > 1) & ((F.col("length") <= step) | tail)).select(*seg, "at", "pos", "point_no", *VALUES, F.col("named").alias("label"))
    low, top = F.floor(F.col("at") / step) + 1, F.floor(F.col("next.at") / step)
    inside = marked.filter((F.col("length") > step) & F.col("next.at").isNotNull()).withColumn("k", F.explode(F.when(low <= top, F.sequence(low.cast("long"), top.cast("long"))).otherwise(F.array().cast("array<long>"))))
    inside = inside.filter(F.col("k") * step < F.col("length"))
    u = (F.col("k") * step - F.col("at")) / (F.col("next.at") - F.col("at"))
    between = lambda c: F.col(c) + u * (F.col(f"next.{c}") - F.col(c))
    made = inside.select(*seg, (F.col("k") * step).alias("new_at"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("point_no"), *(between(c).alias(c) if c != "w" else F.when(F.col("finite"), between(c)).alias(c) for c in VALUES), F.col("named").alias("label")).withColumnRenamed("new_at", "at")
    nth = F.row_number().over(W.partitionBy(*seg).orderBy("at", F.col("pos") == 0, "pos")).cast("long")
    points = written(stay.unionByName(made).withColumn("nth", nth), "resampled")
    # Numbers: trees by size, then segments in order, then places in them.
    sizes = depth_first(vertices).filter("parent is null").select("neuron_id", "root", "size")
    trees = written(tree_starts(sizes), "tree-order")
    one = F.lit(1).cast("long")
    counts = points.groupBy(*seg).agg(F.max("nth").alias("n")).unionByName(trees.select("neuron_id", "root", F.lit(0).cast("long").alias("seg_id"), one.alias("n")))
    summed = written(running(counts.join(trees, ["neuron_id", "root"]), ["neuron_id", "before", "seg_id"], "n", "so_far").select(*seg, "so_far"), "numbers")
    first = summed.groupBy("neuron_id").agg(F.min("so_far").alias("first"))
    bases = written(summed.join(first, "neuron_id").select(*seg, (F.col("so_far") - F.col("first")).alias("base")), "bases")
    new = points.join(bases, seg).withColumn("new", F.col("base") + F.col("nth"))
    tops = bases.filter("seg_id = 0").select("neuron_id", "root", (F.col("base") + 1).alias("new"))
    known = new.filter("point_no is not null").select(*KEY, "new").unionByName(tops.select("neuron_id", F.col("root").alias("point_no"), "new")).withColumnsRenamed({"point_no": "head", "new": "head_new"})
    heads = marked.filter("pos = 1 and n > 1").select(*seg, F.col("point_no").alias("head")).join(known, ["neuron_id", "head"]).select(*seg, "head_new")
    inner = new.join(heads, seg).select("neuron_id", F.col("new").alias("point_no"), F.when(F.col("nth") == 1, F.col("head_new")).otherwise(F.col("new") - 1).alias("parent"), *VALUES, "label")
    roots = tops.join(vertices.select("neuron_id", F.col("point_no").alias("root"), *VALUES, "label"), ["neuron_id", "root"])
    return inner.unionByName(roots.select("neuron_id", F.col("new").alias("point_no"), F.lit(-1).cast("long").alias("parent"), *VALUES, "label"))
