"""Places and running sums in a global order, and ranks in linked lists: no window spans more than a part of a range sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import remove, written

def ordered_parts(df: DataFrame, order: list) -> DataFrame:
    """df, stored in the order, with _at: the part's number above bit 33 and the place in the part below. A range sort reads df twice."""
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")


def with_bases(parts: DataFrame, total: str, name: str) -> DataFrame:
    """parts with name: the sum of total over all earlier parts, from one row a part."""
    part = F.shiftright("_at", 33).cast("int")
    sums = sorted((r[0], r[1] or 0) for r in parts.groupBy(part.alias("p")).agg(F.sum(total)).collect())
    ends = list(accumulate(n for _, n in sums))
    bases = [(p, end - n) for (p, n), end in zip(sums, ends, strict=True)]
    few = F.broadcast(parts.sparkSession.createDataFrame(bases, f"_part int, {name} {dict(parts.selectExpr(f'sum({total}) as s').dtypes)['s']}"))
    return parts.withColumn("_part", part).join(few, "_part")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's place, from 0, in the order; the order must leave no ties."""
    placed = with_bases(ordered_parts(df, order).withColumn("_one", F.lit(1).cast("long")), "_one", "_base")
    return placed.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_one", "_at")


def running(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each in the order; the order must leave no ties."""
    placed = with_bases(ordered_parts(df, order), value, "_base")
    inside = F.sum(value).over(W.partitionBy("_part").orderBy("_at")) - F.col(value)
    return placed.withColumn(name, F.col("_base") + inside).drop("_part", "_base", "_at")


def list_sums(links: DataFrame, arc: str, before: str, carried: str, sums: list[str]) -> DataFrame:
    """Of linked lists (neuron_id, arc, before: the arc before it or null, carried, sums), sums from the list's start up to each arc.

    carried is what the first arc of the list has. An arc is before one other at most, so no key repeats: each round is one
    join of the arcs whose start isn't known yet, and doubles how far they see.
    """
    keep = ["neuron_id", arc, before, carried, *sums]
    state = written(links.select(*keep), "list")
    for _ in range(state.count().bit_length() + 2):
        if not state.filter(F.col(before).isNotNull()).head(1):
            return state.drop(before)
        ahead = state.select("neuron_id", F.col(arc).alias(before), F.col(before).alias("_b"), F.col(carried).alias("_c"), *(F.col(s).alias(f"_{s}") for s in sums))
        far = state.filter(F.col(before).isNotNull()).join(ahead, ["neuron_id", before])
        moved = far.select("neuron_id", arc, F.col("_b").alias(before), F.col("_c").alias(carried), *((F.col(s) + F.col(f"_{s}")).alias(s) for s in sums))
        new = written(moved.unionByName(state.filter(F.col(before).isNull())), "list")
        remove(state)
        state = new
    raise ValueError("a list runs in a circle")
