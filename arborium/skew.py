"""Joins of many rows with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond so many rows, or beyond the MOST_HOT-th part of all rows if that is more.
HOT_ROWS, MOST_HOT = 256, 50_000
#: Rows of a task that sorts groups of rows.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in parts by keys, as many as rows ask for: a part's rows, and the memory that sorts it, don't grow with the table. rows is read twice."""
    return rows.repartition(max(-(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def hot_of(counted: DataFrame, total: int) -> list[tuple]:
    """Of keys with their row counts (key, n), the hot ones and into how many parts each is split.

    They are fewer than MOST_HOT, since each has more than the MOST_HOT-th part of total, so the driver can hold them.
    """
    if total <= HOT_ROWS:
        return []
    most = max(HOT_ROWS, -(-total // MOST_HOT))
    key = next(c for c in counted.columns if c != "n")
    return [tuple(r) for r in counted.filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int")).collect()]


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> list[tuple]:
    """The hot keys of a table of total rows, counted in the tasks before any shuffle."""
    return hot_of(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), rows.count() if total is None else total)


def join_spread(rows: DataFrame, single: DataFrame, key: str, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """rows joined with single, which has one row a key; a hot key's rows are dealt to parts, and its row goes to each.

    hot is what hot_keys() gives for rows, if it is known already. Column names besides the key differ.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(single, key, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} {dict(rows.dtypes)[key]}, _parts int"))
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"))
    dealt = rows.join(few, key, "left").withColumn("_part", part).drop("_parts")
    copies = single.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")
