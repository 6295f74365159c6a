"""Named collections: a table of vertices and a table of metadata, both keyed by neuron_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "neuron_id"


def subset(vertices: DataFrame, metadata: DataFrame, where: Column) -> DataFrame:
    """Vertices of the members whose metadata meet a predicate; null counts as false."""
    return vertices.join(metadata.filter(where).select(ID), ID, "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, then the members of b whose name a doesn't have."""
    return a.unionByName(b.join(a.select(ID).distinct(), ID, "left_anti"), allowMissingColumns=True)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(ID).distinct(), ID, "left_semi")


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(ID).distinct(), ID, "left_anti")


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metadata of both, columns united; a name that both have is an error."""
    both = a.unionByName(b, allowMissingColumns=True)
    twice = both.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1)
    if twice:
        raise ValueError(f"both collections have a member {twice[0][ID]!r}")
    return both


def apply(vertices: DataFrame, value: Column, failed: Column, omit: bool | None) -> DataFrame:
    """neuron_id, value, error of an aggregate over each member.

    failed says which members can't be computed: omit None raises at the first, True drops them, False
    keeps them with an error.
    """
    out = vertices.groupBy(ID).agg(value.alias("value"), failed.alias("failed"))
    if omit is None:
        return out.select(ID, F.when(F.col("failed"), F.raise_error(F.concat(F.lit("failed: "), F.col(ID).cast("string"))).cast("double")).otherwise(F.col("value")).alias("value"))
    if omit:
        return out.filter(~F.col("failed")).select(ID, "value")
    return out.select(ID, F.when(~F.col("failed"), F.col("value")).alias("value"), F.when(F.col("failed"), "failed").alias("error"))


def digest(vertices: DataFrame, fields: list[str]) -> DataFrame:
    """neuron_id, digest: SHA-256 of the members' rows in order of point_no, fields formatted to four places.

    Rows are hashed alone first, so what is gathered for a member is a list of short hashes.
    """
    line = F.sha2(F.concat_ws(",", F.col("point_no").cast("string"), *(F.format_string("%.4f", F.col(f)) for f in fields)), 256)
    return vertices.groupBy(ID).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point_no", line.alias("h")))), lambda r: r["h"]), ""), 256).alias("digest"))


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Members of new whose digest old doesn't have: what an incremental load reads again."""
    return new.join(old.select(ID, "digest"), [ID, "digest"], "left_anti")


def find(vertices: DataFrame, inside: Column, threshold: int = 0) -> DataFrame:
    """neuron_id, n of the members with more than threshold vertices in a region."""
    return vertices.groupBy(ID).agg(F.count_if(inside).alias("n")).filter(F.col("n") > threshold)


def assign(vertices: DataFrame, members: DataFrame) -> DataFrame:
    """The collection with members set: those of a name it has are replaced, the others are added."""
    return setdiff(vertices, members).unionByName(members, allowMissingColumns=True)


def assign_field(metadata: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """Metadata with a field set where values (neuron_id, value) has one; elsewhere it stays, or is null if it is new."""
    old = F.col(field) if field in metadata.columns else F.lit(None)
    return metadata.join(values.select(ID, F.col("value").alias("_set"), F.lit(True).alias("_there")), ID, "left").withColumn(field, F.when(F.col("_there"), F.col("_set")).otherwise(old)).drop("_set", "_there")


def subset_by(vertices: DataFrame, test: Column, invert: bool = False) -> DataFrame:
    """The members for which an aggregate over their own vertices holds; null counts as false."""
    held = vertices.groupBy(ID).agg(F.coalesce(test, F.lit(False)).alias("held"))
    return vertices.join(held.filter(~F.col("held") if invert else F.col("held")).select(ID), ID, "left_semi")


def apply_pairs(a: DataFrame, b: DataFrame, value_a: Column, value_b: Column, join) -> DataFrame:
    """neuron_id, value: join(value_a, value_b) of the aggregates of members that both collections have."""
    sides = [v.groupBy(ID).agg(c.alias(n)) for v, c, n in ((a, value_a, "va"), (b, value_b, "vb"))]
    return sides[0].join(sides[1], ID).select(ID, join(F.col("va"), F.col("vb")).alias("value"))


def unused_levels(metadata: DataFrame, levels: DataFrame, field: str) -> DataFrame:
    """levels (value) without those that no member has."""
    return levels.join(metadata.select(F.col(field).alias("value")).distinct(), "value", "left_semi")


def differing(a: DataFrame, b: DataFrame, fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """neuron_id of the members that aren't equal: other points or parents, or a field whose mean relative difference exceeds a tolerance."""
    named = b.select(ID, "point_no", F.col("parent").alias("parent_b"), *(F.col(f).alias(f"{f}_b") for f in fields))
    both = a.select(ID, "point_no", "parent", *fields).join(named, [ID, "point_no"], "full")
    gap = [F.sum(F.abs(F.col(f) - F.col(f"{f}_b"))) > tolerance * F.greatest(F.sum(F.abs(F.col(f))), F.lit(tolerance)) for f in fields]
    off = F.count_if(~F.col("parent").eqNullSafe(F.col("parent_b"))) > 0
    for g in gap:
        off = off | F.coalesce(g, F.lit(False))
    return both.groupBy(ID).agg(off.alias("off")).filter("off").select(ID)
