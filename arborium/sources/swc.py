"""SWC traces: point, label, x, y, z, radius, parent. Tables hold diameters (w), files hold radii."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["point_no", "label", "x", "y", "z", "w", "parent"]
DEFAULTS = {"label": 2, "w": None, "parent": None}


def base_name(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """neuron_id (the file's name without extension) and COLUMNS, from SWC files; lines are split among tasks by Spark."""
    lines = spark.read.text(path).select(base_name(F.input_file_name()).alias("neuron_id"), F.trim("value").alias("line"))
    cells = lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).withColumn("c", F.split("line", r"\s+"))
    at = lambda k, kind: F.col("c")[k].cast(kind)
    return cells.select("neuron_id", at(0, "long").alias("point_no"), at(1, "int").alias("label"), at(2, "double").alias("x"), at(3, "double").alias("y"), at(4, "double").alias("z"), (2 * at(5, "double")).alias("w"), F.greatest(at(6, "long"), F.lit(-1)).alias("parent"))


def normalised(vertices: DataFrame) -> DataFrame:
    """The seven columns first, missing ones with defaults, then further ones."""
    have = set(vertices.columns)
    kinds = {"label": "int", "w": "double", "parent": "long"}
    out = vertices.withColumns({c: F.lit(v).cast(kinds[c]) for c, v in DEFAULTS.items() if c not in have})
    missing = [c for c in COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    first = ["neuron_id", *COLUMNS]
    return out.select(*first, *(c for c in out.columns if c not in first))


def lines(vertices: DataFrame) -> DataFrame:
    """neuron_id, point_no, line of SWC text for each vertex."""
    number = lambda c: F.col(c).cast("string")
    return vertices.select("neuron_id", "point_no", F.concat_ws(" ", F.col("point_no").cast("string"), F.col("label").cast("string"), number("x"), number("y"), number("z"), F.coalesce((F.col("w") / 2).cast("string"), F.lit("NA")), F.col("parent").cast("string")).alias("line"))


def write(vertices: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One folder a tree, named neuron_id=..., with its lines in order of point_no."""
    ordered = lines(normalised(vertices)).repartition("neuron_id").sortWithinPartitions("neuron_id", "point_no")
    ordered.select("neuron_id", F.col("line").alias("value")).write.mode(mode).partitionBy("neuron_id").text(folder)


def from_tangents(cloud: DataFrame, length: float) -> DataFrame:
    """A vector cloud as separate pieces of two points, point -/+ vector * length / 2."""
    side = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    both = cloud.select("*", side)
    n = 2 * (F.col("point_no") - 1) + F.when(F.col("side") < 0, 1).otherwise(2)
    return both.select("neuron_id", n.alias("point_no"), F.lit(2).alias("label"), *((F.col(c) + F.col("side") * F.col(f"v{c}") * length / 2).alias(c) for c in "xyz"), F.lit(None).cast("double").alias("w"), F.when(F.col("side") < 0, -1).otherwise(n - 1).cast("long").alias("parent"))


#: A line of seven numbers, the first two and the last whole ones.
SWC_LINE = r"^\s*[0-9]+\s+-?[0-9]+(\s+(-?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?|NA|NaN|nan)){4}\s+-?[0-9]+\s*$"


def looks_like_swc(spark: SparkSession, path: str, trust_suffix: bool = True) -> DataFrame:
    """path, is_swc of each file: by its name, or by its first line that isn't blank or a comment, after a first sign that is a digit or #. Files without a byte aren't listed."""
    read = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("text"))
    first = F.get(F.filter(F.split("text", "\r?\n"), lambda line: ~F.rlike(line, F.lit(r"^\s*(#.*)?$"))), F.lit(0))
    by_text = F.rlike("text", F.lit(r"^[#0-9]")) & F.coalesce(F.rlike(first, F.lit(SWC_LINE)), F.lit(False))
    named = F.rlike("path", F.lit(r"(?i)\.swc$"))
    return read.select("path", (named | by_text if trust_suffix else by_text).alias("is_swc"))
