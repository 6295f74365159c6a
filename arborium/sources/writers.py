"""Line sets, skeletons and landmarks as text, written by Spark: one file a tree or set, lines in order.

A file is a sequence of lines with a key (section, place): sections of many lines are rows of their own, so no file is held
in memory; a sort inside each file's task puts them in order. A file is one task's work, since its format is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import renumbered, segment_order
from ..scratch import written
from .registry import FORMATS, Format

KEY = ["neuron_id", "section", "place", "line"]


def text(value: str) -> Column:
    return F.regexp_replace(F.col(value).cast("string"), r"\.0$", "")


def head(counted: DataFrame, lines: Column) -> DataFrame:
    return counted.select("neuron_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), lines.alias("line"))


def title(counted: DataFrame, section: int, line: Column | str) -> DataFrame:
    value = F.lit(line) if isinstance(line, str) else line
    return counted.select("neuron_id", F.lit(section).alias("section"), F.lit(-1).cast("long").alias("place"), value.alias("line"))


def rows(df: DataFrame, section: int, place: Column, line: Column) -> DataFrame:
    return df.select("neuron_id", F.lit(section).alias("section"), place.cast("long").alias("place"), line.alias("line"))


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lineset_lines(vertices: DataFrame) -> DataFrame:
    """KEY of a line set of each neuron's trees: points numbered in depth-first order, a line of places and -1 for each segment.

    Radii, half of w, are written where all of a neuron's are known.
    """
    v = written(renumbered(vertices), "renumbered")
    seg = written(segment_order(v).filter("pos is not null"), "segments")
    # a tree of one point has no line
    many = seg.groupBy("neuron_id", "root", "seg_id").agg(F.count(F.lit(1)).alias("points"))
    seg = written(seg.join(many.filter("points > 1"), ["neuron_id", "root", "seg_id"]), "lines")
    sizes = v.groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("w").isNotNull() & ~F.isnan("w")).alias("wide"))
    lines = seg.groupBy("neuron_id").agg((F.count(F.lit(1)) + F.count_distinct("root", "seg_id")).alias("m"))
    counted = written(sizes.join(lines, "neuron_id", "left").withColumn("m", F.coalesce("m", F.lit(0))), "sizes")
    wide = F.col("wide")
    start = F.concat_ws(
        "\n", F.lit("# AmiraMesh ASCII 1.0\n"), F.concat(F.lit("define Lines "), F.col("m")), F.concat(F.lit("define Vertices "), F.col("n"), F.lit('\n\nParameters {\n    ContentType "HxLineSet"\n}\n')),
        F.lit("Vertices { float[3] Coordinates } = @1"), F.when(wide, "Vertices { float Data } = @2"), F.concat(F.lit("Lines { int LineIdx } = @"), F.when(wide, "3").otherwise("2"), F.lit("\n")),
    )
    points = rows(v, 1, F.col("point_no"), F.concat_ws(" ", text("x"), text("y"), text("z")))
    radii = rows(v.join(counted.filter("wide").select("neuron_id"), "neuron_id", "left_semi").withColumn("r", F.col("w") / 2), 2, F.col("point_no"), text("r"))
    # Lines follow each other by root, segment and place; the last point of one carries the -1 that closes it.
    last = F.col("pos") == F.col("points")
    line = F.concat((F.col("point_no") - 1).cast("string"), F.when(last, " -1").otherwise(""))
    runs = seg.select("neuron_id", F.lit(3).alias("section"), F.struct("root", "seg_id", "pos").alias("at"), line.alias("line"))
    body = together([head(counted, start), title(counted, 1, "@1"), points, title(counted.filter("wide"), 2, "\n@2"), radii, title(counted, 3, F.when(wide, "\n@3").otherwise("\n@2"))])
    nothing = F.struct(F.lit(-1).cast("long").alias("root"), F.lit(-1).cast("long").alias("seg_id"), F.col("place").alias("pos"))
    return body.select("neuron_id", "section", nothing.alias("place"), "line").unionByName(runs.withColumnRenamed("at", "place"))


def skeleton_lines(vertices: DataFrame) -> DataFrame:
    """KEY of a skeleton graph of each neuron: points in depth-first order, their neighbours' numbers and places, and radii."""
    v = written(renumbered(vertices), "renumbered")
    e = v.filter("parent <> -1")
    near = written(e.select("neuron_id", F.explode(F.array(F.struct(F.col("point_no").alias("a"), F.col("parent").alias("b")), F.struct(F.col("parent").alias("a"), F.col("point_no").alias("b")))).alias("s")).select("neuron_id", "s.a", "s.b"), "neighbours")
    counts = near.groupBy("neuron_id", F.col("a").alias("point_no")).agg(F.count(F.lit(1)).alias("near"))
    sizes = v.groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"), (2 * F.count_if(F.col("parent") != -1)).alias("m"))
    counted = written(sizes, "sizes")
    start = F.concat_ws("\n", F.lit("# AmiraMesh 3D ASCII 2.0\n"), F.concat(F.lit("nVertices "), F.col("n")), F.concat(F.lit("nEdges "), F.col("m"), F.lit('\n\nParameters {\n    ContentType "SkeletonGraph"\n}\n')), F.lit("Vertices { float[3] Coordinates } @1"), F.lit("Vertices { int NeighbourCount } @2"), F.lit("Vertices { float Radii } @3"), F.lit("EdgeData { int NeighbourList } @4\n"))
    known = v.join(counts, ["neuron_id", "point_no"], "left").withColumns({"near": F.coalesce("near", F.lit(0)), "r": F.col("w") / 2})
    at = F.col("point_no")
    radius = F.when(F.col("r").isNull() | F.isnan("r"), "NaN").otherwise(text("r"))
    parts = [head(counted, start), title(counted, 1, "@1"), rows(known, 1, at, F.concat_ws(" ", text("x"), text("y"), text("z"))), title(counted, 2, "\n@2"), rows(known, 2, at, F.col("near").cast("string")), title(counted, 3, "\n@3"), rows(known, 3, at, radius), title(counted, 4, "\n@4")]
    body = together(parts).select("neuron_id", "section", F.struct(F.col("place").alias("a"), F.lit(-1).cast("long").alias("b")).alias("place"), "line")
    return body.unionByName(near.select("neuron_id", F.lit(4).alias("section"), F.struct("a", "b").alias("place"), (F.col("b") - 1).cast("string").alias("line")))


def landmark_lines(marks: DataFrame) -> DataFrame:
    """KEY of landmark sets (neuron_id, set_id from 1, mark, x, y, z): pairs of sets with one number of marks; another number is an error."""
    sizes = marks.groupBy("neuron_id", "set_id").agg(F.count(F.lit(1)).alias("n")).groupBy("neuron_id").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max("set_id").alias("sets"))
    same = F.when(F.col("n") == F.col("most"), F.col("n")).otherwise(F.raise_error(F.lit("sets have different numbers of marks")).cast("long"))
    counted = written(sizes.select("neuron_id", same.alias("n"), "sets"), "sizes")
    every = F.sequence(F.lit(1).cast("long"), F.col("sets").cast("long"))
    named = F.transform(every, lambda k: F.concat(F.lit("Markers { float[3] Coordinates"), F.when(k == 1, "").otherwise(k.cast("string")), F.lit(" } @"), k.cast("string")))
    start = F.concat(F.lit("# AmiraMesh 3D ASCII 2.0\n\ndefine Markers "), F.col("n"), F.lit('\n\nParameters {\n\tContentType "LandmarkSet",\n\tNumSets '), F.col("sets"), F.lit("\n}\n"), F.array_join(named, "\n"))
    titles = counted.select("neuron_id", F.explode(every).alias("set_id")).select("neuron_id", F.col("set_id").cast("int").alias("section"), F.lit(-1).cast("long").alias("place"), F.concat(F.lit("\n@"), F.col("set_id")).alias("line"))
    points = marks.select("neuron_id", F.col("set_id").cast("int").alias("section"), F.col("mark").cast("long").alias("place"), F.concat_ws(" ", text("x"), text("y"), text("z")).alias("line"))
    return together([head(counted, start), titles, points])


def write(lines: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """A folder for each neuron, named neuron_id=..., with its lines in order."""
    ordered = lines.repartition("neuron_id").sortWithinPartitions("neuron_id", "section", "place")
    ordered.select("neuron_id", F.col("line").alias("value")).write.mode(mode).partitionBy("neuron_id").text(folder)


#: What can be written, by the format's name.
WRITERS = {"hxlineset": lineset_lines, "hxskel": skeleton_lines, "landmarks": landmark_lines}


def writer_for(form: str):
    """The function that makes a format's lines; an unknown one, or one that is only read, is an error."""
    if form not in WRITERS:
        known: dict[str, Format] = FORMATS
        raise ValueError(f"{form} is only read" if form in known else f"no such format: {form}")
    return WRITERS[form]
