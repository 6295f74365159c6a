"""Formats by name: extension, magic bytes, parser; and the Spark readers over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats, swc


@dataclass(frozen=True)
class Format:
    """kind: trace, surface, landmarks or image."""

    name: str
    kind: str
    extensions: tuple[str, ...]
    magic: tuple[bytes, ...]
    parse: Callable


FORMATS: dict[str, Format] = {}


def register(form: Format) -> None:
    if form.name in FORMATS:
        raise ValueError(f"{form.name} is registered already")
    FORMATS[form.name] = form


for _form in (
    Format("hxlineset", "trace", (".am",), (b"# AmiraMesh",), formats.lineset),
    Format("hxskel", "trace", (".am",), (b"# AmiraMesh",), formats.skeleton),
    Format("traces", "trace", (".traces", ".xml"), (), formats.traces),
    Format("morphml", "trace", (".nml", ".mml", ".xml"), (), formats.morphml),
    Format("hxsurf", "surface", (".surf",), (b"# HyperSurface",), formats.surface),
    Format("ply", "surface", (".ply",), (b"ply",), formats.ply_mesh),
    Format("obj", "surface", (".obj",), (), formats.obj_mesh),
    Format("landmarks", "landmarks", (".landmarksascii", ".points", ".landmarks"), (), formats.landmarks),
    Format("nrrd", "image", (".nrrd",), (b"NRRD",), formats.nrrd),
    Format("raw_stack", "image", (".v3draw", ".vaa3draw"), (b"raw_image_stack_by_hpeng",), formats.raw_stack),
):
    register(_form)


def choose(name: str, head: bytes) -> Format:
    """The format of a file by its magic bytes (through gzip), else by its extension; ambiguity is an error."""
    start = formats.plain(head) if head[:2] == b"\x1f\x8b" else head
    marked = [f for f in FORMATS.values() if f.magic and start.startswith(f.magic) and name.lower().endswith(f.extensions)]
    named = [f for f in FORMATS.values() if name.lower().endswith(f.extensions)]
    found = marked or named
    if b"HxLineSet" in start or b"Lines" in start[:400]:
        found = [f for f in found if f.name != "hxskel"]
    if b"NeighbourCount" in start:
        found = [f for f in found if f.name != "hxlineset"]
    if b"<tracings" in start.lower()[:400]:
        found = [f for f in found if f.name == "traces"]
    if b"morphml" in start.lower()[:400] or b"neuroml" in start.lower()[:400]:
        found = [f for f in found if f.name == "morphml"]
    if len(found) != 1:
        raise ValueError(f"{name}: {len(found)} formats fit")
    return found[0]


SCHEMAS = {
    "trace": "point_no long, label int, x double, y double, z double, w double, parent long",
    "vertices": "vertex long, x double, y double, z double",
    "faces": "region string, face long, v1 long, v2 long, v3 long",
    "landmarks": "set_id long, name string, x double, y double, z double",
    "image": "i long, j long, k long, more array<long>, value double",
}

#: Voxels of an image that become rows at a time; further axes than three are indices in column more.
SLAB = 1 << 18


def slabs(values):
    """Tables (i, j, k, more, value) of an image of one to any number of dimensions, some voxels at a time; missing axes have index 1."""
    import numpy as np

    flat, names = values.ravel(order="F"), ("i", "j", "k")
    for first in range(0, flat.size, SLAB):
        at = np.unravel_index(np.arange(first, min(first + SLAB, flat.size)), values.shape, order="F")
        ones = np.ones(len(at[0]), np.int64)
        table = pd.DataFrame({c: at[n].astype(np.int64) + 1 if n < len(at) else ones for n, c in enumerate(names)})
        table["more"] = list(np.stack([a + 1 for a in at[3:]], 1)) if len(at) > 3 else [[]] * len(table)
        table["value"] = flat[first : first + SLAB].astype(float)
        yield table


def files(spark: SparkSession, path: str) -> DataFrame:
    """neuron_id, content, md5 of each file; names must differ."""
    read = spark.read.format("binaryFile").load(path)
    return read.select(swc.base_name(F.col("path")).alias("neuron_id"), "content", F.md5("content").alias("md5"))


def parsed(found: DataFrame, form: str, part: str, omit_failures: bool = False) -> DataFrame:
    """Rows of the files in found (neuron_id, content) by a format; part is a key of SCHEMAS.

    A file that can't be read is an error, or is left out with omit_failures.
    """
    parse, names = FORMATS[form].parse, [c.split()[0] for c in SCHEMAS[part].split(", ")]

    def rows(frames):
        for frame in frames:
            for name, content in zip(frame["neuron_id"], frame["content"], strict=True):
                try:
                    out = parse(bytes(content))
                except Exception:
                    if not omit_failures:
                        raise
                    continue
                if part in ("vertices", "faces"):
                    out = out[part == "faces"]
                if part == "image":
                    for table in slabs(out[1] if isinstance(out, tuple) else out):
                        table.insert(0, "neuron_id", name)
                        yield table
                    continue
                table = pd.DataFrame(list(out), columns=names)
                table.insert(0, "neuron_id", name)
                yield table

    return found.select("neuron_id", "content").mapInPandas(rows, f"neuron_id string, {SCHEMAS[part]}")


def read(spark: SparkSession, path: str, form: str, part: str | None = None, omit_failures: bool = False) -> DataFrame:
    if form == "swc":
        return swc.read(spark, path)
    return parsed(files(spark, path), form, part or FORMATS[form].kind, omit_failures)


def newer(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content known (neuron_id, md5) doesn't have: what an incremental load parses again."""
    return found.join(known.select("neuron_id", "md5"), ["neuron_id", "md5"], "left_anti")
