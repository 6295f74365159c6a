"""Coordinates as strings and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xyz_of(text: Column) -> Column:
    """struct(x, y, z) of a string such as "(1, 2, 3)": what isn't part of a number separates; null without three numbers."""
    found = F.regexp_extract_all(text, F.lit(r"-?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?"), F.lit(0))
    cells = F.transform(found, lambda v: v.cast("double"))
    return F.when(F.size(cells) == 3, F.struct(cells[0].alias("x"), cells[1].alias("y"), cells[2].alias("z")))


def xyz_text(x: Column, y: Column, z: Column, digits: int = 2, separator: str = ",") -> Column:
    """Coordinates with a fixed number of digits."""
    return F.concat_ws(separator, *(F.format_string(f"%.{digits}f", c) for c in (x, y, z)))


def xyz_list(x: Column, y: Column, z: Column) -> Column:
    return F.array(x, y, z)


def angle(a: str, b: str) -> Column:
    """Angle between two struct columns, with the cosine held within -1 and 1."""
    dot = lambda p, q: sum(F.col(f"{p}.{c}") * F.col(f"{q}.{c}") for c in "xyz")
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))))
