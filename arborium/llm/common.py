"""What the operators of this subpackage share: word patterns, scratch tables, let-bindings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, scratch_root, written  # noqa: F401
from ..skew import join_spread

#: Characters that separate words, and a regular expression for a run of them.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """The text without its separators."""
    return F.translate(text, SPACES, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


#: One row a key is broadcast up to so many rows, else joined by shuffles that split hot keys.
BROADCAST_ROWS = 20_000


def small(df: DataFrame) -> DataFrame | None:
    """df as a broadcast if it has few rows, checked; None if not."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None


def lookup(rows: DataFrame, single: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with single, one row a key: by a broadcast if that is small, else by a join that splits hot keys."""
    few = small(single)
    return rows.join(few, key, how) if few is not None else join_spread(rows, single, key, how)


def numbered(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """df, stored, with each row's place from 0 in the order, and its number of rows.

    A range sort deals the rows to parts; a row's place in its part is counted there, and a part's base is a prefix sum
    over one row a part. A range sort reads df twice: pass a table, not a long computation.
    """
    at, part = fresh(df, "_at", "_part")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    stored = written(ordered, "numbered")
    of = F.shiftright(at, 33).cast("int").alias(part)
    counts = sorted(stored.groupBy(of).agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return stored.withColumnRenamed(at, name), 0
    ends = list(accumulate(n for _, n in counts))
    bases = [(p, end - n) for (p, n), end in zip(counts, ends, strict=True)]
    base = fresh(stored, "_base")[0]
    few = F.broadcast(session(df).createDataFrame(bases, f"{part} int, {base} long"))
    placed = stored.withColumn(part, of).join(few, part).withColumn(name, F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.drop(at, part, base), ends[-1]


def remove(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = session(df)
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Look-up tables that a Python worker keeps between its tasks.
KEPT: list[dict] = []


def keep_only(*tables: dict) -> None:
    """Called where a task starts: its tables stay for the worker's next tasks, those of other operators make room."""
    import pyarrow as pa

    for table in KEPT:
        if all(table is not t for t in tables):
            table.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc: freed memory goes back to the machine
        trim(0)
    KEPT.extend(t for t in tables if all(t is not k for k in KEPT))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names based on names that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def file_system(path: str):
    """(pyarrow file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: Lower-cases A-Z in UTF-8 bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


#: Rows of a batch whose texts are Python objects at a time.
DECODED_ROWS = 256


def utf8(column) -> Iterator[bytes | None]:
    """The values of an Arrow string column as bytes, decoded a few rows at a time: a batch isn't held twice."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for k in range(0, len(column), DECODED_ROWS):
        yield from column.slice(k, DECODED_ROWS).cast(kind).to_pylist()
