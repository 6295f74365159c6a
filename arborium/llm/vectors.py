"""Near-duplicate vectors: cosines of all pairs of a label, by tile products of int8 vectors with rigorous error bounds.

1. One pass over the vectors checks them and takes a digest; equal vectors of a label are one class from here on.
2. The classes of a label (and length) are cut into blocks of a bounded number of bytes; a unit holds two blocks, or one
   with itself. Pairs exist inside a unit only, as cells of a matrix.
3. Each vector u of length 1 is stored as q, int8, and a scale s: u = s q + e. With the norms |s q| and |e|, computed from the vector
   itself, the cosine of u and v differs from s s' (q . q') by at most |s q| |e'| + |e|, since |v| = 1. Products of int8
   vectors are sums of integers, taken exactly. A pair whose value less the bound reaches the threshold is linked, one
   whose value and bound don't is not, and only those between are computed again, in double precision.
4. A unit yields how many vectors each class is linked with, and a spanning forest of its links, fewer rows than it has
   classes. Components come from the forests.

Defined results: vectors that are null, empty, zero or hold nulls or non-finite numbers, and those without a label or an
id, link with nothing (component: their own id); so do vectors of unequal length; rows that repeat an id are vectors of
their own, which are linked, and share a component, by their cosine alone; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import join_spread
from .common import lookup, numbered, written
from .neardup import components

THRESHOLD = 0.93
#: A block has at most so many classes, and so many bytes as doubles.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: More than all rounding errors of a cosine.
ROUNDING = 1e-9
#: int8 products of so many components are exact in single precision: 127 * 127 * EXACT < 2 ** 24.
EXACT = 1024
#: Numbers that a second look at pairs holds at a time.
LOOK = 1 << 20


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, key, embedding of each row; key is null for vectors that link with nothing."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims = [], []
            for vec_id, label, row in zip(batch.column("vec_id"), batch.column("label"), batch.column("embedding"), strict=True):
                values = row.values.to_numpy(zero_copy_only=False).astype(np.float64) if row.is_valid and len(row.values) and not row.values.null_count else np.zeros(0)
                fit = vec_id.is_valid and label.is_valid and np.isfinite(values).all() and values.any()
                dims.append(len(values))
                keys.append(hashlib.blake2b((values + 0.0).tobytes(), digest_size=16, person=b"vec", salt=hashlib.blake2b(label.as_py().encode(), digest_size=16).digest()).digest() if fit else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), batch.column("embedding")], names=["vec_id", "label", "dim", "key", "embedding"])

    narrow = vectors.selectExpr("cast(vec_id as long) as vec_id", "cast(label as string) as label", "embedding")
    kind = narrow.schema["embedding"].dataType.simpleString()
    return narrow.mapInArrow(look, f"vec_id long, label string, dim int, key binary, embedding {kind}")


def blocks(classes: DataFrame) -> DataFrame:
    """classes (label, dim, key and others), a table, with class_no, block, blocks."""
    placed, _ = numbered(classes, ["label", "dim", "key"], "class_no")
    kinds = written(placed.groupBy(F.struct("label", "dim").alias("kind")).agg(F.min("class_no").alias("first"), F.count(F.lit(1)).alias("n")), "vector-kinds")
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_BYTES / (8 * F.col("dim"))))).cast("long")
    held = lookup(placed.withColumn("kind", F.struct("label", "dim")), kinds, "kind").withColumn("rows", rows)
    return held.withColumns({"block": F.expr("(class_no - first) div rows").cast("int"), "blocks": F.ceil(F.col("n") / F.col("rows")).cast("int")}).drop("kind", "first", "n", "rows")


def units(placed: DataFrame) -> DataFrame:
    """placed once for each unit (label, dim, i, j) of its block, with side 0 or 1."""
    b = F.col("block")
    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.least(b, q).alias("i"), F.greatest(b, q).alias("j"), (b > q).cast("int").alias("side")))
    return placed.withColumn("at", F.explode(at)).select("label", "dim", "at.i", "at.j", "at.side", "class_no", "copies", "embedding")


class Tile:
    """Vectors of length 1 and their int8 form: scales, norms of what int8 holds and of what it leaves."""

    def __init__(self, values: np.ndarray):
        top = np.abs(values).max(1, keepdims=True)
        scaled = values / top  # no square overflows or vanishes
        self.unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
        self.scale = np.abs(self.unit).max(1) / 127
        self.q = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        kept = self.q * self.scale[:, None]
        self.held = np.sqrt(np.einsum("ij,ij->i", kept, kept))
        left = self.unit - kept
        self.lost = np.sqrt(np.einsum("ij,ij->i", left, left))


def linked(a: Tile, b: Tile, threshold: float = THRESHOLD) -> tuple[np.ndarray, int]:
    """(matrix of links, pairs that were computed again)."""
    dot = np.zeros((len(a.q), len(b.q)))
    for k in range(0, a.q.shape[1], EXACT):
        dot += a.q[:, k : k + EXACT].astype(np.float32) @ b.q[:, k : k + EXACT].astype(np.float32).T
    dot *= a.scale[:, None] * b.scale
    bound = a.held[:, None] * b.lost + a.lost[:, None] + ROUNDING
    links = dot - bound >= threshold
    rows, columns = np.nonzero((dot + bound >= threshold) & ~links)
    step = max(1, LOOK // max(1, a.q.shape[1]))
    for k in range(0, len(rows), step):
        i, j = rows[k : k + step], columns[k : k + step]
        links[i, j] = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= threshold
    return links, len(rows)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, row) that connect what a symmetric matrix of links does, without circles; each row is looked at once."""
    fresh, out = links.any(1), []
    for start in np.flatnonzero(fresh):
        if not fresh[start]:
            continue
        fresh[start] = False
        stack = [start]
        while stack:
            k = stack.pop()
            found = np.flatnonzero(links[k] & fresh)
            fresh[found] = False
            out.extend((int(k), int(f)) for f in found)
            stack.extend(found)
    return out


def of_unit(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(class numbers, vectors linked with each, edges) of a unit."""
    table = table.combine_chunks().sort_by([("side", "ascending"), ("class_no", "ascending")])
    values = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    number, copies = table.column("class_no").to_numpy(), table.column("copies").to_numpy()
    one = int((table.column("side").to_numpy() == 0).sum())
    both = np.zeros((table.num_rows, table.num_rows), bool)
    if one == table.num_rows:
        tile = Tile(values)
        both |= linked(tile, tile, threshold)[0]
        both |= both.T
        np.fill_diagonal(both, False)
    else:
        both[:one, one:] = linked(Tile(values[:one]), Tile(values[one:]), threshold)[0]
        both |= both.T
    return number, both @ copies, [(int(number[u]), int(number[v])) for u, v in forest(both)]


def found_in(held: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): with b null, how many vectors of other classes class a is linked with in a unit; else an edge."""

    def compare(table: pa.Table) -> pa.Table:
        number, n, edges = of_unit(table, threshold)
        at = np.flatnonzero(n)
        a = [*number[at].tolist(), *(u for u, _ in edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([*[None] * len(at), *(v for _, v in edges)], pa.int64()), "n": pa.array([*n[at].tolist(), *[0] * len(edges)], pa.int64())})

    return held.groupBy("label", "dim", "i", "j").applyInArrow(compare, "a long, b long, n long")


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each of vectors (vec_id, label, embedding)."""
    if not 0 < threshold <= 1 or not math.isfinite(threshold):
        raise ValueError("the threshold is a positive cosine")
    seen = written(digests(vectors), "vector-digests")
    known = seen.filter("key is not null")
    first = known.groupBy("key").agg(F.min_by(F.struct("label", "dim", "embedding"), "vec_id").alias("v"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    placed = written(blocks(written(first.select("key", "v.*", "first_id", "copies"), "vector-classes")), "vector-blocks")
    found = written(found_in(units(placed), threshold), "vector-links")
    slim = placed.select("key", "class_no", "first_id", "copies")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    groups = components(found.filter("b is not null").selectExpr("a as u", "b as v"))
    marked = slim.join(counts, slim.class_no == counts.a, "left").drop("a").join(groups, F.col("class_no") == F.col("node"), "left").drop("node")
    marked = written(marked.select("key", F.coalesce("component", "class_no").alias("component"), "first_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-groups")
    least = marked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = written(join_spread(marked.select("key", "component", "n_links"), least, "component").select("key", "n_links", "component_id"), "vector-components")
    rows = join_spread(known.select("vec_id", "key"), of, "key").select("vec_id", "n_links", "component_id")
    others = seen.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON l.u = r.w)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e
LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) x ON x.u = e.vec_id JOIN (SELECT u, min(w) AS c FROM r GROUP BY u) y ON y.u = e.vec_id
"""
