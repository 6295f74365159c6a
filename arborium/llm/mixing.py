"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target number of words. A document of a source is expected target / source_size
times in the mix; the expected copies are prefix-summed over the source's documents, a random offset
of the source is added, and a document is emitted once for each integer that its step crosses.

The documents of a source are laid out by size, so that documents of all lengths are taken evenly and
the words taken come near the target. The layout has cells (source, size class, salt); a cell holds
about ROWS_PER_CELL rows however large the source is, ranks are counted inside cells, and the cells'
bases are prefix sums over their row counts. No source is ever gathered in one task, and no list of sources either:
sources are ranked by a range sort with prefix sums over its parts, and the level to which targets are filled is
found by sums over all sources, again until no further source stops. A cell that many rows with one id and text
overfill is cut once more, by the rows' places in the stored table.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated
rows are documents of their own, alike in all but their copies; an empty table gives an empty table; columns besides those named are
carried along, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..skew import hot_of, join_spread
from .common import fresh, small, words, written

#: Weights by the sources' rank, repeating.
WEIGHTS = (3, 1, 2)
#: A cell has this many rows, or the 65,536th part of all rows if that is more.
ROWS_PER_CELL = 256
MOST_CELLS = 65_536
#: A cell with so many times its rows is cut again; there are fewer than MOST_CELLS such cells.
OVERFULL = 8


def text_size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def unit_hash(value: Column) -> Column:
    """32 bits of a string's MD5 as a long."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Sizes that share their four leading bits and their number of bits share a class."""
    bits = F.length(F.bin(size)).cast("long")
    return bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)).cast("int"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0, by code point and null last: places in parts of a range sort, and prefix sums over the parts."""
    parts = sources.repartitionByRange("is_null", "source").withColumn("part", F.spark_partition_id())
    parts = written(parts.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy("is_null", "source"))), "mix-sources")
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(counts)
    bases = dict(zip(order, accumulate([0, *(counts[k] for k in order)]), strict=False))
    base = F.element_at(F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*(F.lit(bases[k]).cast("long") for k in order))), F.col("part")) if order else F.lit(0)
    return parts.withColumn("rank", base + F.col("place") - 1).drop("part", "place")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(is_null, source, source_size) with one row a source -> the same with target.

    Targets are share * all sizes, dealt by weight; a target stops at cap * source_size and the excess is dealt
    again by weight, until none is above. Each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    weighed = written(ranked(sources).withColumn("weight", weight).drop("rank"), "mix-weights")
    level, stopped = None, F.lit(False)
    while True:
        n, total, held, free = weighed.agg(F.count_if(stopped), F.sum("source_size"), F.sum(F.when(stopped, F.col("source_size")).otherwise(0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        if not free or (level is not None and n == before):
            break
        before, level = n, (share * total - cap * held) / free
        stopped = F.lit(level) * F.col("weight") >= cap * F.col("source_size")
    return weighed.select("is_null", "source", "source_size", F.when(stopped, cap * F.col("source_size")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(rows: DataFrame, source: str, size: str, key: str, tie: str, place: str, *, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """All rows and columns, with struct column mix(source_size, target, copies).

    key and tie, a hash of the text, order the rows of a size; place is a number of the row that is stored with it. rows is
    read several times: pass a table, not a long computation.
    """
    is_null, name, klass, kind, salt, rank, base, drawn = fresh(rows, "mix_null", "mix_source", "mix_class", "mix_kind", "mix_salt", "mix_rank", "mix_base", "mix")
    keyed = rows.withColumns({is_null: F.col(source).isNull(), name: F.coalesce(F.col(source), F.lit("")), klass: size_class(F.col(size))})
    classes = written(keyed.groupBy(F.col(is_null).alias("is_null"), F.col(name).alias("source"), F.col(klass).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words")), "mix-classes")
    per_source = targets(classes.groupBy("is_null", "source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    total = classes.agg(F.sum("n")).first()[0] or 0
    per_cell = max(rows_per_cell, total // MOST_CELLS)
    spread = classes.select(F.struct(F.col("is_null").alias(is_null), F.col("source").alias(name), F.col("class").alias(klass)).alias(kind), F.ceil(F.col("n") / per_cell).cast("long").alias("mix_spread"), "n")
    few, keyed = small(spread), keyed.withColumn(kind, F.struct(is_null, name, klass))
    joined = keyed.join(few.drop("n"), kind) if few is not None else join_spread(keyed, spread.drop("n"), kind, hot=hot_of(spread.select(kind, "n"), total))
    salted = joined.withColumn(salt, unit_hash(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(tie))) % F.col("mix_spread")).drop(kind)
    cell = [is_null, name, klass, salt]
    cells = written(salted.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.first("mix_spread").alias("mix_spread")), "mix-salts")
    full = cells.filter(F.col("n") > OVERFULL * per_cell)
    if full.head(1):
        parts = F.ceil(F.col("n") / per_cell).cast("long").alias("mix_parts")
        cut = salted.join(F.broadcast(full.select(*cell, parts)), cell, "left")
        again = F.when(F.col("mix_parts").isNotNull(), F.col("mix_spread") * (1 + F.pmod(F.col(place), F.col("mix_parts")))).otherwise(0)
        salted = cut.withColumn(salt, F.col(salt) + again).drop("mix_parts")
        cells = salted.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    salted, cells = salted.drop("mix_spread"), cells.select(*cell, "n")
    bases = cells.withColumn(base, F.sum("n").over(W.partitionBy(is_null, name).orderBy(klass, salt)) - F.col("n")).drop("n")
    plan = bases.join(per_source.select(F.col("is_null").alias(is_null), F.col("source").alias(name), "source_size", "target"), [is_null, name])
    plan = written(plan.select(*cell, base, F.struct("source_size", "target").alias(drawn)), "mix-cells")
    ranked = salted.withColumn(rank, F.row_number().over(W.partitionBy(*cell).orderBy(size, key, tie)))
    few = small(plan)
    placed = ranked.join(plan if few is None else few, cell)
    offset = unit_hash(F.concat(F.lit(f"{seed}:"), F.col(name), F.when(F.col(is_null), "!").otherwise(""))) / F.lit(4294967296.0)
    rate = F.when(F.col(f"{drawn}.source_size") > 0, F.col(f"{drawn}.target") / F.col(f"{drawn}.source_size")).otherwise(0.0)
    last = F.floor(offset + (F.col(base) + F.col(rank)) * rate)
    first = F.floor(offset + (F.col(base) + F.col(rank) - 1) * rate)
    return placed.withColumn(drawn, F.struct(F.col(f"{drawn}.source_size"), F.col(f"{drawn}.target"), (last - first).cast("long").alias("copies"))).select(*rows.columns, F.col(drawn).alias("mix") if "mix" not in rows.columns else F.col(drawn))


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each document."""
    sized = written(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), text_hash(F.col("text")).alias("tie"), F.monotonically_increasing_id().alias("place")), "mix-sizes")
    drawn = mix(sized, "source", "size", "doc_id", "tie", "place", **options)
    return drawn.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).alias("taken"), "mix.copies")


def mixed_stage(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; texts are split into words once."""
    size, tie, place, copy = fresh(docs, "mix_size", "mix_tie", "mix_place", "mix_copy")
    sized = written(docs.withColumns({size: text_size(F.col("text")), tie: text_hash(F.col("text")), place: F.monotonically_increasing_id()}), "mix-sizes")
    drawn = mix(sized, "source", size, "doc_id", tie, place, **options)
    mixed = drawn.columns[-1]
    return drawn.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(f"{mixed}.copies").cast("int")))).select(*docs.columns)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS tie, source, source IS NULL AS is_null, coalesce(source, '') AS s,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
k AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM d),
src AS (SELECT is_null, s, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY is_null, s) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM src),
l AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - 2.0 * (sum(source_size) OVER (ORDER BY source_size / weight, is_null, s ROWS UNBOUNDED PRECEDING) - source_size)::DOUBLE)
             / sum(weight) OVER (ORDER BY source_size / weight, is_null, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN level * weight < 2.0 * source_size THEN level END) OVER () AS final FROM l),
t AS (SELECT is_null, s, source_size, CASE WHEN level * weight >= 2.0 * source_size THEN 2.0 * source_size ELSE weight * final END AS target FROM f),
p AS (SELECT *, ceil(count(*) OVER (PARTITION BY is_null, s, class) / greatest({ROWS_PER_CELL}, (SELECT count(*) FROM d) // {MOST_CELLS})::DOUBLE)::BIGINT AS spread FROM k),
q AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 8))::BIGINT % spread AS salt FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY is_null, s ORDER BY class, salt, size, doc_id, tie) AS pos FROM q),
c AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.pos,
             ('0x' || substr(md5('0:' || r.s || CASE WHEN r.is_null THEN '!' ELSE '' END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM r JOIN t ON r.is_null = t.is_null AND r.s = t.s),
e AS (SELECT *, (floor(u + pos * rate) - floor(u + (pos - 1) * rate))::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM e
"""
