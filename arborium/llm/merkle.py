"""Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from the root.

H is SHA-256 over the inputs, digests as lowercase hex text. A row is a leaf; per lang the leaves ascend by id, and every
FAN consecutive nodes become their H until one is left, the subroot; subroots, ordered by lang, give the root in the same way.

1. One pass over the texts makes the leaves, and those of the rows as they are found later (here: with some texts changed).
   Texts aren't read again. Leaves are numbered by a range sort and prefix sums over its parts.
2. Each level groups FAN nodes at most: (tree, place / FAN) is the key, so no group grows. Every node is stored as a record
   digest -> digests of its children; equal nodes have one record. Two trees of trees are made alike, the leaves' and the subroots'.
3. Requests are the leaves' places. They descend from the root together: a node of a tree of height h that h - 1 more steps
   part from its requests looks its record up by digest, and each child that a request's rank digit (base FAN) names goes on
   with the path so far and the other children as a new segment. Requests with a common way share it, so a level has at most
   one row a node. The last step is each request's own, in its parent's record.
4. Segments were met from the root down; reversed they are the proof from the leaf up.

Joins by digest split digests that many nodes share (copies of a subtree).

Defined results: null is `-` in a leaf; null ids come first in their lang, rows that share an id are ordered by leaf; repeated
rows are leaves of their own; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import hot_of, join_spread
from .common import ascii_lower, lookup, numbered, small, written

#: Children of a node.
FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(hex_parts: Column) -> Column:
    """H of an array of binary digests, as binary."""
    return F.unhex(F.sha2(F.array_join(F.transform(hex_parts, lambda d: F.lower(F.hex(d))), ""), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(*values: Column) -> Column:
    """H of the values, each `-` if null, else UTF-8 bytes, a colon and itself."""
    part = lambda v: F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.unhex(F.sha2(F.concat(*(part(v.cast("string")) for v in values)), 256))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.length(F.conv((n - 1).cast("string"), 10, FAN)) - F.when(n == 1, 1).otherwise(0)


class Forest:
    """Trees over leaves (tree, place, digest, n): a table records (digest, children) and a table roots (tree, n, digest)."""

    def __init__(self, leaves: DataFrame, name: str):
        level = leaves
        records, roots = [], [level.filter("n = 1").select("tree", "n", "digest")]
        high = leaves.agg(F.max(height(F.col("n")))).first()[0] or 0
        for k in range(1, high + 1):
            child = F.struct((F.col("place") % FAN).alias("at"), "digest")
            grouped = level.filter(height(F.col("n")) >= k).groupBy("tree", F.floor(F.col("place") / FAN).alias("up"))
            nodes = grouped.agg(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["digest"]).alias("children"), F.first("n").alias("n")).withColumnRenamed("up", "place")
            level = written(nodes.withColumn("digest", digest(F.col("children"))), f"{name}-level")
            records.append(level.select("digest", "children"))
            roots.append(level.filter(height(F.col("n")) == k).select("tree", "n", "digest"))
        self.height, self.name = high, name
        self.levels = records
        self.roots = roots[0]
        for r in roots[1:]:
            self.roots = self.roots.unionByName(r)

    def descend(self, roots: DataFrame) -> DataFrame:
        """(tree, place, n, path, children): from roots (tree, n, digest, path) to the nodes above the leaves; children is null where a root is a leaf."""
        done = [roots.filter("n = 1").select("tree", F.lit(0).cast("long").alias("place"), "n", "path", F.array(F.col("digest")).alias("children"))]
        state = roots.filter("n > 1").select("tree", F.lit(0).cast("long").alias("place"), "n", "digest", "path")
        for k in range(self.height, 0, -1):
            # trees of height k start here
            level = self.levels[k - 1].dropDuplicates(["digest"])
            met = state.filter(height(F.col("n")) >= k)
            later = state.filter(height(F.col("n")) < k)
            opened = lookup_nodes(met, level)
            if k == 1:
                done.append(opened.select("tree", "place", "n", "path", "children"))
                break
            down = opened.select("tree", "place", "n", "path", "children", F.posexplode("children").alias("at", "digest"))
            step = down.select("tree", (F.col("place") * FAN + F.col("at")).alias("place"), "n", "digest", F.concat("path", F.array(segment(F.col("children"), F.col("at")))).alias("path"))
            state = written(step.unionByName(later), f"{self.name}-descent")
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out


SEGMENT = "struct<at:int,siblings:array<binary>>"


def segment(children: Column, at: Column) -> Column:
    """Where a child stands in its run, and the run's others."""
    others = F.concat(F.slice(children, F.lit(1), at), F.slice(children, at + 2, F.lit(FAN)))
    return F.struct(at.cast("int").alias("at"), others.alias("siblings"))


def lookup_nodes(state: DataFrame, level: DataFrame) -> DataFrame:
    """state with the children that its digests' records hold."""
    few = small(level)
    if few is not None:
        return state.join(few, "digest")
    counts = state.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return join_spread(state, level, "digest", hot=hot_of(counts, state.count()))


def proof_hash(path: Column) -> Column:
    """H of all siblings, segments from the leaf up."""
    return F.sha2(F.array_join(F.transform(F.flatten(F.transform(path, lambda s: s["siblings"])), as_hex), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path, from the leaf up, give."""
    return F.aggregate(path, start, lambda now, s: digest(F.concat(F.slice(s["siblings"], F.lit(1), s["at"]), F.array(now), F.slice(s["siblings"], s["at"] + 1, F.lit(FAN)))))


def prove(rows: DataFrame) -> DataFrame:
    """All columns of rows, a table (lang, doc_id, leaf), with subroot, root, path: binary digests, and the segments from the leaf up."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"]
    placed, total = numbered(rows, order, "at")
    if not total:
        return rows.withColumns({"subroot": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary"), "path": F.lit(None).cast(f"array<{SEGMENT}>")})
    langs = placed.groupBy("lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    langs = numbered(langs, [F.col("lang").asc_nulls_first()], "tree")[0]
    ranked = written(placed.withColumn("_lang", F.struct("lang")).drop("lang").transform(lambda d: lookup(d, written(langs.select(F.struct("lang").alias("_lang"), "first", "tree", "n"), "langs"), "_lang")).selectExpr("_lang.lang as lang", "tree", "at - first as place", "n", *(c for c in rows.columns if c != "lang")), "leaves")
    trees = Forest(ranked.select("tree", "place", "n", F.col("leaf").alias("digest")), "merkle")
    subroots = written(trees.roots, "subroots")
    many = subroots.count()
    top = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(many).cast("long").alias("n"), "digest"), "merkle-top")
    root = top.roots.first().digest
    start = top.roots.select("tree", "n", "digest", F.expr(f"cast(array() as array<{SEGMENT}>)").alias("path"))
    above = requests(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(many).cast("long").alias("n"), F.col("tree").alias("of")), top.descend(start))
    ways = above.select(F.col("of").alias("tree"), "path").join(subroots, "tree").select("tree", "n", "digest", "path")
    parents = written(trees.descend(written(ways, "merkle-ways")), "merkle-parents")
    proven = requests(ranked, parents)
    held = lookup(proven, subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    return held.select(*rows.columns, "subroot", F.lit(root).alias("root"), F.reverse("path").alias("path"))


def requests(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """ranked (tree, place, n and others) with the path of each of its leaves, from the root down."""
    known = parents.select("tree", F.col("place").alias("_above"), "children", F.col("path").alias("_path"))
    asked = ranked.withColumns({"_above": F.floor(F.col("place") / FAN), "_digit": (F.col("place") % FAN).cast("int")})
    met = asked.join(known, ["tree", "_above"])
    path = F.when(F.col("n") > 1, F.concat("_path", F.array(segment(F.col("children"), F.col("_digit"))))).otherwise(F.col("_path"))
    return met.withColumn("path", path).drop("_above", "_digit", "_path", "children")


def verify(docs: DataFrame, tampered: Column, change) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of each of docs; folded_root and verified after change(text) where tampered holds."""
    own = leaf(*(F.col(c) for c in COLUMNS))
    later = leaf(*(F.when(tampered, change(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS))
    proven = prove(written(docs.select("doc_id", "lang", own.alias("leaf"), F.when(tampered, later).otherwise(own).alias("later")), "merkle-texts"))
    out = proven.select("doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"), proof_hash(F.col("path")).alias("proof_sha256"), as_hex(folded(F.col("later"), F.col("path"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame) -> DataFrame:
    """verify() with the A-Z of those texts lower-cased whose id's CRC-32, as decimal text, 3 divides."""
    return verify(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0, ascii_lower)


def oracle_sql(levels: int = 7, top_levels: int = 3) -> str:
    """manifest() in DuckDB SQL, for langs of up to FAN ** levels rows, FAN ** top_levels langs."""
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR END"
    leaf_of = lambda text: "sha256(" + " || ".join([*(part(c) for c in COLUMNS[:-1]), part(text)]) + ")"
    bits = "list_transform(x, lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"  # one shift of the table of byte remainders
    table = ", ".join(f"c{k + 1} AS (SELECT {bits} AS x FROM c{k})" for k in range(8))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(i, ''), lambda c: ascii(c)::BIGINT)), lambda a, d: xor(a >> 8, x[(xor(a & 255, d) + 1)::INT])), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def trees(name: str, count: int) -> str:
        out = []
        for k in range(count):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT g, idx // {FAN} AS up, list(d ORDER BY idx) AS run, n FROM {name}n{k} WHERE n > 1 GROUP BY ALL)")
            out.append(f"{name}n{k + 1} AS MATERIALIZED (SELECT g, up AS idx, sha256(array_to_string(run, '')) AS d, (n + {FAN - 1}) // {FAN} AS n FROM {name}r{k})")
        ends = " UNION ALL ".join(f"SELECT g, d FROM {name}n{k} WHERE n = 1" for k in range(count + 1))
        return ", ".join([*out, f"{name}roots AS MATERIALIZED ({ends})"])

    def climb(name: str, before: str, rank: str, group: str, count: int) -> str:
        out, last = [], before
        for k in range(count):
            at = f"({rank} // {FAN**k} % {FAN})"
            without = lambda mid, at=at: f"array_to_string(run[1:{at}], '') || {mid} || array_to_string(run[{at} + 2:], '')"
            out.append(f"{name}p{k} AS (SELECT a.* EXCLUDE (cur, proof), CASE WHEN run IS NULL THEN cur ELSE sha256({without('cur')}) END AS cur, CASE WHEN run IS NULL THEN proof ELSE proof || {without(chr(39) * 2)} END AS proof FROM {last} a LEFT JOIN {name}r{k} r ON r.g = {group} AND r.up = {rank} // {FAN ** (k + 1)})")
            last = f"{name}p{k}"
        return ", ".join(out)

    return f"""
WITH c0 AS (SELECT range(256) AS x), {table},
t AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS i FROM documents),
l AS (SELECT doc_id, coalesce('x' || lang, '') AS g, {leaf_of("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf_of(low)} ELSE {leaf_of("text")} END AS cur, '' AS proof FROM t, c8),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l),
an0 AS (SELECT g, rank AS idx, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM b),
{trees("a", levels)},
s AS (SELECT g AS h, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM aroots),
bn0 AS (SELECT '' AS g, place AS idx, subroot AS d, count(*) OVER () AS n FROM s),
{trees("b", top_levels)},
{climb("a", "b", "rank", "a.g", levels)},
q AS (SELECT * FROM ap{levels - 1} JOIN s ON s.h = g),
{climb("b", "q", "place", "''", top_levels)}
SELECT doc_id, leaf, subroot, (SELECT d FROM broots) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT d FROM broots) AS verified FROM bp{top_levels - 1}
"""
