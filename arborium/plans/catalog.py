"""Named queries over the star-schema tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coordinates as X
from ..operators import collections as C
from ..operators import editing as E
from ..operators import geometry as G
from ..operators import images as I
from ..operators import morphometry as M
from ..operators import spatial as S
from ..operators import stitching as H
from ..operators import surfaces as U
from ..operators import topology as T
from . import tables as D

FLAGSHIP = "summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, shape: str | None = None):
    """Registers a function of (spark, sf_dir), or of a tree table if a shape is given; v is that table in the SQL."""

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(D.trees(spark, sf_dir, shape))) if shape else f
        if sql:
            parts = [p for p in [f"v AS ({D.tree_sql(shape)})" if shape else ""] if p]
            body = sql.strip()
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if '/*rec*/' in body else ''}{parts[0]}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}" if parts else body
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Columns rounded; negative zero becomes zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def at_point(vertices: DataFrame, n: int) -> DataFrame:
    return vertices.filter(F.col("point_no") == n).select(*T.KEY)


# Pieces of SQL over v, a tree table.
EDGE = "e AS (SELECT c.*, p.x AS px, p.y AS py, p.z AS pz, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z)) AS len FROM v c JOIN v p ON c.neuron_id = p.neuron_id AND c.parent = p.point_no)"
NODE = "g AS (SELECT v.*, coalesce(k.n, 0) AS n_children, coalesce(k.n, 0) + CASE WHEN parent <> -1 THEN 1 ELSE 0 END AS degree FROM v LEFT JOIN (SELECT neuron_id, parent AS p, count(*) AS n FROM v WHERE parent <> -1 GROUP BY ALL) k ON k.neuron_id = v.neuron_id AND k.p = v.point_no)"
DEPTH = "/*rec*/ t AS (SELECT neuron_id, point_no, point_no AS root, CAST(0 AS DOUBLE) AS dist, CAST(0 AS BIGINT) AS depth FROM v WHERE parent = -1 UNION ALL SELECT e.neuron_id, e.point_no, t.root, t.dist + e.len, t.depth + 1 FROM t JOIN e ON e.neuron_id = t.neuron_id AND e.parent = t.point_no)"
ANCESTOR = "/*rec*/ a AS (SELECT neuron_id, point_no, point_no AS anc, CAST(0 AS DOUBLE) AS up FROM v UNION ALL SELECT a.neuron_id, a.point_no, e.parent, a.up + e.len FROM a JOIN e ON e.neuron_id = a.neuron_id AND e.point_no = a.anc)"
SEG = "/*rec*/ s AS (SELECT neuron_id, point_no AS tail, point_no AS cur, parent AS nxt FROM g WHERE parent <> -1 AND degree <> 2 UNION ALL SELECT s.neuron_id, s.tail, g.point_no, g.parent FROM s JOIN g ON g.neuron_id = s.neuron_id AND g.point_no = s.nxt WHERE g.degree = 2 AND g.parent <> -1)"
SEGMENTS = f"{EDGE}, {NODE}, {SEG}, sg AS (SELECT s.neuron_id, s.tail, min_by(s.nxt, t.depth) AS head, count(*) + 1 AS n_points, sum(e.len) AS length FROM s JOIN e ON e.neuron_id = s.neuron_id AND e.point_no = s.cur JOIN t ON t.neuron_id = s.neuron_id AND t.point_no = s.cur GROUP BY s.neuron_id, s.tail)"


@query("summary", f"""WITH {EDGE}, {NODE} SELECT g.neuron_id, min(CASE WHEN g.parent = -1 THEN g.point_no END) AS root, count(*) AS nodes,
 count(*) FILTER (g.parent <> -1 AND degree <> 2) AS segments, count(*) FILTER (degree > 2) AS branchpoints, count(*) FILTER (degree = 1) AS endpoints,
 count(*) FILTER (g.parent = -1) AS n_trees, round(coalesce(sum(e.len), 0), 4) AS cable_length FROM g LEFT JOIN e ON e.neuron_id = g.neuron_id AND e.point_no = g.point_no GROUP BY g.neuron_id""", "heap")
def summary(v):
    return rounded(M.summary(v), "cable_length")


@query("summary_forest", None, "forest")
def summary_forest(v):
    return rounded(M.summary(v), "cable_length")


ORACLE_SQL["summary_forest"] = ORACLE_SQL["summary"].replace(D.tree_sql("heap"), D.tree_sql("forest"))


@query("nvertices", "SELECT neuron_id, count(*) AS n FROM v GROUP BY neuron_id", "heap")
def nvertices(v):
    return v.groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"))


@query("total_cable", f"WITH {EDGE} SELECT neuron_id, round(sum(len), 4) AS cable FROM e GROUP BY neuron_id", "caterpillar")
def total_cable(v):
    return rounded(T.edges(v).groupBy("neuron_id").agg(F.sum("length").alias("cable")), "cable")


@query("edge_weights", f"WITH {EDGE} SELECT neuron_id, point_no, parent, round(len, 4) AS length FROM e", "ternary")
def edge_weights(v):
    return rounded(T.edges(v).select(*T.KEY, "parent", "length"), "length")


for _name, _flag, _where in (("rootpoints", "is_root", "parent = -1 AND degree > 0"), ("endpoints", "is_end", "degree = 1"), ("branchpoints", "is_branch", "degree > 2")):
    query(_name, f"WITH {NODE} SELECT neuron_id, point_no FROM g WHERE {_where}", "forest")(lambda v, flag=_flag: T.nodes(v).filter(flag).select(*T.KEY))


@query("distance_to_root", f"WITH {EDGE}, {DEPTH} SELECT neuron_id, point_no, root, round(dist, 4) AS dist, depth FROM t", "caterpillar")
def distance_to_root(v):
    return rounded(T.to_root(v).select(*T.KEY, "root", "dist", "depth"), "dist")


@query("segment_graph", f"WITH {SEGMENTS.replace(SEG, SEG + ', ' + DEPTH)} SELECT neuron_id, head, tail, n_points, round(length, 4) AS length FROM sg", "caterpillar")
def segment_graph(v):
    return rounded(T.segment_graph(v), "length").select("neuron_id", "head", "tail", "n_points", "length")


@query("seglengths", f"WITH {SEGMENTS.replace(SEG, SEG + ', ' + DEPTH)} SELECT neuron_id, count(*) AS segments, round(max(length), 4) AS longest, round(sum(length), 4) AS total FROM sg GROUP BY neuron_id", "heap")
def seglengths(v):
    return rounded(M.segment_lengths(v).groupBy("neuron_id").agg(F.count(F.lit(1)).alias("segments"), F.max("length").alias("longest"), F.sum("length").alias("total")), "longest", "total")


@query("segments", f"WITH {EDGE}, {NODE}, {SEG} SELECT neuron_id, cur AS point_no, tail FROM s", "caterpillar")
def segments(v):
    return T.segments(v).select(*T.KEY, "tail")


def strahler_sql(deepest: int = 12) -> str:
    """Orders level by level from the deepest vertices up, for trees of up to so many levels (those of test data have fewer than 8)."""
    step = lambda d: f"o{d} AS (SELECT t.neuron_id, t.point_no, v.parent, CAST(CASE WHEN c.n IS NULL THEN 1 WHEN c.n > 1 AND c.lo = c.hi THEN c.hi + 1 ELSE c.hi END AS BIGINT) AS strahler FROM t JOIN v ON v.neuron_id = t.neuron_id AND v.point_no = t.point_no LEFT JOIN (SELECT neuron_id, parent, count(*) AS n, min(strahler) AS lo, max(strahler) AS hi FROM o{d + 1} GROUP BY ALL) c ON c.neuron_id = t.neuron_id AND c.parent = t.point_no WHERE t.depth = {d})"
    last = f"o{deepest} AS (SELECT t.neuron_id, t.point_no, v.parent, CAST(1 AS BIGINT) AS strahler FROM t JOIN v ON v.neuron_id = t.neuron_id AND v.point_no = t.point_no WHERE t.depth = {deepest})"
    union = " UNION ALL ".join(f"SELECT * FROM o{d}" for d in range(deepest + 1))
    return f"WITH {EDGE}, {DEPTH}, {', '.join([last, *map(step, range(deepest - 1, -1, -1))])}, o AS ({union})"


@query("strahler_order", f"{strahler_sql()} SELECT neuron_id, point_no, strahler FROM o", "ternary")
def strahler_order(v):
    return T.strahler(v)


@query("strahler_heap", f"{strahler_sql()} SELECT neuron_id, point_no, strahler FROM o", "heap")
def strahler_heap(v):
    return T.strahler(v)


@query("prune_strahler", f"{strahler_sql()} SELECT neuron_id, point_no, parent FROM o WHERE strahler <> 1", "ternary")
def prune_strahler(v):
    return E.prune_strahler(v, (1,)).select(*T.KEY, "parent")


@query("distal_to", f"WITH {EDGE}, {ANCESTOR} SELECT neuron_id, point_no FROM a WHERE anc = 5", "caterpillar")
def distal_to(v):
    return E.distal_to(v, at_point(v, 5))


@query("reroot", f"""WITH {EDGE}, {ANCESTOR}, w AS (SELECT neuron_id, anc FROM a WHERE point_no = 13),
 c AS (SELECT v.neuron_id, v.parent AS anc, v.point_no AS below FROM v JOIN w ON w.neuron_id = v.neuron_id AND w.anc = v.point_no)
 SELECT v.neuron_id, v.point_no, CASE WHEN w.anc IS NULL THEN v.parent ELSE coalesce(c.below, -1) END AS parent FROM v LEFT JOIN w ON w.neuron_id = v.neuron_id AND w.anc = v.point_no LEFT JOIN c ON c.neuron_id = v.neuron_id AND c.anc = v.point_no""", "caterpillar")
def reroot(v):
    return E.reroot(v, at_point(v, 13)).select(*T.KEY, "parent")


@query("prune_vertices", "SELECT v.neuron_id, v.point_no, CASE WHEN v.parent % 6 = 0 THEN -1 ELSE v.parent END AS parent FROM v WHERE v.point_no % 6 <> 0", "heap")
def prune_vertices(v):
    return E.prune_vertices(v, v.filter("point_no % 6 = 0")).select(*T.KEY, "parent")


@query("subset_neuron", "WITH k AS (SELECT * FROM v WHERE x > 20 AND y < 80) SELECT k.neuron_id, k.point_no, CASE WHEN p.point_no IS NULL THEN -1 ELSE k.parent END AS parent FROM k LEFT JOIN k p ON p.neuron_id = k.neuron_id AND p.point_no = k.parent", "heap")
def subset_neuron(v):
    return E.subset(v, (F.col("x") > 20) & (F.col("y") < 80)).select(*T.KEY, "parent")


@query("prune_edges", """WITH c AS (SELECT neuron_id, point_no, CASE WHEN point_no % 3 = 0 THEN -1 ELSE parent END AS parent FROM v)
 SELECT neuron_id, point_no, parent FROM c WHERE parent <> -1 OR EXISTS (SELECT 1 FROM c d WHERE d.neuron_id = c.neuron_id AND d.parent = c.point_no)""", "heap")
def prune_edges(v):
    return E.prune_edges(v, v.filter("point_no % 3 = 0 AND parent <> -1").select("neuron_id", F.col("parent").alias("a"), F.col("point_no").alias("b"))).select(*T.KEY, "parent")


@query("prune_twigs", f"""WITH {EDGE}, {NODE}, {ANCESTOR}, leaf AS (SELECT neuron_id, point_no FROM g WHERE n_children = 0 AND parent <> -1),
 hit AS (SELECT a.neuron_id, a.point_no AS leaf, max_by(a.anc, a.up) AS bp FROM a JOIN leaf l ON l.neuron_id = a.neuron_id AND l.point_no = a.point_no JOIN g ON g.neuron_id = a.neuron_id AND g.point_no = a.anc WHERE g.degree > 2 AND a.up <= 60 AND a.anc <> a.point_no GROUP BY ALL),
 target AS (SELECT neuron_id, bp AS p FROM hit UNION SELECT l.neuron_id, l.point_no FROM leaf l WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.neuron_id = l.neuron_id AND h.leaf = l.point_no) UNION SELECT neuron_id, point_no FROM v WHERE parent = -1)
 SELECT DISTINCT a.neuron_id, a.anc AS point_no FROM a JOIN target t ON t.neuron_id = a.neuron_id AND t.p = a.point_no""", "caterpillar")
def prune_twigs(v):
    return E.prune_twigs(v, 60.0).select(*T.KEY)


@query("spine_length", f"""WITH {EDGE}, {NODE}, {DEPTH}, {ANCESTOR}, ends AS (SELECT g.neuron_id, g.point_no, t.dist FROM g JOIN t ON t.neuron_id = g.neuron_id AND t.point_no = g.point_no WHERE g.degree = 1),
 ea AS (SELECT a.neuron_id, a.point_no, a.anc, ends.dist, t.dist AS at FROM a JOIN ends ON ends.neuron_id = a.neuron_id AND ends.point_no = a.point_no JOIN t ON t.neuron_id = a.neuron_id AND t.point_no = a.anc),
 p AS (SELECT l.neuron_id, l.point_no AS a, r.point_no AS b, min(l.dist + r.dist - 2 * l.at) AS d FROM ea l JOIN ea r ON l.neuron_id = r.neuron_id AND l.anc = r.anc AND l.point_no < r.point_no GROUP BY ALL)
 SELECT neuron_id, round(max(d), 4) AS spine_length FROM p GROUP BY neuron_id""", "caterpillar")
def spine_length(v):
    return rounded(M.spine_length(v), "spine_length")


@query("simplify_neuron", None, "heap")
def simplify_neuron(v):
    return E.simplify(v, 2).select(*T.KEY, "parent")


@query("stitch_pairs", f"""WITH {NODE}, ends AS (SELECT * FROM g WHERE degree = 1), m AS (SELECT a.neuron_id // 2 AS pair, a.point_no AS a_point, b.point_no AS b_point,
 sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS gap FROM ends a JOIN ends b ON a.neuron_id % 2 = 0 AND b.neuron_id = a.neuron_id + 1)
 SELECT pair, round(min(gap), 4) AS gap FROM m GROUP BY pair""", "heap")
def stitch_pairs(v):
    side = lambda k: v.filter(F.col("neuron_id") % 2 == k).withColumn("pair", F.floor(F.col("neuron_id") / 2)).drop("neuron_id")
    return rounded(E.stitch_pairs(side(0), side(1)), "gap").select("pair", "gap")


@query("reroot_nearest", f"""WITH {EDGE}, {ANCESTOR}, near AS (SELECT neuron_id, arg_min(point_no, (((x - 50) * (x - 50) + (y - 50) * (y - 50) + (z - 12) * (z - 12)), point_no)) AS point_no FROM v GROUP BY neuron_id),
 w AS (SELECT a.neuron_id, a.anc FROM a JOIN near n ON n.neuron_id = a.neuron_id AND n.point_no = a.point_no),
 c AS (SELECT v.neuron_id, v.parent AS anc, v.point_no AS below FROM v JOIN w ON w.neuron_id = v.neuron_id AND w.anc = v.point_no)
 SELECT v.neuron_id, v.point_no, CASE WHEN w.anc IS NULL THEN v.parent ELSE coalesce(c.below, -1) END AS parent FROM v LEFT JOIN w ON w.neuron_id = v.neuron_id AND w.anc = v.point_no LEFT JOIN c ON c.neuron_id = v.neuron_id AND c.anc = v.point_no""", "caterpillar")
def reroot_nearest(v):
    return E.reroot_nearest(v, 50.0, 50.0, 12.0).select(*T.KEY, "parent")


@query("stitch_neuron", None, "heap")
def stitch_neuron(v):
    side = lambda k: v.filter(F.col("neuron_id") % 2 == k).withColumn("pair", F.floor(F.col("neuron_id") / 2)).drop("neuron_id")
    return H.stitch_pair(side(0), side(1)).select(*T.KEY, "parent")


@query("stitch_mst", None, "forest")
def stitch_mst(v):
    return H.stitch(v)[0].select(*T.KEY, "parent")


# Coordinates.
@query("replace_xyz", "SELECT neuron_id, point_no, y AS x, x AS y, z + 1 AS z FROM v", "heap")
def replace_xyz(v):
    return G.replace_xyz(v, v.select(*T.KEY, F.col("y").alias("x"), F.col("x").alias("y"), (F.col("z") + 1).alias("z")), T.KEY).select(*T.KEY, *G.AXES)


@query("power", "SELECT neuron_id, point_no, round(y ** 2, 4) AS y, round(z ** 3, 4) AS z FROM v", "heap")
def power(v):
    return rounded(G.arithmetic(v, "^", (1.0, 2.0, 3.0)).select(*T.KEY, "y", "z"), "y", "z")


@query("compare", "SELECT neuron_id, point_no, x > 20 AS x, y > 30 AS y, z > 5 AS z FROM v", "heap")
def compare(v):
    return G.arithmetic(v, ">", (20.0, 30.0, 5.0)).select(*T.KEY, *G.AXES)


@query("bounding_box", "SELECT neuron_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM v GROUP BY neuron_id", "heap")
def bounding_box(v):
    return G.bounding_box(v, "neuron_id")


@query("arithmetic", "SELECT neuron_id, point_no, round(x * 2.0::DOUBLE, 4) AS x, round(y * 3.0::DOUBLE, 4) AS y, round(z * 0.5::DOUBLE, 4) AS z FROM v", "heap")
def arithmetic(v):
    return rounded(G.arithmetic(v, "*", (2.0, 3.0, 0.5)).select(*T.KEY, *G.AXES), *G.AXES)


@query("scale", "SELECT neuron_id, point_no, round((x - avg(x) OVER p) / stddev_samp(x) OVER p, 3) + 0.0 AS x FROM v WINDOW p AS (PARTITION BY neuron_id)", "heap")
def scale(v):
    return rounded(G.scale(v, "neuron_id").select(*T.KEY, "x"), "x", digits=3)


@query("xyz_to_string", "SELECT neuron_id, point_no, printf('%.2f', x) || ',' || printf('%.2f', y) || ',' || printf('%.2f', z) AS xyz FROM v", "heap")
def xyz_to_string(v):
    return v.select(*T.KEY, X.xyz_text(F.col("x"), F.col("y"), F.col("z")).alias("xyz"))


@query("xyz_from_string", "SELECT neuron_id, point_no, y, z FROM v", "heap")
def xyz_from_string(v):
    text = F.concat(F.lit("("), F.col("x"), F.lit(", "), F.col("y"), F.lit(" ; "), F.col("z"), F.lit(")"))
    return v.select(*T.KEY, X.xyz_of(text).alias("p")).select(*T.KEY, "p.y", "p.z")


MATRIX = np.array([[0.5, 0.1, 0.0, 10.0], [0.0, 2.0, 0.3, -5.0], [0.2, 0.0, 1.0, 1.0], [0.0, 0.0, 0.0, 1.0]])


@query("affine", "SELECT neuron_id, point_no, round(x * 0.5::DOUBLE + y * 0.1::DOUBLE + 10, 4) AS x, round(y * 2 + z * 0.3::DOUBLE - 5, 4) AS y, round(x * 0.2::DOUBLE + z + 1, 4) AS z FROM v", "heap")
def affine(v):
    return rounded(G.affine(v, MATRIX).select(*T.KEY, *G.AXES), *G.AXES)


@query("registration_chain", "SELECT neuron_id, point_no, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM v", "heap")
def registration_chain(v):
    chain = [(MATRIX, False), (MATRIX, True)]
    return rounded(G.affine(v, G.folded(chain)).select(*T.KEY, *G.AXES), *G.AXES, digits=3)


@query("mirror", "SELECT neuron_id, point_no, round(100 - x, 4) AS x FROM v", "heap")
def mirror(v):
    return rounded(G.mirror(v, "x", 100.0).select(*T.KEY, "x"), "x")


PLANE = G.plane_coefficients((50.0, 50.0, 12.0), (1.0, 0.5, 0.25))
CROSS = f"{EDGE}, h AS (SELECT *, px + py * 0.5 + pz * 0.25 - 78 AS f0, x + y * 0.5 + z * 0.25 - 78 AS f1 FROM e), i AS (SELECT *, -f0 / (f1 - f0) AS u FROM h WHERE f1 <> f0), q AS (SELECT neuron_id, point_no, px + u * (x - px) AS x, py + u * (y - py) AS y, pz + u * (z - pz) AS z FROM i WHERE u BETWEEN 0 AND 1)"


@query("plane_crossings", f"WITH {CROSS} SELECT neuron_id, point_no, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM q", "heap")
def plane_crossings(v):
    return rounded(G.plane_crossings(v, PLANE), *G.AXES)


@query("nearest_crossing", f"WITH {CROSS} SELECT neuron_id, min_by(point_no, (x - 50) * (x - 50) + (y - 50) * (y - 50) + (z - 12) * (z - 12)) AS point_no FROM q GROUP BY neuron_id", "heap")
def nearest_crossing(v):
    return G.nearest_crossing(G.plane_crossings(v, PLANE), (50.0, 50.0, 12.0)).select(*T.KEY)


@query("resample", None, "caterpillar")
def resample(v):
    return rounded(G.resample(v, 10.0), *G.AXES)


ALONG = f"{SEGMENTS.replace(SEG, SEG + ', ' + DEPTH)}, r AS (SELECT s.neuron_id, s.tail, s.cur AS point_no, t.dist - h.dist AS pos FROM s JOIN sg ON sg.neuron_id = s.neuron_id AND sg.tail = s.tail JOIN t ON t.neuron_id = s.neuron_id AND t.point_no = s.cur JOIN t h ON h.neuron_id = s.neuron_id AND h.point_no = sg.head UNION ALL SELECT neuron_id, tail, head, 0.0::DOUBLE FROM sg), w AS (SELECT r.*, v.x, v.y, v.z, max(pos) OVER (PARTITION BY r.neuron_id, tail) AS total FROM r JOIN v ON v.neuron_id = r.neuron_id AND v.point_no = r.point_no)"


#: Of each segment what stays, and new points every 10 of its length.
ORACLE_SQL["resample"] = f"""WITH RECURSIVE v AS ({D.tree_sql('caterpillar')}), {ALONG}, m AS (SELECT *, row_number() OVER r AS nth, lead(pos) OVER r AS p2, lead(x) OVER r AS x2, lead(y) OVER r AS y2, lead(z) OVER r AS z2 FROM w WINDOW r AS (PARTITION BY neuron_id, tail ORDER BY pos, point_no)),
 k AS (SELECT *, unnest(range(CAST(floor(pos / 10) AS BIGINT) + 1, CASE WHEN p2 = total THEN CAST(ceil(p2 / 10) AS BIGINT) ELSE CAST(floor(p2 / 10) AS BIGINT) + 1 END)) AS k FROM m WHERE total > 10 AND p2 IS NOT NULL),
 n AS (SELECT neuron_id, tail, pos AS at_, x, y, z FROM m WHERE total <= 10 OR nth = 1 OR p2 IS NULL UNION ALL SELECT neuron_id, tail, k * 10.0::DOUBLE, x + (k * 10.0::DOUBLE - pos) / (p2 - pos) * (x2 - x), y + (k * 10.0::DOUBLE - pos) / (p2 - pos) * (y2 - y), z + (k * 10.0::DOUBLE - pos) / (p2 - pos) * (z2 - z) FROM k)
 SELECT neuron_id, tail, row_number() OVER (PARTITION BY neuron_id, tail ORDER BY at_) AS pos, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM n"""


@query("smooth_gauss", f"""WITH {ALONG}, m AS (SELECT a.neuron_id, a.tail, a.point_no, any_value(a.pos) AS pos, any_value(a.total) AS total, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.z) AS z, sum(exp(-(a.pos - b.pos) * (a.pos - b.pos) / 800)) AS k,
 sum(exp(-(a.pos - b.pos) * (a.pos - b.pos) / 800) * b.x) AS mx, sum(exp(-(a.pos - b.pos) * (a.pos - b.pos) / 800) * b.y) AS my, sum(exp(-(a.pos - b.pos) * (a.pos - b.pos) / 800) * b.z) AS mz FROM w a JOIN w b ON b.neuron_id = a.neuron_id AND b.tail = a.tail GROUP BY a.neuron_id, a.tail, a.point_no)
 SELECT neuron_id, tail, point_no, round(CASE WHEN pos > 0 AND pos < total THEN mx / k ELSE x END, 4) + 0.0 AS x, round(CASE WHEN pos > 0 AND pos < total THEN my / k ELSE y END, 4) + 0.0 AS y, round(CASE WHEN pos > 0 AND pos < total THEN mz / k ELSE z END, 4) + 0.0 AS z FROM m""", "caterpillar")
def smooth_gauss(v):
    return rounded(G.smooth(v, 20.0), *G.AXES)


@query("dotprops", None, "heap")
def dotprops(v):
    return rounded(G.tangents(v, "point_no", "neuron_id", 5).select(*T.KEY, "alpha"), "alpha")


@query("knn", """WITH p AS (SELECT a.neuron_id, a.point_no, b.point_no AS neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM v a JOIN v b ON a.neuron_id = b.neuron_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY neuron_id, point_no ORDER BY d2, neighbour) AS rank FROM p) SELECT neuron_id, point_no, neighbour, rank, round(d2, 4) AS d2 FROM r WHERE rank <= 5""", "heap")
def knn(v):
    return rounded(S.neighbours(v, "point_no", "neuron_id", 5), "d2")


@query("prune_by_distance", """SELECT a.neuron_id, a.point_no FROM v a WHERE a.point_no % 2 = 0 AND (SELECT min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) FROM v b WHERE b.neuron_id = a.neuron_id AND b.point_no % 2 = 1) <= 400""", "heap")
def prune_by_distance(v):
    return S.nearest(v.filter("point_no % 2 = 0"), v.filter("point_no % 2 = 1"), "point_no", "neuron_id").filter("d2 <= 400").select(*T.KEY)


@query("thin_plate", None, "heap")
def thin_plate(v):
    corners = np.array([[0, 0, 0], [100, 0, 0], [0, 100, 0], [0, 0, 24], [100, 100, 24], [50, 50, 12]], float)
    moved = corners + np.array([[1, 0, 0], [0, 2, 0], [0, 0, 1], [3, 0, 0], [0, 0, 0], [2, 2, 2]], float)
    return rounded(G.thin_plate(v, corners, moved).select(*T.KEY, *G.AXES), *G.AXES)


@query("sholl", f"""WITH {EDGE}, {NODE}, {SEG}, {DEPTH}, c AS (SELECT neuron_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v GROUP BY neuron_id),
 d AS (SELECT v.neuron_id, v.point_no, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS r FROM v JOIN c ON c.neuron_id = v.neuron_id),
 f AS (SELECT s.neuron_id, s.tail, t.depth, k.radius FROM s JOIN t ON t.neuron_id = s.neuron_id AND t.point_no = s.cur JOIN d a ON a.neuron_id = s.neuron_id AND a.point_no = s.cur JOIN d b ON b.neuron_id = s.neuron_id AND b.point_no = s.nxt JOIN (SELECT 10.0::DOUBLE * i AS radius FROM range(1, 11) r(i)) k ON k.radius > least(a.r, b.r) AND k.radius <= greatest(a.r, b.r)),
 o AS (SELECT *, depth - row_number() OVER (PARTITION BY neuron_id, tail, radius ORDER BY depth) AS island FROM f), m AS (SELECT neuron_id, radius, count(*) AS m FROM o GROUP BY neuron_id, tail, radius, island)
 SELECT neuron_id, radius, CAST(sum(ceil(m / 2.0)) AS BIGINT) AS crossings FROM m GROUP BY ALL""", "caterpillar")
def sholl(v):
    return M.sholl(v, 10.0, 100.0)


@query("sholl_whole", None, "caterpillar")
def sholl_whole(v):
    return M.sholl(v, 10.0, 1000.0)


#: The same up to the reference's default end.
ORACLE_SQL["sholl_whole"] = ORACLE_SQL["sholl"].replace("range(1, 11)", "range(1, 101)")


#: All trees are dealt to two collections by parity.
PAIR = "a.neuron_id % 2 = 0 AND b.neuron_id % 2 = 1"
OVERLAP = f"SELECT a.neuron_id AS out_id, b.neuron_id AS in_id, round(sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 2.0)), 4) AS score FROM v a, v b WHERE {PAIR} GROUP BY ALL"


def halves(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    return v.filter("pmod(neuron_id, 2) = 0"), v.filter("pmod(neuron_id, 2) = 1")


@query("overlap_score", OVERLAP, "heap")
def overlap_score(v):
    return M.overlap_score(*halves(v), digits=4)


@query("overlap_score_whole", OVERLAP, "heap")
def overlap_score_whole(v):
    return M.overlap_score(*halves(v), digits=4)


CLAMP = "greatest(0, least(1, {}))".format
CONTACT = f"""WITH {EDGE}, p AS (SELECT a.neuron_id AS a_id, b.neuron_id AS b_id, a.x - a.px AS ux, a.y - a.py AS uy, a.z - a.pz AS uz, b.x - b.px AS vx, b.y - b.py AS vy, b.z - b.pz AS vz, a.px - b.px AS wx, a.py - b.py AS wy, a.pz - b.pz AS wz
 FROM e a JOIN e b ON {PAIR} AND abs(a.px - b.px) <= 9 AND abs(a.py - b.py) <= 9 AND abs(a.pz - b.pz) <= 9),
 q AS (SELECT *, ux * ux + uy * uy + uz * uz AS a, ux * vx + uy * vy + uz * vz AS b, vx * vx + vy * vy + vz * vz AS c, ux * wx + uy * wy + uz * wz AS d, vx * wx + vy * wy + vz * wz AS e0 FROM p),
 s AS (SELECT *, CASE WHEN a * c - b * b < 1e-6 THEN 0 ELSE {CLAMP("(b * e0 - c * d) / (a * c - b * b)")} END AS sc FROM q),
 t AS (SELECT *, CASE WHEN c = 0 THEN 0 ELSE (b * sc + e0) / c END AS raw FROM s),
 k AS (SELECT *, {CLAMP("raw")} AS tc, CASE WHEN raw < 0 THEN CASE WHEN a = 0 THEN 0 ELSE {CLAMP("-d / a")} END WHEN raw > 1 THEN CASE WHEN a = 0 THEN 0 ELSE {CLAMP("(b - d) / a")} END ELSE sc END AS s2 FROM t),
 g AS (SELECT a_id, b_id, sqrt((wx + s2 * ux - tc * vx) ** 2 + (wy + s2 * uy - tc * vy) ** 2 + (wz + s2 * uz - tc * vz) ** 2) AS gap FROM k)
 SELECT a_id, b_id, count(*) AS n FROM g WHERE gap <= 4 GROUP BY ALL"""


@query("potential_synapses", CONTACT, "heap")
def potential_synapses(v):
    return M.potential_synapses(*halves(v), 4.0)


@query("expected_synapses", f"""WITH {EDGE}, m AS (SELECT neuron_id, len, x - px AS dx, y - py AS dy, z - pz AS dz, (x + px) / 2 AS mx, (y + py) / 2 AS my, (z + pz) / 2 AS mz FROM e WHERE len > 0),
 p AS (SELECT a.neuron_id AS a_id, b.neuron_id AS b_id, a.len * b.len AS ll, greatest(-1, least(1, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (a.len * b.len))) AS cosine, (a.mx - b.mx) ** 2 + (a.my - b.my) ** 2 + (a.mz - b.mz) ** 2 AS d2 FROM m a JOIN m b ON {PAIR})
 SELECT a_id, b_id, round(4 * sum(ll * sqrt(1 - cosine * cosine) * exp(-d2 / 16) / (16 * pi()) ** 1.5), 4) AS expected FROM p GROUP BY ALL""", "heap")
def expected_synapses(v):
    return M.expected_synapses(*halves(v), 2.0, 2.0, digits=4)


# Collections.
def with_metadata(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(D.trees(spark, sf_dir), D.metadata(spark, sf_dir))
        v, m = D.tree_sql("heap"), D.METADATA.format(customer="customer", nation="nation")
        ORACLE_SQL[name] = f"WITH v AS ({v}), m AS ({m}) {sql}"
        return f

    return add


@with_metadata("collection_subset", "SELECT v.neuron_id, count(*) AS n FROM v JOIN m ON m.neuron_id = v.neuron_id WHERE m.c_acctbal > 3000 GROUP BY v.neuron_id")
def collection_subset(v, m):
    return C.subset(v, m, F.col("c_acctbal") > 3000).groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"))


@with_metadata("collection_union", "SELECT neuron_id, c_name FROM m WHERE neuron_id % 3 = 0 OR neuron_id % 2 = 0")
def collection_union(v, m):
    return C.union(m.filter("neuron_id % 3 = 0"), m.filter("neuron_id % 2 = 0")).select("neuron_id", "c_name")


@with_metadata("collection_intersect", "SELECT neuron_id, c_name FROM m WHERE neuron_id % 6 = 0")
def collection_intersect(v, m):
    return C.intersect(m.filter("neuron_id % 3 = 0"), m.filter("neuron_id % 2 = 0")).select("neuron_id", "c_name")


@with_metadata("collection_setdiff", "SELECT neuron_id, c_name FROM m WHERE neuron_id % 3 = 0 AND neuron_id % 2 <> 0")
def collection_setdiff(v, m):
    return C.setdiff(m.filter("neuron_id % 3 = 0"), m.filter("neuron_id % 2 = 0")).select("neuron_id", "c_name")


@with_metadata("collection_concat", "SELECT neuron_id, c_name, CASE WHEN neuron_id % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM m")
def collection_concat(v, m):
    return C.concat(m.filter("neuron_id % 2 = 0").select("neuron_id", "c_name", "c_mktsegment"), m.filter("neuron_id % 2 = 1").select("neuron_id", "c_name"))


@with_metadata("metadata_expression", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM m GROUP BY c_mktsegment")
def metadata_expression(v, m):
    return rounded(m.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")), "mean")


@with_metadata("metadata_head", "SELECT neuron_id, c_name FROM m ORDER BY neuron_id LIMIT 6")
def metadata_head(v, m):
    return m.orderBy("neuron_id").limit(6).select("neuron_id", "c_name")


@with_metadata("metadata_tail", "SELECT neuron_id, c_name FROM m ORDER BY neuron_id DESC LIMIT 6")
def metadata_tail(v, m):
    return m.orderBy(F.desc("neuron_id")).limit(6).select("neuron_id", "c_name")


@with_metadata("summary_with_metadata", f", {EDGE} SELECT m.neuron_id, m.n_name, round(sum(e.len), 4) AS cable FROM e JOIN m ON m.neuron_id = e.neuron_id GROUP BY ALL")
def summary_with_metadata(v, m):
    cable = T.edges(v).groupBy("neuron_id").agg(F.sum("length").alias("cable"))
    return rounded(cable.join(m.select("neuron_id", "n_name"), "neuron_id"), "cable").select("neuron_id", "n_name", "cable")


@query("apply_dropping_failures", "SELECT neuron_id, round(avg(x), 4) AS value FROM v GROUP BY neuron_id HAVING count(*) >= 65", "heap")
def apply_dropping_failures(v):
    return rounded(C.apply(v, F.avg("x"), F.count(F.lit(1)) < 65, True), "value")


@query("apply_keeping_failures", "SELECT neuron_id, CASE WHEN count(*) >= 65 THEN round(avg(x), 4) END AS value, CASE WHEN count(*) < 65 THEN 'failed' END AS error FROM v GROUP BY neuron_id", "heap")
def apply_keeping_failures(v):
    return rounded(C.apply(v, F.avg("x"), F.count(F.lit(1)) < 65, False), "value")


@query("collection_assign", "SELECT neuron_id, CAST(sum(CASE WHEN neuron_id % 2 = 0 THEN 1 ELSE point_no END) AS BIGINT) AS total FROM v WHERE neuron_id % 3 <> 0 OR neuron_id % 2 = 0 GROUP BY neuron_id", "heap")
def collection_assign(v):
    new = v.filter("neuron_id % 2 = 0").withColumn("point_no", F.lit(1).cast("long"))
    return C.assign(v.filter("neuron_id % 3 <> 0"), new).groupBy("neuron_id").agg(F.sum("point_no").alias("total"))


@with_metadata("metadata_assign", "SELECT neuron_id, CASE WHEN neuron_id % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM m")
def metadata_assign(v, m):
    return C.assign_field(m, "c_mktsegment", m.filter("neuron_id % 3 = 0").select("neuron_id", F.lit("new").alias("value"))).select("neuron_id", "c_mktsegment")


@query("collection_filter", "SELECT neuron_id, count(*) AS n FROM v GROUP BY neuron_id HAVING max(x) > 40 AND count(*) > 60", "heap")
def collection_filter(v):
    return C.subset_by(v, (F.max("x") > 40) & (F.count(F.lit(1)) > 60)).groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"))


@query("apply_pairs", "SELECT neuron_id, round(max(x) - min(y), 4) AS value FROM v WHERE neuron_id % 3 = 0 GROUP BY neuron_id", "heap")
def apply_pairs(v):
    return rounded(C.apply_pairs(v, v.filter("neuron_id % 3 = 0"), F.max("x"), F.min("y"), lambda a, b: a - b), "value")


@query("all_equal", "SELECT DISTINCT neuron_id FROM v WHERE neuron_id % 4 = 1 AND point_no = 3", "heap")
def all_equal(v):
    other = v.withColumn("x", F.when((F.col("neuron_id") % 4 == 1) & (F.col("point_no") == 3), F.col("x") + 1).otherwise(F.col("x")))
    return C.differing(v, other, ["x", "y", "z"])


@with_metadata("droplevels", "SELECT DISTINCT c_mktsegment AS value FROM m WHERE c_acctbal > 9000")
def droplevels(v, m):
    return C.unused_levels(m.filter("c_acctbal > 9000"), m.select(F.col("c_mktsegment").alias("value")).distinct(), "c_mktsegment")


LINE = "sha256(point_no::VARCHAR || ',' || printf('%.4f', x) || ',' || printf('%.4f', y))"


@query("digest", f"SELECT neuron_id, sha256(string_agg({LINE}, '' ORDER BY point_no)) AS digest FROM v GROUP BY neuron_id", "heap")
def digest(v):
    return C.digest(v, ["x", "y"])


@query("incremental_load", "SELECT DISTINCT neuron_id FROM v WHERE point_no = 3 AND neuron_id % 4 = 1 AND x <> 0", "heap")
def incremental_load(v):
    old = v.withColumn("x", F.when((F.col("point_no") == 3) & (F.col("neuron_id") % 4 == 1), 0.0).otherwise(F.col("x")))
    return C.changed(C.digest(v, ["x"]), C.digest(old, ["x"])).select("neuron_id")


@query("find_neuron", "SELECT neuron_id, count(*) FILTER (x < 30 AND y > 60) AS n FROM v GROUP BY neuron_id HAVING count(*) FILTER (x < 30 AND y > 60) > 3", "heap")
def find_neuron(v):
    return C.find(v, (F.col("x") < 30) & (F.col("y") > 60), 3)


@query("find_soma", "SELECT neuron_id, CAST(1 AS BIGINT) AS n FROM v WHERE parent = -1 AND x < 30", "heap")
def find_soma(v):
    return C.find(v, (F.col("parent") == -1) & (F.col("x") < 30))


# Images.
def on_grids(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(D.grids(spark, sf_dir))
        ORACLE_SQL[name] = f"WITH g AS ({D.GRID.format(cloud=D.CLOUD.format(lineitem='lineitem'))}) {sql}"
        return f

    return add


QUERIES["point_histogram"] = lambda spark, sf_dir: I.histogram(D.clouds(spark, sf_dir), "image_id", D.GRID_ORIGIN, D.GRID_SIZE, D.GRID_DIMS)
ORACLE_SQL["point_histogram"] = f"WITH c AS ({D.CLOUD.format(lineitem='lineitem')}), h AS (SELECT image_id, ceil((x - 0.5) / 5)::BIGINT AS i, ceil((y + 0.5) / 2)::BIGINT AS j, ceil((z + 0.5) / 3)::BIGINT AS k FROM c) SELECT image_id, i, j, k, count(*) AS n FROM h WHERE i BETWEEN 1 AND 10 AND j BETWEEN 1 AND 6 AND k BETWEEN 1 AND 3 GROUP BY ALL"
QUERIES["coord2ind"] = lambda spark, sf_dir: I.to_index(D.clouds(spark, sf_dir), D.GRID_ORIGIN, D.GRID_SIZE, D.GRID_DIMS, clamp=True).groupBy("image_id").agg(F.sum("index").alias("total"))
ORACLE_SQL["coord2ind"] = f"WITH c AS ({D.CLOUD.format(lineitem='lineitem')}), h AS (SELECT image_id, least(10, greatest(1, round_even((x - 3) / 5, 0) + 1)) AS i, least(6, greatest(1, round_even((y - 0.5) / 2, 0) + 1)) AS j, least(3, greatest(1, round_even((z - 1) / 3, 0) + 1)) AS k FROM c) SELECT image_id, CAST(sum(i + (j - 1) * 10 + (k - 1) * 60) AS BIGINT) AS total FROM h GROUP BY image_id"


@on_grids("ind2coord", "SELECT image_id, i + (j - 1) * 10 + (k - 1) * 60 AS idx, 3.0::DOUBLE + (i - 1) * 5 AS x, 0.5::DOUBLE + (j - 1) * 2 AS y, 1.0::DOUBLE + (k - 1) * 3 AS z FROM g")
def ind2coord(g):
    indexed = g.select("image_id", I.linear_index(D.GRID_DIMS).alias("idx"))
    return I.centres(indexed.withColumns(I.from_linear(F.col("idx"), D.GRID_DIMS)), D.GRID_ORIGIN, D.GRID_SIZE).select("image_id", "idx", "x", "y", "z")


for _how, _sql in (("sum", "CAST(sum(value) AS BIGINT)"), ("mean", "round(avg(value), 4)"), ("max", "max(value)"), ("integrate", "round(sum(value)::DOUBLE * 3.0, 4)")):
    on_grids(f"projection_{_how}", f"SELECT image_id, i, j, {_sql} AS value FROM g GROUP BY image_id, i, j")(
        lambda g, how=_how: I.projection(g, "image_id", "k", how, 3.0) if how in ("sum", "max") else rounded(I.projection(g, "image_id", "k", how, 3.0), "value")
    )


@on_grids("imslice", "SELECT image_id, i, j, k, value FROM g WHERE k IN (1, 3)")
def imslice(g):
    return I.sliced(g, "k", (1, 3))


@on_grids("flip", "SELECT image_id, 11 - i AS i, j, k, value FROM g")
def flip(g):
    return I.flipped(g, "i", 10)


@on_grids("threshold", "SELECT image_id, i, j, k, CASE WHEN value > 2 THEN 1 ELSE 0 END AS value FROM g")
def threshold(g):
    return I.threshold(g, 2)


@on_grids("mask", "SELECT image_id, i, j, k, CASE WHEN (i + j) % 2 = 0 THEN value ELSE 0 END AS value FROM g")
def mask(g):
    return I.masked(g, g.withColumn("value", ((F.col("i") + F.col("j")) % 2 == 0).cast("int")), "image_id")


@on_grids("unmask", "SELECT image_id, i, j, k, CASE WHEN i % 2 = 0 THEN row_number() OVER (PARTITION BY image_id, i % 2 = 0 ORDER BY i + (j - 1) * 10 + (k - 1) * 60) * 10 END AS value FROM g")
def unmask(g):
    on = g.withColumn("value", (F.col("i") % 2 == 0).cast("int"))
    values = g.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(1), F.lit(180))).alias("pos")).select("image_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") * 10).cast("long").alias("value"))
    return I.unmasked(values, on, "image_id", D.GRID_DIMS)


@on_grids("clampmax", "SELECT image_id, greatest(2, least(4, max(value)))::DOUBLE AS top FROM g GROUP BY image_id")
def clampmax(g):
    return g.groupBy("image_id").agg(I.clamped_max(F.col("value"), 2, 4).alias("top"))


@on_grids("label_statistics", "SELECT image_id, j % 3 AS label, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM g WHERE j % 3 <> 0 GROUP BY ALL")
def label_statistics(g):
    return rounded(I.label_statistics(g, g.withColumn("value", F.col("j") % 3), "image_id"), "mean")


@on_grids("materials", "SELECT k AS id, 'layer ' || k AS name, k AS level, count(*) AS n FROM g GROUP BY k")
def materials(g):
    names = g.select(F.col("k").alias("id"), F.concat(F.lit("layer "), F.col("k")).alias("name"), F.col("k").alias("level")).distinct()
    return I.material_table(g.withColumn("value", F.col("k")), names)


@on_grids("mask_by_name", "SELECT image_id, i, j, k, CASE WHEN k = 2 THEN value ELSE 0 END AS value FROM g")
def mask_by_name(g):
    names = g.select(F.col("k").alias("level"), F.concat(F.lit("layer "), F.col("k")).alias("name")).distinct()
    return I.masked_by_name(g, g.withColumn("value", F.col("k")), "image_id", names, ["layer 2"])


@on_grids("empty_cells", "SELECT image_id, 180 - count(*) AS n FROM g GROUP BY image_id")
def empty_cells(g):
    return I.empty_cells(g, "image_id", D.GRID_DIMS)


# Surfaces.
def on_meshes(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*D.meshes(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[name] = f"WITH mv AS ({D.MESH_VERTEX.format(nation='nation')}), mf AS ({D.MESH_FACE.format(nation='nation')}) {sql}"
        return f

    return add


CORNER = "c AS (SELECT f.mesh_id, f.region, f.face, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, d.x AS cx, d.y AS cy, d.z AS cz FROM mf f JOIN mv a ON a.mesh_id = f.mesh_id AND a.vertex = f.v1 JOIN mv b ON b.mesh_id = f.mesh_id AND b.vertex = f.v2 JOIN mv d ON d.mesh_id = f.mesh_id AND d.vertex = f.v3), n AS (SELECT *, (ay - cy) * (bz - az) - (az - cz) * (by_ - ay) AS nx, (az - cz) * (bx - ax) - (ax - cx) * (bz - az) AS ny, (ax - cx) * (by_ - ay) - (ay - cy) * (bx - ax) AS nz FROM c)"


@on_meshes("face_normals", f", {CORNER} SELECT mesh_id, region, face, nx, ny, nz, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 4) AS area FROM n")
def face_normals(faces, vertices, spark, sf_dir):
    return rounded(U.normals(faces, vertices), "area")


@on_meshes("mesh_summary", f", {CORNER} SELECT mesh_id, CAST(4 AS BIGINT) AS vertices, count(*) AS faces, 3 * count(*) AS edges, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 4) AS area FROM n GROUP BY mesh_id")
def mesh_summary(faces, vertices, spark, sf_dir):
    return rounded(U.summary(faces, vertices), "area")


@on_meshes("mesh_regions", "SELECT mesh_id, face, region FROM mf WHERE regexp_matches(region, '^in')")
def mesh_regions(faces, vertices, spark, sf_dir):
    return U.regions(faces, "^in").select("mesh_id", "face", "region")


#: Tetrahedra as rows, and whether a point p lies in one or on it: on the side of each face where the fourth corner is.
TETRA = "h AS (SELECT mesh_id, " + ", ".join(f"max(CASE WHEN vertex = {k} THEN {c} END) AS {c}{k}" for k in range(1, 5) for c in "xyz") + " FROM mv GROUP BY mesh_id)"


def side_sql(a: int, b: int, c: int, d: str) -> str:
    e = lambda q, k: f"({k}{q} - {k}{a})"
    n = [f"({e(b, p)} * {e(c, q)} - {e(b, q)} * {e(c, p)})" for p, q in ("yz", "zx", "xy")]
    return " + ".join(f"{m} * ({k}{d} - {k}{a})" for m, k in zip(n, "xyz", strict=True))


WITHIN = " AND ".join(f"({side_sql(a, b, c, '')}) * ({side_sql(a, b, c, str(d))}) >= 0" for a, b, c, d in ((1, 2, 3, 4), (1, 2, 4, 3), (1, 3, 4, 2), (2, 3, 4, 1)))


@on_meshes("points_inside", f", {TETRA}, c AS ({D.CLOUD.format(lineitem='lineitem')}), p AS (SELECT image_id % 25 AS mesh_id, image_id * 1000000 + point AS point, x, y, z FROM c) SELECT p.mesh_id, p.point, {WITHIN} AS inside FROM p JOIN h ON h.mesh_id = p.mesh_id")
def points_inside(faces, vertices, spark, sf_dir):
    points = D.clouds(spark, sf_dir).select((F.col("image_id") % 25).alias("mesh_id"), (F.col("image_id") * 1_000_000 + F.col("point")).alias("point"), "x", "y", "z")
    return U.points_inside(points, faces, vertices).select("mesh_id", "point", "inside")


@on_meshes("prune_in_volume", f", {TETRA}, v AS ({D.tree_sql('heap')}), k AS (SELECT v.neuron_id, v.point_no, v.parent FROM (SELECT *, neuron_id % 25 AS mesh FROM v) v JOIN h ON h.mesh_id = v.mesh WHERE {WITHIN}) SELECT k.neuron_id, k.point_no, CASE WHEN p.point_no IS NULL THEN -1 ELSE k.parent END AS parent FROM k LEFT JOIN k p ON p.neuron_id = k.neuron_id AND p.point_no = k.parent")
def prune_in_volume(faces, vertices, spark, sf_dir):
    v = D.trees(spark, sf_dir).withColumn("mesh_id", F.col("neuron_id") % 25)
    return U.prune_in_volume(v, faces, vertices).select(*T.KEY, "parent")


@on_meshes("submesh", "SELECT mesh_id, CAST(3 + 1 AS BIGINT) AS vertices, count(*) AS faces FROM mf WHERE region = 'inner' GROUP BY mesh_id")
def submesh(faces, vertices, spark, sf_dir):
    f, v = U.submesh(faces, vertices, "^inner$")
    return v.groupBy("mesh_id").agg(F.max("vertex").alias("vertices")).join(f.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces")), "mesh_id")


@on_meshes("combine_meshes", "SELECT mesh_id, CAST(8 AS BIGINT) AS vertices, 2 * count(*) AS faces, CAST(max(greatest(v1, v2, v3)) + 4 AS BIGINT) AS last FROM mf GROUP BY mesh_id")
def combine_meshes(faces, vertices, spark, sf_dir):
    f, v = U.combined(faces, vertices, faces, vertices)
    return v.groupBy("mesh_id").agg(F.max("vertex").alias("vertices")).join(f.groupBy("mesh_id").agg(F.max("face").alias("faces"), F.max(F.greatest("v1", "v2", "v3")).alias("last")), "mesh_id")


@on_meshes("box_mesh_area", ", b AS (SELECT mesh_id, max(x) - min(x) AS a, max(y) - min(y) AS b, max(z) - min(z) AS c FROM mv GROUP BY mesh_id) SELECT mesh_id, round(2 * (a * b + b * c + a * c), 4) AS area FROM b")
def box_mesh_area(faces, vertices, spark, sf_dir):
    return rounded(U.summary(*U.box_mesh(G.bounding_box(vertices, "mesh_id"))), "area").select("mesh_id", "area")


from . import orders, space  # noqa: E402, F401  these register their queries here
