"""Queries on depth-first orders, undirected graphs and resampled trees, registered in the catalog."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import graphs as R
from ..operators import images as I
from ..operators import morphometry as M
from ..operators import ordering as O
from ..operators import resampling as P
from ..operators import topology as T
from ..operators import vector_clouds as V
from .catalog import ANCESTOR, CONTACT, DEPTH, EDGE, NODE, halves, on_grids, query, rounded, strahler_sql

#: Trees in depth-first order by the lists of points on the way from the root.
WALK = "/*rec*/ q AS (SELECT neuron_id, point_no, point_no AS root, [point_no] AS path FROM v WHERE parent = -1 UNION ALL SELECT v.neuron_id, v.point_no, q.root, list_append(q.path, v.point_no) FROM q JOIN v ON v.neuron_id = q.neuron_id AND v.parent = q.point_no), walk AS (SELECT neuron_id, point_no, root, len(path) - 1 AS depth, row_number() OVER (PARTITION BY neuron_id, root ORDER BY path) - 1 AS pre, count(*) OVER (PARTITION BY neuron_id, root) AS tree_size FROM q)"
BELOW = "sub AS (SELECT a.neuron_id, a.point_no, count(*) AS size FROM q a JOIN q b ON b.neuron_id = a.neuron_id AND list_contains(b.path, a.point_no) GROUP BY ALL)"
#: Segments: members with their numbers, then heads.
RUNS = f"{NODE}, {WALK}, mem AS (SELECT w.*, g.parent, 1 + coalesce(sum(CASE WHEN g.n_children <> 1 AND w.pre > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY w.neuron_id, root ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg_id FROM walk w JOIN g ON g.neuron_id = w.neuron_id AND g.point_no = w.point_no), so AS (SELECT neuron_id, root, seg_id, pre - min(pre) OVER (PARTITION BY neuron_id, root, seg_id) + 2 AS pos, point_no FROM mem WHERE pre > 0 UNION ALL SELECT neuron_id, root, seg_id, 1, arg_min(parent, pre) FROM mem WHERE pre > 0 GROUP BY neuron_id, root, seg_id UNION ALL SELECT neuron_id, root, 1, 1, point_no FROM mem WHERE tree_size = 1)"
STARTS = "starts AS (SELECT neuron_id, root, sum(tree_size) OVER (PARTITION BY neuron_id ORDER BY tree_size DESC, root ROWS UNBOUNDED PRECEDING) - tree_size AS before FROM walk WHERE pre = 0)"


@query("depth_first", f"WITH {WALK}, {BELOW} SELECT walk.neuron_id, walk.point_no, root, CAST(pre AS BIGINT) AS pre, size, CAST(depth AS BIGINT) AS depth FROM walk JOIN sub ON sub.neuron_id = walk.neuron_id AND sub.point_no = walk.point_no", "forest")
def depth_first(v):
    return O.depth_first(v).select(*T.KEY, "root", "pre", "size", "depth")


for _name, _shape in (("segment_order", "caterpillar"), ("segment_order_forest", "forest")):
    query(_name, f"WITH {RUNS} SELECT neuron_id, root, CAST(seg_id AS BIGINT) AS seg_id, CAST(pos AS BIGINT) AS pos, point_no FROM so", _shape)(O.segment_order)


@query("renumbered", f"WITH {WALK}, {STARTS}, n AS (SELECT walk.*, CAST(before + pre + 1 AS BIGINT) AS new FROM walk JOIN starts ON starts.neuron_id = walk.neuron_id AND starts.root = walk.root) SELECT n.neuron_id, n.new AS point_no, coalesce(p.new, -1) AS parent, v.x, v.y FROM n JOIN v ON v.neuron_id = n.neuron_id AND v.point_no = n.point_no LEFT JOIN n p ON p.neuron_id = v.neuron_id AND p.point_no = v.parent", "forest")
def renumbered(v):
    return O.renumbered(v).select(*T.KEY, "parent", "x", "y")


def undirected(v):
    """The trees' edges without their direction: half of them turned round."""
    turn = F.pmod(F.xxhash64(*T.KEY), F.lit(2)) == 0
    end = lambda a, b: F.when(turn, F.col(a)).otherwise(F.col(b))
    return v.filter("parent <> -1").select("neuron_id", end("point_no", "parent").alias("a"), end("parent", "point_no").alias("b"))


@query("graph_parents", f"WITH {WALK}, top AS (SELECT neuron_id, root, row_number() OVER (PARTITION BY neuron_id ORDER BY tree_size DESC, root) AS k FROM walk WHERE pre = 0) SELECT v.neuron_id, v.point_no, v.parent, walk.root, tree_size AS size, k = 1 AS master FROM v JOIN walk ON walk.neuron_id = v.neuron_id AND walk.point_no = v.point_no JOIN top ON top.neuron_id = walk.neuron_id AND top.root = walk.root", "forest")
def graph_parents(v):
    return R.oriented(v, undirected(v), v.filter("parent = -1"))


@query("graph_from_first_end", f"""WITH {NODE}, {WALK}, p AS (SELECT walk.neuron_id, walk.root AS part, min(walk.point_no) AS first, min(CASE WHEN g.degree <= 1 THEN walk.point_no END) AS root, count(*) AS size FROM walk JOIN g ON g.neuron_id = walk.neuron_id AND g.point_no = walk.point_no GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY size DESC, first) AS k FROM p),
 way AS (SELECT q.neuron_id, unnest(q.path) AS anc FROM q JOIN p ON p.neuron_id = q.neuron_id AND p.root = q.point_no),
 c AS (SELECT v.neuron_id, v.parent AS anc, v.point_no AS below FROM v JOIN way ON way.neuron_id = v.neuron_id AND way.anc = v.point_no)
 SELECT v.neuron_id, v.point_no, CASE WHEN way.anc IS NULL THEN v.parent ELSE coalesce(c.below, -1) END AS parent, k.root, k.size, k.k = 1 AS master FROM v JOIN walk ON walk.neuron_id = v.neuron_id AND walk.point_no = v.point_no JOIN k ON k.neuron_id = v.neuron_id AND k.part = walk.root
 LEFT JOIN way ON way.neuron_id = v.neuron_id AND way.anc = v.point_no LEFT JOIN c ON c.neuron_id = v.neuron_id AND c.anc = v.point_no""", "forest")
def graph_from_first_end(v):
    return R.oriented(v, undirected(v))


@query("graph_problems", """WITH u AS (SELECT neuron_id, least(point_no, parent) AS a, greatest(point_no, parent) AS b FROM v WHERE parent <> -1 UNION SELECT neuron_id, point_no, point_no + 3 FROM v WHERE point_no % 4 = 0),
 e AS (SELECT u.* FROM u WHERE EXISTS (SELECT 1 FROM v WHERE v.neuron_id = u.neuron_id AND v.point_no = u.b)), n AS (SELECT neuron_id, count(*) AS n FROM v GROUP BY ALL),
 /*rec*/ r AS (SELECT neuron_id, point_no AS p, point_no AS o FROM v UNION SELECT r.neuron_id, CASE WHEN e.a = r.p THEN e.b ELSE e.a END, r.o FROM r JOIN e ON e.neuron_id = r.neuron_id AND (e.a = r.p OR e.b = r.p)),
 c AS (SELECT neuron_id, count(DISTINCT first) AS c FROM (SELECT neuron_id, p, min(o) AS first FROM r GROUP BY ALL) GROUP BY neuron_id)
 SELECT n.neuron_id, n.n AS vertices, count(e.a) AS edges, c.c AS components, count(e.a) - n.n + c.c AS circles, CAST(0 AS BIGINT) AS repeated_names, (SELECT count(*) FROM u WHERE u.neuron_id = n.neuron_id) - count(e.a) AS loose_edges FROM n JOIN c ON c.neuron_id = n.neuron_id LEFT JOIN e ON e.neuron_id = n.neuron_id GROUP BY n.neuron_id, n.n, c.c""", "forest")
def graph_problems(v):
    more = v.filter("point_no % 4 = 0").select("neuron_id", F.col("point_no").alias("a"), (F.col("point_no") + 3).alias("b"))
    return R.problems(v, undirected(v).unionByName(more))


STEP = 10.0


@query("resample_tree", f"""WITH {RUNS}, {STARTS}, {EDGE}, {DEPTH.removeprefix("/*rec*/ ")}, f AS (SELECT so.*, v.x, v.y, v.z, v.w, v.label, t.dist - first(t.dist) OVER seg AS pos_at FROM so JOIN v ON v.neuron_id = so.neuron_id AND v.point_no = so.point_no JOIN t ON t.neuron_id = so.neuron_id AND t.point_no = so.point_no WINDOW seg AS (PARTITION BY so.neuron_id, so.root, seg_id ORDER BY pos)),
 m AS (SELECT *, max(pos_at) OVER whole AS length, count(*) OVER whole AS n, lead(pos_at) OVER seg AS at2, lead(x) OVER seg AS x2, lead(y) OVER seg AS y2, lead(z) OVER seg AS z2, lead(w) OVER seg AS w2, first(label) OVER seg AS named FROM f WINDOW seg AS (PARTITION BY neuron_id, root, seg_id ORDER BY pos), whole AS (PARTITION BY neuron_id, root, seg_id)),
 made AS (SELECT *, unnest(range(CAST(floor(pos_at / {STEP}) AS BIGINT) + 1, CAST(floor(at2 / {STEP}) AS BIGINT) + 1)) AS k FROM m WHERE length > {STEP} AND at2 IS NOT NULL),
 pts AS (SELECT neuron_id, root, seg_id, pos_at, pos, point_no, x, y, z, w, named AS label FROM m WHERE pos > 1 AND (length <= {STEP} OR pos = n)
  UNION ALL SELECT neuron_id, root, seg_id, k * {STEP}, 0, NULL, x + (k * {STEP} - pos_at) / (at2 - pos_at) * (x2 - x), y + (k * {STEP} - pos_at) / (at2 - pos_at) * (y2 - y), z + (k * {STEP} - pos_at) / (at2 - pos_at) * (z2 - z), w + (k * {STEP} - pos_at) / (at2 - pos_at) * (w2 - w), named FROM made WHERE k * {STEP} < length
  UNION ALL SELECT walk.neuron_id, walk.root, 0, 0.0, 0, walk.point_no, x, y, z, w, label FROM walk JOIN v ON v.neuron_id = walk.neuron_id AND v.point_no = walk.point_no WHERE pre = 0),
 num AS (SELECT pts.*, row_number() OVER (PARTITION BY pts.neuron_id ORDER BY before, seg_id, pos_at, pos = 0, pos) AS new, row_number() OVER (PARTITION BY pts.neuron_id, pts.root, seg_id ORDER BY pos_at, pos = 0, pos) AS nth FROM pts JOIN starts ON starts.neuron_id = pts.neuron_id AND starts.root = pts.root)
 SELECT num.neuron_id, num.new AS point_no, CASE WHEN num.seg_id = 0 THEN -1 WHEN num.nth > 1 THEN num.new - 1 ELSE h.new END AS parent, round(num.x, 4) + 0.0 AS x, round(num.y, 4) + 0.0 AS y, round(num.z, 4) + 0.0 AS z, round(num.w, 4) + 0.0 AS w, num.label
 FROM num LEFT JOIN so ON num.nth = 1 AND so.neuron_id = num.neuron_id AND so.root = num.root AND so.seg_id = num.seg_id AND so.pos = 1 LEFT JOIN num h ON h.neuron_id = so.neuron_id AND h.point_no = so.point_no""", "forest")
def resample_tree(v):
    return rounded(P.resample_tree(v, STEP), "x", "y", "z", "w")


SPINE = f"""WITH {EDGE}, {NODE}, {DEPTH}, {ANCESTOR.removeprefix('/*rec*/ ')}, ends AS (SELECT g.neuron_id, g.point_no, t.dist FROM g JOIN t ON t.neuron_id = g.neuron_id AND t.point_no = g.point_no WHERE g.degree = 1),
 ea AS (SELECT a.neuron_id, a.point_no, a.anc, ends.dist, t.dist AS at FROM a JOIN ends ON ends.neuron_id = a.neuron_id AND ends.point_no = a.point_no JOIN t ON t.neuron_id = a.neuron_id AND t.point_no = a.anc),
 p AS (SELECT l.neuron_id, l.point_no AS a, r.point_no AS b, min(l.dist + r.dist - 2 * l.at) AS d, arg_max(l.anc, l.at) AS apex, max(l.at) AS turn FROM ea l JOIN ea r ON l.neuron_id = r.neuron_id AND l.anc = r.anc AND l.point_no < r.point_no GROUP BY ALL),
 best AS (SELECT neuron_id, a, b, apex, turn FROM p QUALIFY row_number() OVER (PARTITION BY neuron_id ORDER BY d DESC, apex, a, b) = 1)
 SELECT DISTINCT a.neuron_id, a.anc AS point_no FROM best JOIN a ON a.neuron_id = best.neuron_id AND a.point_no IN (best.a, best.b) JOIN t ON t.neuron_id = a.neuron_id AND t.point_no = a.anc WHERE t.dist > best.turn OR a.anc = best.apex"""


@query("spine_vertices", SPINE, "caterpillar")
def spine_vertices(v):
    return M.spine(v)


#: Contacts between main trees, of edges that start in a box.
BOX = (0.0, 60.0, 0.0, 80.0, 0.0, 12.0)
MAIN = f"{re.sub(r'\bt\b', 'dep', DEPTH)}, size AS (SELECT neuron_id, root, count(*) AS n FROM dep GROUP BY ALL), tops AS (SELECT neuron_id, root, row_number() OVER (PARTITION BY neuron_id ORDER BY n DESC, root) AS k FROM size), e2 AS (SELECT e.* FROM e JOIN dep ON dep.neuron_id = e.neuron_id AND dep.point_no = e.point_no JOIN tops ON tops.neuron_id = dep.neuron_id AND tops.root = dep.root AND tops.k = 1 WHERE " + " AND ".join(f"p{c} BETWEEN {BOX[2 * k]} AND {BOX[2 * k + 1]}" for k, c in enumerate("xyz")) + ")"


@query("potential_synapses_main", CONTACT.replace(f"WITH {EDGE}", f"WITH {EDGE}, {MAIN}").replace("FROM e a JOIN e b", "FROM e2 a JOIN e2 b"), "forest")
def potential_synapses_main(v):
    return M.potential_synapses(*halves(v), 4.0, bounds=BOX, main=True)


@query("topology_features", f"{strahler_sql()} SELECT o.neuron_id, o.point_no, round(t.dist, 4) AS distance, max(strahler) OVER (PARTITION BY o.neuron_id) - strahler AS reversed_order FROM o JOIN t ON t.neuron_id = o.neuron_id AND t.point_no = o.point_no", "ternary")
def topology_features(v):
    return rounded(V.topology_features(v), "distance")


@query("cloud_subset", "SELECT neuron_id, count(*) AS n FROM v WHERE NOT (x > 20 AND y < 60) GROUP BY neuron_id", "heap")
def cloud_subset(v):
    return V.subset(v, (F.col("x") > 20) & (F.col("y") < 60), invert=True).groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"))


@on_grids("image_differing", "SELECT image_id FROM g GROUP BY image_id HAVING sum(CASE WHEN image_id % 3 = 0 AND value > 1 THEN 1 ELSE 0 END) > 0")
def image_differing(g):
    return I.differing(g, g.withColumn("value", F.when((F.col("image_id") % 3 == 0) & (F.col("value") > 1), F.col("value") + 1).otherwise(F.col("value"))), "image_id")
