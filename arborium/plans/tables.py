"""Trees, clouds, grids and meshes that Spark derives from the star-schema tables, and the same in SQL.

Each tree is the history of one user in events: the n-th event is vertex n, its value and time give the
coordinates, and SHAPES give the parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..skew import dealt

#: Parent of vertex n > 1 by shape; {div} is integer division.
SHAPES = {
    "heap": "n {div} 2",
    "caterpillar": "CASE WHEN n % 5 = 0 THEN n - 3 ELSE n - 1 END",
    "ternary": "(n + 1) {div} 3",
    "forest": "CASE WHEN n % 17 = 0 THEN -1 ELSE n {div} 2 END",
}

TREE = """SELECT neuron_id, n AS point_no, x, y, z, w, label, CASE WHEN n = 1 THEN CAST(-1 AS BIGINT) ELSE CAST({parent} AS BIGINT) END AS parent
FROM (SELECT user_id AS neuron_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n,
      value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y, CAST(extract(HOUR FROM ts) AS DOUBLE) AS z,
      CAST(event_id % 7 AS DOUBLE) AS w, event_type AS label FROM {events}) AS e"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_sql(shape: str) -> str:
    return TREE.format(parent=SHAPES[shape].format(div="//"), events="events")


def trees(spark: SparkSession, sf_dir: str, shape: str = "heap") -> DataFrame:
    events = dealt(table(spark, sf_dir, "events").select("user_id", "event_id", "value", "props", "ts", "event_type"), "user_id")
    return spark.sql(TREE.format(parent=SHAPES[shape].format(div="div"), events="{events}"), events=events)


#: A cloud of points a supplier, named by its rows' order.
CLOUD = """SELECT CAST(l_suppkey AS BIGINT) AS image_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) AS BIGINT) AS point,
       l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, l_extendedprice AS price FROM {lineitem}"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLOUD, lineitem=dealt(lines(spark, sf_dir), "l_suppkey"))


#: A grid a supplier: cells of 5 quantities, 2 discounts and 3 taxes, with the mean price.
GRID_DIMS, GRID_ORIGIN, GRID_SIZE = (10, 6, 3), (3.0, 0.5, 1.0), (5.0, 2.0, 3.0)
GRID = """SELECT image_id, CAST(floor((x - 1) / 5) + 1 AS BIGINT) AS i, CAST(floor(y / 2) + 1 AS BIGINT) AS j, CAST(floor(z / 3) + 1 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS value
FROM ({cloud}) AS c GROUP BY ALL"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GRID.format(cloud=CLOUD), lineitem=dealt(lines(spark, sf_dir), "l_suppkey"))


#: A tetrahedron a nation: corner k from the nation's key; regions are named by the world region.
MESH_VERTEX = """SELECT CAST(n_nationkey AS BIGINT) AS mesh_id, CAST(v AS BIGINT) AS vertex,
  CAST(CASE v WHEN 1 THEN 0 WHEN 2 THEN 40 + n_nationkey WHEN 3 THEN 5 ELSE 10 END AS DOUBLE) AS x,
  CAST(CASE v WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 9 + n_nationkey % 3 ELSE 3 END AS DOUBLE) AS y,
  CAST(CASE v WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 8 + n_nationkey % 5 END AS DOUBLE) AS z
FROM {nation} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS k"""
MESH_FACE = """SELECT CAST(n_nationkey AS BIGINT) AS mesh_id, CAST(f AS BIGINT) AS face, CASE WHEN f <= 2 THEN 'inner' ELSE 'outer' END AS region,
  CAST(CASE WHEN f = 4 THEN 2 ELSE 1 END AS BIGINT) AS v1, CAST(CASE f WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 3 END AS BIGINT) AS v2, CAST(CASE f WHEN 1 THEN 3 ELSE 4 END AS BIGINT) AS v3
FROM {nation} CROSS JOIN (SELECT 1 AS f UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS k"""


def meshes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices)."""
    nation = table(spark, sf_dir, "nation")
    return spark.sql(MESH_FACE, nation=nation), spark.sql(MESH_VERTEX, nation=nation)


METADATA = """SELECT c_custkey AS neuron_id, c_name, c_acctbal, c_mktsegment, n_name FROM {customer} AS c JOIN {nation} AS n ON c_nationkey = n_nationkey"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(METADATA, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
