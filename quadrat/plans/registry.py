"""The registry of queries, and what many of them share: the cube, its neighbour sets and the tree, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrat import cube
from quadrat.operators import conditions, phylo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OCC = """WITH occ AS (
  SELECT CAST(floor(l_suppkey / 5) AS BIGINT) || ':' || CAST(floor(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) / 6) AS BIGINT) AS grp,
    p_brand || ':' || p_type AS label, sum(l_quantity) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
GROUPS = OCC + """, gps AS (
  SELECT grp, CAST(split_part(grp, ':', 1) AS BIGINT) AS x, CAST(split_part(grp, ':', 2) AS BIGINT) AS y, count(*) AS richness, sum(n) AS samples,
    1 - count(*) / sum(n) AS redundancy FROM occ GROUP BY 1, 2, 3)"""
NBRS = GROUPS + """, nbrs AS (
  SELECT c.grp AS proc, b.grp AS grp, CASE WHEN c.grp = b.grp THEN 1 ELSE 2 END AS s FROM gps c JOIN gps b
    ON abs(c.x - b.x) + abs(c.y - b.y) <= 1)"""
LABELS = ", labs AS (SELECT label, count(*) AS r, sum(n) AS a FROM occ GROUP BY 1)"
ABC = NBRS + LABELS + """, loc AS (
  SELECT proc, label, count(*) FILTER (s = 1) AS g1, count(*) FILTER (s = 2) AS g2,
    sum(CASE WHEN s = 1 THEN n ELSE 0 END) AS n1, sum(CASE WHEN s = 2 THEN n ELSE 0 END) AS n2 FROM nbrs JOIN occ USING (grp) GROUP BY 1, 2),
  used AS (SELECT proc, count(*) FILTER (s = 1) AS e1, count(*) FILTER (s = 2) AS e2 FROM nbrs GROUP BY 1),
  abc AS (SELECT loc.*, CAST(g1 > 0 AS INT) AS in1, CAST(g2 > 0 AS INT) AS in2, r, a, e1, e2, (SELECT count(DISTINCT label) FROM occ) AS total
    FROM loc JOIN labs USING (label) JOIN used USING (proc))"""
TREE = """, paths AS (
  SELECT p_brand || ':' || p_type AS tip, p_brand || ':' || p_type AS node, avg(p_size) AS len, 1 AS is_tip FROM part GROUP BY 1, 2
  UNION ALL SELECT t.tip, t.node, b.len, 0 FROM (SELECT DISTINCT p_brand || ':' || p_type AS tip, p_brand AS node FROM part) t
    JOIN (SELECT p_brand AS node, avg(p_retailprice) / 1000 AS len FROM part GROUP BY 1) b ON t.node = b.node
  UNION ALL SELECT DISTINCT p_brand || ':' || p_type, 'root', 0e0, 0 FROM part
  UNION ALL SELECT DISTINCT p_brand || ':gone', p_brand || ':gone', 7e0, 1 FROM part
  UNION ALL SELECT p_brand || ':gone', p_brand, avg(p_retailprice) / 1000, 0 FROM part GROUP BY 1, 2
  UNION ALL SELECT DISTINCT p_brand || ':gone', 'root', 0e0, 0 FROM part),
  kept AS (SELECT * FROM paths WHERE tip IN (SELECT label FROM occ)),
  nodes AS (SELECT node, max(len) AS len, max(is_tip) AS is_tip FROM kept GROUP BY 1),
  eqs AS (SELECT nodes.*, CASE WHEN len <> 0 THEN (SELECT avg(len) FROM nodes WHERE len <> 0) ELSE 0 END AS eq FROM nodes),
  nrange AS (SELECT node, count(DISTINCT grp) AS r FROM occ JOIN kept ON label = tip GROUP BY 1)"""


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return wrap


def shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cube, its neighbour sets and the tree, which every index reads several times: kept, and recomputed where a kept part is lost."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in KEPT:
        occ = cube.canonical(spark, sf_dir).persist()
        nbrs = conditions.two_sets(cube.groups(occ), conditions.self_only(), conditions.circle(1)).persist()
        for kept in KEPT.values():
            phylo.drop_closures(kept[2])
            for old in kept:
                old.unpersist()
        KEPT.clear()
        KEPT[key] = occ, nbrs, phylo.keep_closures(phylo.label_tree(spark, sf_dir).coalesce(phylo.PARTS).persist())
    return KEPT[key]


KEPT: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def base_cube(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return shared(spark, sf_dir)[:2]
