"""Registered steps of clustering, nodes' calculations, fishnets and small readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import cluster, indices
from quadrat.plans.registry import GROUPS, OCC, ORACLE_SQL, QUERIES, register, shared
from quadrat.sinks import text as sink
from quadrat.sources import text as source

_PAIRS = f"""{OCC}, v AS (SELECT grp, CAST(count(*) AS DOUBLE) AS v FROM occ GROUP BY 1), sh AS (SELECT x.grp AS e1, y.grp AS e2, count(*) AS a FROM occ x JOIN occ y ON x.label = y.label AND x.grp < y.grp GROUP BY 1, 2),
  mx AS (SELECT p.grp AS e1, q.grp AS e2, round(1 - 2e0 * coalesce(a, 0) / (p.v + q.v), 8) AS value, p.v + q.v - coalesce(a, 0) AS joint FROM v p JOIN v q ON p.grp < q.grp LEFT JOIN sh ON e1 = p.grp AND e2 = q.grp)"""


def _add(name: str, sql: str, make) -> None:
    register(name, sql)(lambda spark, sf_dir: make(shared(spark, sf_dir)[0]))


def _tips(occ: DataFrame) -> DataFrame:
    return occ.groupBy(F.col("grp").alias("element")).agg(F.count("*").alias("tips"))


_STEP = f"""{_PAIRS}, both_ AS (SELECT e1 AS e, e2 AS o, value FROM mx UNION ALL SELECT e2, e1, value FROM mx), near AS (SELECT both_.*, v.v AS tips FROM both_ JOIN v ON v.grp = e WHERE e IN ('0:0', '0:1') AND o NOT IN ('0:0', '0:1')),
  new AS (SELECT o, {{0}} AS value FROM near GROUP BY 1)
  SELECT e1, e2, round(value, 7) AS value FROM mx WHERE e1 NOT IN ('0:0', '0:1') AND e2 NOT IN ('0:0', '0:1') UNION ALL SELECT least(o, '0___'), greatest(o, '0___'), round(value, 7) FROM new"""
for _name, _sql in (("link_average", "sum(value * tips) / sum(tips)"), ("link_average_unweighted", "avg(value)"), ("link_minimum", "min(value)"), ("link_maximum", "max(value)"), ("run_linkage", "sum(value * tips) / sum(tips)")):
    _add(_name, _STEP.format(_sql), lambda o, kind="link_average" if _name == "run_linkage" else _name: cluster.linked(cluster.pair_matrix(o), "0:0", "0:1", "0___", kind, _tips(o)).withColumn("value", F.round("value", 7)))
_MERGED = OCC.replace("WITH occ AS (", "WITH occ0 AS (") + ", occ AS (SELECT CASE WHEN grp IN ('0:0', '0:1') THEN '0___' ELSE grp END AS grp, label, sum(n) AS n FROM occ0 GROUP BY 1, 2)" + _PAIRS[len(OCC) :]
_add("link_recalculate", f"{_MERGED} SELECT e1, e2, value FROM mx", lambda o: cluster.recalculated(o, "0:0", "0:1", "0___"))
_add("get_most_similar_pair", f"{_PAIRS} SELECT e1, e2, value FROM mx ORDER BY value, e1, e2 LIMIT 1", lambda o: cluster.most_similar(cluster.pair_matrix(o)))


def _tied(occ: DataFrame) -> DataFrame:
    """(e1, e2, value, tie): the matrix to a digit, with the labels of both groups together."""
    return cluster.pair_counts(occ).select("e1", "e2", F.round(F.round(F.expr(cluster.INDICES["SORENSON"]), 8), 1).alias("value"), F.expr("v1 + v2 - A").alias("tie"))


_add("get_most_similar_pair_using_tie_breaker", f"{_PAIRS} SELECT e1, e2, round(value, 1) AS value FROM mx ORDER BY round(value, 1), joint DESC, e1, e2 LIMIT 1", lambda o: cluster.most_similar(_tied(o)))
_add("get_max_poss_matrix_value", f"{_PAIRS} SELECT max(joint) AS value FROM mx", lambda o: _tied(o).agg(F.max("tie").alias("value")))
_add("export_matrices", f"{_PAIRS} SELECT e1 || ',' || e2 || ',' || round(value, 3) AS line FROM mx", lambda o: sink.delimited(cluster.pair_matrix(o).select("e1", "e2", F.round("value", 3).alias("value"))))
for _name in ("import_data_sparse", "load_data"):
    _add(_name, f"{_PAIRS} SELECT e1, e2, round(value, 3) AS value FROM mx", lambda o: source.records(sink.delimited(cluster.pair_matrix(o).select("e1", "e2", F.round("value", 3))), ["e1", "e2", "value"]).withColumn("value", F.col("value").cast("double")))
_add(
    "cluster_sp_calc", f"{OCC}, r AS (SELECT label, count(*) AS r FROM occ GROUP BY 1), nb AS (SELECT split_part(grp, ':', 1) || '___' AS proc, grp FROM occ GROUP BY 1, 2), l AS (SELECT proc, label, count(*) AS g FROM nb JOIN occ USING (grp) GROUP BY 1, 2) SELECT proc, CAST(count(*) AS DOUBLE) AS RICHNESS_ALL, round(sum(g / CAST(r AS DOUBLE)), 8) AS ENDW_WE FROM l JOIN r USING (label) GROUP BY 1",
    lambda o: indices.calculate(o, o.select(F.concat(F.split("grp", ":")[0], F.lit("___")).alias("proc"), "grp").distinct().withColumn("set", F.lit(1)), ["calc_richness", "calc_endemism_whole"]).select("proc", "RICHNESS_ALL", "ENDW_WE"),
)


# ---- a fishnet over the cells, and its polygons


def _fishnet(occ: DataFrame, size: int = 2) -> DataFrame:
    g = cube.groups(occ)
    box = g.agg(F.floor(F.min("x") / size).alias("x0"), F.floor(F.max("x") / size).alias("x1"), F.floor(F.min("y") / size).alias("y0"), F.floor(F.max("y") / size).alias("y1"))
    return box.select(F.explode(F.sequence("x0", "x1")).alias("i"), "y0", "y1").select("i", F.explode(F.sequence("y0", "y1")).alias("j")).select((F.col("i") * size).alias("x"), (F.col("j") * size).alias("y"))


_NET = f"{GROUPS}, b AS (SELECT CAST(floor(min(x) / 2e0) AS BIGINT) AS x0, CAST(floor(max(x) / 2e0) AS BIGINT) AS x1, CAST(floor(min(y) / 2e0) AS BIGINT) AS y0, CAST(floor(max(y) / 2e0) AS BIGINT) AS y1 FROM gps), net AS (SELECT i * 2 AS x, j * 2 AS y FROM (SELECT unnest(range(x0, x1 + 1)) AS i, y0, y1 FROM b), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS j))"
_add("get_fishnet_polygon_layer", f"{_NET} SELECT x, y, 'POLYGON((' || x || ' ' || y || ',' || (x + 2) || ' ' || y || ',' || (x + 2) || ' ' || (y + 2) || ',' || x || ' ' || (y + 2) || ',' || x || ' ' || y || '))' AS wkt FROM net", lambda o: _fishnet(o).select("x", "y", F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.concat_ws(" ", (F.col("x") + a).cast("string"), (F.col("y") + b).cast("string")) for a, b in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]), F.lit("))")).alias("wkt")))
_add("get_fishnet_identity_layer", f"{_NET} SELECT gps.grp, net.x AS fx, net.y AS fy FROM gps JOIN net ON gps.x >= net.x AND gps.x < net.x + 2 AND gps.y >= net.y AND gps.y < net.y + 2", lambda o: cube.groups(o).select("grp", (cube.bin_index(F.col("x"), 2) * 2).alias("fx"), (cube.bin_index(F.col("y"), 2) * 2).alias("fy")))
_add("import_element_properties", f"{OCC} SELECT label, 'RANGE' AS prop, CAST(count(*) AS DOUBLE) AS value FROM occ GROUP BY 1", lambda o: source.records(sink.delimited(cube.labels(o).select("label", "range")), ["label", "RANGE"]).select("label", F.lit("RANGE").alias("prop"), F.col("RANGE").cast("double").alias("value")))

#: The same codes for the nodes of a tree, and Newick in PHYLIP files.
for _alias, _known in (("tree_calculate_canape", "calculate_canape"), ("import_phylip", "import_newick")):
    register(_alias, ORACLE_SQL.get(_known))(QUERIES[_known])
