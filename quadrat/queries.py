"""Registered queries over the canonical cube, each with the SQL that states the same."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.functions import stats
from quadrat.operators import cluster, conditions, indices, phylo, randomise
from quadrat.plans import index_sql
from quadrat.plans.registry import GROUPS, LABELS, OCC, ORACLE_SQL, QUERIES, TREE, base_cube, register, shared


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Richness and weighted endemism of each group by itself."""
    occ = cube.canonical(spark, sf_dir)
    nbrs = conditions.two_sets(cube.groups(occ), conditions.self_only())
    return indices.calculate(occ, nbrs, ["calc_richness", "calc_endemism_whole"])


for _name in index_sql.DEFINITIONS:
    register(_name, index_sql.index_sql(_name))(lambda spark, sf_dir, name=_name: indices.calculate(*base_cube(spark, sf_dir), [name]))
for _name in index_sql.NODE_DEFINITIONS:
    register(_name, index_sql.node_sql(_name))(lambda spark, sf_dir, name=_name: phylo.calculate(*base_cube(spark, sf_dir), shared(spark, sf_dir)[2], 2, [name]))


@register("sp_calc_flagship", f"{OCC}{LABELS} SELECT grp AS proc, CAST(count(*) AS DOUBLE) AS RICHNESS_ALL, CAST(count(*) AS DOUBLE) AS RICHNESS_SET1, CAST(0 AS DOUBLE) AS RICHNESS_SET2, round(sum(1e0 / r), 8) AS ENDW_WE, round(sum(1e0 / r) / count(*), 8) AS ENDW_CWE, CAST(count(*) AS DOUBLE) AS ENDW_RICHNESS, round(sum(1e0 / r), 8) AS ENDW_SINGLE FROM occ JOIN labs USING (label) GROUP BY 1")
def sp_calc_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


# ---- spatial conditions: how many neighbours each group has

_CONDITIONS = {
    "sp_circle": (conditions.circle(2.5), "sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) <= 2.5"),
    "sp_annulus": (conditions.annulus(1.5, 3), "sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) BETWEEN 1.5 AND 3"),
    "sp_rectangle": (conditions.rectangle(4, 2), "abs(c.x - b.x) <= 2 AND abs(c.y - b.y) <= 1"),
    "sp_square": (conditions.square(3), "abs(c.x - b.x) <= 1.5 AND abs(c.y - b.y) <= 1.5"),
    "sp_ellipse": (conditions.ellipse(4, 2, math.pi / 2), "round((c.y - b.y) * (c.y - b.y) / 16.0 + (c.x - b.x) * (c.x - b.x) / 4.0, 10) <= 1"),
    "sp_block": (conditions.block(3), "floor(c.x / 3) = floor(b.x / 3) AND floor(c.y / 3) = floor(b.y / 3)"),
    "sp_self_only": (conditions.self_only(), "c.grp = b.grp"),
    "sp_select_all": (conditions.select_all(), "true"),
    "sp_select_element": (conditions.select_element("1:0"), "b.grp = '1:0'"),
    "sp_is_left_of": (conditions.left_of(), "b.x < c.x"),
    "sp_is_right_of": (conditions.right_of(), "b.x > c.x"),
    "sp_in_line_with": (conditions.in_line_with(), "b.x = c.x"),
    "sp_match_text": (conditions.match_text("2", 0), "split_part(b.grp, ':', 1) = '2'"),
    "sp_match_regex": (conditions.match_regex("^1"), "regexp_matches(b.grp, '^1')"),
    "sp_group_not_empty": (conditions.not_empty(), "b.richness > 0"),
    "sp_richness_greater_than": (conditions.richness_greater_than(100), "b.richness > 100"),
    "sp_redundancy_greater_than": (conditions.redundancy_greater_than(0.96), "b.redundancy > 0.96"),
    "sp_point_in_poly": (conditions.in_polygon([(-0.5, -5.5), (3.5, -5.5), (3.5, 2.5)]), "b.x > -0.5 AND b.x < 3.5 AND b.y > -5.5 AND b.y + 5.5 < 2e0 * (b.x + 0.5)"),
    "sp_condition_and_not": (conditions.circle(3) & ~conditions.circle(1), "sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) <= 3 AND NOT sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) <= 1"),
}
for _name, (_condition, _sql) in _CONDITIONS.items():
    register(_name, f"{GROUPS} SELECT c.grp AS proc, count(*) AS n_nbrs FROM gps c JOIN gps b ON {_sql} GROUP BY 1")(
        lambda spark, sf_dir, c=_condition: conditions.counts(cube.groups(shared(spark, sf_dir)[0]), c)
    )


@register("sp_select_sequence", f"{GROUPS} SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i FROM gps) WHERE i % 4 = 0")
def sp_select_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.sequence(cube.groups(shared(spark, sf_dir)[0]), 4)


@register("sp_select_block", f"{GROUPS} SELECT grp FROM (SELECT grp, row_number() OVER (PARTITION BY floor(x / 3), floor(y / 3) ORDER BY grp) AS i FROM gps) WHERE i <= 2")
def sp_select_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.first_of_blocks(cube.groups(shared(spark, sf_dir)[0]), 3, 2)


# ---- the cube


def _cube_query(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    register(name, f"{OCC} {sql}")(lambda spark, sf_dir: f(shared(spark, sf_dir)[0]))


_cube_query("import_data", "SELECT grp, label, n FROM occ", lambda occ: occ)
_cube_query("transpose", "SELECT label AS grp, grp AS label, n FROM occ", cube.transpose)
_cube_query("drop_element_axis", "SELECT grp, split_part(label, ':', 1) AS label, sum(n) AS n FROM occ GROUP BY 1, 2", lambda occ: cube.drop_axis(occ, "label", 1))
_cube_query("new_with_reordered_element_axes", "SELECT split_part(grp, ':', 2) || ':' || split_part(grp, ':', 1) AS grp, label, n FROM occ", lambda occ: cube.reorder_axes(occ, "grp", [1, 0]))
_cube_query("clone_with_reduced_resolution", "SELECT CAST(floor(CAST(split_part(grp, ':', 1) AS BIGINT) / 2) AS BIGINT) || ':' || CAST(floor(CAST(split_part(grp, ':', 2) AS BIGINT) / 3) AS BIGINT) AS grp, label, sum(n) AS n FROM occ GROUP BY 1, 2", lambda occ: cube.coarsen(occ, [2, 3]))
_cube_query("binarise_sample_counts", "SELECT grp, label, 1e0 AS n FROM occ", cube.binarise)
_cube_query("merge", "SELECT grp, label, 2 * n AS n FROM occ", lambda occ: cube.merge(occ, occ))
_cube_query("rename_label", "SELECT grp, CASE WHEN label LIKE 'Brand#1%' THEN 'one' ELSE label END AS label, sum(n) AS n FROM occ GROUP BY 1, 2", lambda occ: cube.rename(occ, "label", occ.where("label like 'Brand#1%'").select(F.col("label").alias("old"), F.lit("one").alias("new")).distinct()))
_cube_query("trim", "SELECT grp, label, n FROM occ WHERE label LIKE '%1%'", lambda occ: cube.trim(occ, occ.where("label like '%1%'")))
_cube_query("run_exclusions", "SELECT grp, label, n FROM occ WHERE label NOT IN (SELECT label FROM occ GROUP BY 1 HAVING sum(n) <= 3000 OR label LIKE '%#3%')", lambda occ: cube.exclude(occ, "label", min_samples=3000, regex="#3"))
_cube_query("get_base_stats", "SELECT grp, count(*) AS richness, sum(n) AS samples, round(1 - count(*) / sum(n), 8) AS redundancy FROM occ GROUP BY 1", lambda occ: cube.groups(occ).select("grp", "richness", "samples", F.round("redundancy", 8).alias("redundancy")))
_cube_query("get_range_and_abundance", "SELECT label, count(*) AS range, sum(n) AS abundance FROM occ GROUP BY 1", cube.labels)
_cube_query("get_range_union", "SELECT DISTINCT grp FROM occ WHERE label LIKE '%#11%'", lambda occ: cube.range_union(occ, occ.where("label like '%#11%'")))
_cube_query("get_range_intersection", "SELECT grp FROM occ WHERE label LIKE '%#11%' GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT label) FROM occ WHERE label LIKE '%#11%')", lambda occ: cube.range_intersection(occ, occ.where("label like '%#11%'")))
_cube_query("get_coord_bounds", "SELECT CAST(0 AS INT) AS axis, min(CAST(split_part(grp, ':', 1) AS DOUBLE)) AS low, max(CAST(split_part(grp, ':', 1) AS DOUBLE)) AS high FROM occ UNION ALL SELECT 1, min(CAST(split_part(grp, ':', 2) AS DOUBLE)), max(CAST(split_part(grp, ':', 2) AS DOUBLE)) FROM occ", cube.coordinate_bounds)
_cube_query("statistics", "SELECT grp, round(avg(n), 8) AS mean, round(coalesce(stddev_samp(n), 0), 8) AS sd, round(skewness(n), 6) AS skew, round(kurtosis(n), 6) AS kurt, list_extract(list(n ORDER BY n), CAST(floor(0.5 + (count(*) - 1) * 0.05) AS BIGINT) + 1) AS pct05, list_extract(list(n ORDER BY n), CAST(floor(0.5 + (count(*) - 1) * 0.75) AS BIGINT) + 1) AS pct75 FROM occ GROUP BY 1", lambda occ: occ.groupBy("grp").agg(F.round(F.avg("n"), 8).alias("mean"), F.round(stats.sd(F.col("n")), 8).alias("sd"), F.round(stats.skewness(F.col("n")), 6).alias("skew"), F.round(stats.kurtosis(F.col("n")), 6).alias("kurt"), stats.percentile(F.col("n"), 5).alias("pct05"), stats.percentile(F.col("n"), 75).alias("pct75")))


# ---- numeric labels: label p_size, weight the quantity; groups as above


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = cube.table(spark, sf_dir, "lineitem"), cube.table(spark, sf_dir, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return cube.from_records(rows, [cube.bin_index(F.col("l_suppkey"), 5)], [F.col("p_size")], F.col("l_quantity")).select("grp", F.col("label").cast("double").alias("v"), F.col("n").alias("w"))


_SIZES = "WITH z AS (SELECT CAST(CAST(floor(l_suppkey / 5) AS BIGINT) AS VARCHAR) AS grp, CAST(p_size AS DOUBLE) AS v, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
@register("calc_num_labels_gistar", f"{_SIZES}, t AS (SELECT sum(w) AS n, sum(v * w) / sum(w) AS m, sqrt((sum(v * v * w) - sum(v * w) * sum(v * w) / sum(w)) / (sum(w) - 1)) AS sd FROM z) SELECT grp, round((sum(v * w) - sum(w) * max(m)) / (max(sd) * sqrt((max(n) * sum(w) - sum(w) * sum(w)) / (max(n) - 1))), 6) AS NUM_GISTAR FROM z, t GROUP BY 1")
def calc_num_labels_gistar(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _sizes(spark, sf_dir)
    t = z.agg(F.sum("w").alias("n"), F.expr("sum(v * w) / sum(w)").alias("m"), F.expr("sqrt((sum(v * v * w) - sum(v * w) * sum(v * w) / sum(w)) / (sum(w) - 1))").alias("sd"))
    local = z.groupBy("grp").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("k")).crossJoin(F.broadcast(t))
    return local.select("grp", F.round(stats.gistar(F.col("s"), F.col("k"), F.col("m"), F.col("sd"), F.col("n")), 6).alias("NUM_GISTAR"))


# ---- matrices, trees, clusters

for _index, _sql in (("SORENSON", "1 - 2e0 * a / (v1 + v2)"), ("JACCARD", "1 - 1e0 * a / (v1 + v2 - a)"), ("S2", "1 - 1e0 * a / least(v1, v2)")):
    register(
        f"build_matrix_{_index.lower()}",
        f"{OCC}, v AS (SELECT grp, count(*) AS v FROM occ GROUP BY 1), p AS (SELECT p.grp AS e1, q.grp AS e2, p.v AS v1, q.v AS v2, (SELECT count(*) FROM occ x JOIN occ y ON x.label = y.label WHERE x.grp = p.grp AND y.grp = q.grp) AS a FROM v p JOIN v q ON p.grp < q.grp) SELECT e1, e2, round({_sql}, 8) AS value FROM p",
    )(lambda spark, sf_dir, index=_index: cluster.pair_matrix(shared(spark, sf_dir)[0], index))


@register("get_node_range_hash", f"{OCC}{TREE} SELECT node, r AS range FROM nrange")
def get_node_range_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = shared(spark, sf_dir)[0]
    return phylo.node_ranges(occ, phylo.trimmed(phylo.closure(shared(spark, sf_dir)[2], 2), occ))


@register("tree_to_matrix", "WITH t AS (SELECT p_brand || ':' || p_type AS tip, p_brand AS b, avg(p_size) AS len FROM part GROUP BY 1, 2 UNION ALL SELECT DISTINCT p_brand || ':gone', p_brand, 7e0 FROM part), g AS (SELECT p_brand AS b, avg(p_retailprice) / 1000 AS len FROM part GROUP BY 1) SELECT x.tip AS a, y.tip AS b, round(x.len + y.len + CASE WHEN x.b = y.b THEN 0 ELSE gx.len + gy.len END, 9) AS distance FROM t x JOIN t y ON x.tip < y.tip JOIN g gx ON gx.b = x.b JOIN g gy ON gy.b = y.b")
def tree_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phylo.patristic(phylo.closure(shared(spark, sf_dir)[2], 2)).select("a", "b", F.round("distance", 9).alias("distance"))


@register("cluster")
def cluster_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.agglomerate(cluster.pair_matrix(shared(spark, sf_dir)[0]))


@register("group_nodes_below")
def group_nodes_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cut(cluster_query(spark, sf_dir), 5)


# ---- randomisation: results depend on hashes and seeds, so tests check what must stay


def _random(model: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        occ = shared(spark, sf_dir)[0]
        made = model(occ, 3)
        base = occ.join(cube.labels(occ).select("label", "range"), "label").groupBy(F.col("grp").alias("proc")).agg(F.count("*").cast("double").alias("RICHNESS"), F.sum(1 / F.col("range")).alias("WE"))
        ranges = made.groupBy("iter", "label").agg(F.count("*").alias("range"))
        drawn = made.join(ranges, ["iter", "label"]).groupBy("iter", F.col("grp").alias("proc")).agg(F.count("*").cast("double").alias("RICHNESS"), F.sum(1 / F.col("range")).alias("WE"))
        out = randomise.compare(base, drawn, ["RICHNESS", "WE"])
        return out.select("proc", "idx", "C", "T", "Q", "P", randomise.p_rank().alias("rank"), randomise.z_score().alias("z"), randomise.significance().alias("significance"))

    return run


for _name, _model in (("rand_csr_by_group", randomise.csr_by_group), ("rand_curveball", randomise.curveball), ("rand_independent_swaps", randomise.independent_swaps), ("rand_structured", randomise.structured)):
    register(_name)(_random(_model))

for _module in ("lists", "estimators", "properties", "clades", "ranges", "trees", "randomise", "expressions", "clusters"):
    importlib.import_module(f"quadrat.plans.{_module}")
