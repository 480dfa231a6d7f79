"""Registered queries on elements, ranges, statistics, orders and the spatial index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.functions import stats
from quadrat.operators import cluster, conditions, properties, ranges
from quadrat.plans.registry import GROUPS, LABELS, NBRS, OCC, base_cube, register, shared


def _add(name: str, sql: str, make) -> None:
    register(name, sql)(lambda spark, sf_dir: make(shared(spark, sf_dir)[0]))


_A, _B = "labs AS (SELECT DISTINCT label FROM occ)", "0:0"
_add("rename_group", f"{OCC} SELECT CASE WHEN grp LIKE '0:%' THEN 'zero' ELSE grp END AS grp, label, sum(n) AS n FROM occ GROUP BY 1, 2", lambda o: cube.rename(o, "grp", o.where("grp like '0:%'").select(F.col("grp").alias("old"), F.lit("zero").alias("new")).distinct()))
_add("remap_labels_from_hash", f"{OCC} SELECT grp, CASE WHEN label LIKE 'Brand#2%' THEN upper(label) ELSE label END AS label, sum(n) AS n FROM occ GROUP BY 1, 2", lambda o: cube.rename(o, "label", o.where("label like 'Brand#2%'").select(F.col("label").alias("old"), F.upper("label").alias("new")).distinct()))
_add("delete_element", f"{OCC} SELECT grp, label, n FROM occ WHERE grp NOT IN ('0:0', '1:0')", lambda o: ranges.delete(o, "grp", ["0:0", "1:0"]))
_add("get_empty_groups", f"{OCC} SELECT DISTINCT grp FROM occ WHERE grp NOT IN (SELECT grp FROM occ WHERE label LIKE '%#11%')", lambda o: ranges.missing(o, "grp", o.where("label like '%#11%'")))
_add("get_rangeless_labels", f"{OCC} SELECT DISTINCT label FROM occ WHERE label NOT IN (SELECT label FROM occ WHERE grp LIKE '0:%')", lambda o: ranges.missing(o, "label", o.where("grp like '0:%'")))
_LEAST = "(SELECT min(label) FROM occ)"
_add("get_groups_without_label_as_hash", f"{OCC} SELECT DISTINCT grp FROM occ WHERE grp NOT IN (SELECT grp FROM occ WHERE label = 'Brand#11:PROMO')", lambda o: ranges.groups_without(o, "Brand#11:PROMO"))
_add("get_labels_not_in_group", f"{OCC} SELECT DISTINCT label FROM occ WHERE label NOT IN (SELECT label FROM occ WHERE grp = '0:0')", lambda o: ranges.labels_without(o, "0:0"))
_add("get_element_hash_that_pass_def_query", f"{GROUPS} SELECT grp FROM gps WHERE richness > 60 AND x = 0", lambda o: cube.groups(o).where("richness > 60 and x = 0").select("grp"))
_add(
    "get_groups_that_pass_def_query", f"{GROUPS} SELECT c.grp AS proc, count(*) AS n_nbrs FROM gps c JOIN gps b ON abs(c.x - b.x) <= 1 AND abs(c.y - b.y) <= 1 WHERE c.richness > 60 GROUP BY 1",
    lambda o: conditions.neighbours(cube.groups(o), conditions.square(2), conditions.richness_greater_than(60)).groupBy("proc").agg(F.count("*").alias("n_nbrs")),
)
_add("get_list_intersection", f"{OCC} SELECT label FROM occ WHERE grp = '0:0' INTERSECT SELECT label FROM occ WHERE grp = '1:0'", lambda o: o.where("grp = '0:0'").select("label").intersect(o.where("grp = '1:0'").select("label")))
_add(
    "get_shared_hash_keys", f"{OCC} SELECT a.label, a.n AS n1, b.n AS n2 FROM occ a JOIN occ b USING (label) WHERE a.grp = '0:0' AND b.grp = '0:1'",
    lambda o: o.where("grp = '0:0'").select("label", F.col("n").alias("n1")).join(o.where("grp = '0:1'").select("label", F.col("n").alias("n2")), "label"),
)
_add("get_unique_element_axis_values", f"{OCC} SELECT DISTINCT split_part(label, ':', 1) AS value FROM occ", lambda o: ranges.axis_values(o, "label", 0))
_XY = "CAST(split_part(grp, ':', 1) AS DOUBLE) AS x, CAST(split_part(grp, ':', 2) AS DOUBLE) AS y"
_add("get_label_range_bbox_2d", f"{OCC}, p AS (SELECT label, {_XY} FROM occ) SELECT label, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM p GROUP BY 1", ranges.bounds)
_add("get_groups_in_circle", f"{GROUPS} SELECT grp FROM gps WHERE pow(x - 1, 2) + pow(y + 2, 2) <= 6.25", lambda o: ranges.within_circle(cube.groups(o), 1, -2, 2.5))
_POLY = [(-0.5, -5.5), (3.5, -5.5), (3.5, 2.5)]
_add("get_groups_in_polygon", f"{GROUPS} SELECT grp FROM gps WHERE x > -0.5 AND x < 3.5 AND y > -5.5 AND y + 5.5 < 2e0 * (x + 0.5)", lambda o: ranges.within_polygon(cube.groups(o), _POLY))

# ---- statistics

_add("variance", f"{OCC} SELECT grp, round(coalesce(var_samp(n), 0), 6) AS variance FROM occ GROUP BY 1", lambda o: o.groupBy("grp").agg(F.round(stats.sd(F.col("n")) ** 2, 6).alias("variance")))
_RANK = "list_extract(list_sort(list(n)), CAST(floor(0.5 + (count(*) - 1) * {0} / 100.0) AS BIGINT) + 1)"
_WEIGHTED = lambda o, p=(): properties.weighted_stats(o.select("grp", F.col("n").alias("v"), F.lit(1).alias("w")), ["grp"], p)
_add("percentile", f"{OCC} SELECT grp, {_RANK.format(30)} AS p30 FROM occ GROUP BY 1", lambda o: _WEIGHTED(o, (30,)).select("grp", F.col("q30").alias("p30")))
_add("percentiles", f"{OCC} SELECT grp, {', '.join(f'{_RANK.format(p)} AS p{p}' for p in (5, 25, 50, 95))} FROM occ GROUP BY 1", lambda o: _WEIGHTED(o, (5, 25, 50, 95)).select("grp", *[F.col(f"q{p}").alias(f"p{p}") for p in (5, 25, 50, 95)]))
_add("iqr", f"{OCC} SELECT grp, {_RANK.format(75)} - {_RANK.format(25)} AS iqr FROM occ GROUP BY 1", lambda o: _WEIGHTED(o).select("grp", "iqr"))
_add("standard_deviation", f"{OCC} SELECT label, round(coalesce(stddev_samp(n), 0), 8) AS sd FROM occ GROUP BY 1", lambda o: o.groupBy("label").agg(F.round(stats.sd(F.col("n")), 8).alias("sd")))
_add("skewness", f"{OCC} SELECT grp, round(CASE WHEN count(*) > 2 AND stddev_samp(n) > 0 THEN skewness(n) END, 6) AS skew FROM occ GROUP BY 1", lambda o: o.groupBy("grp").agg(F.round(stats.skewness(F.col("n")), 6).alias("skew")))
_add("kurtosis", f"{OCC} SELECT grp, round(CASE WHEN count(*) > 3 AND stddev_samp(n) > 0 THEN kurtosis(n) END, 6) AS kurt FROM occ GROUP BY 1", lambda o: o.groupBy("grp").agg(F.round(stats.kurtosis(F.col("n")), 6).alias("kurt")))
for _name, _largest, _f in (("maxdex", True, "max"), ("mindex", False, "min")):
    _add(
        _name, f"{OCC}, l AS (SELECT grp, list(n ORDER BY label) AS v FROM occ GROUP BY 1) SELECT grp, CAST(list_position(v, list_{_f}(v)) - 1 AS INT) AS place FROM l",
        lambda o, largest=_largest: o.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "n"))), lambda x: x["n"]).alias("v")).select("grp", ranges.first_at(F.col("v"), largest).alias("place")),
    )
_add("get_list_value_stats", f"{OCC}{LABELS}, w AS (SELECT grp, 1e0 / r AS v FROM occ JOIN labs USING (label)) SELECT grp, round(avg(v), 8) AS mean, round(coalesce(stddev_samp(v), 0), 8) AS sd, round(min(v), 8) AS min, round(max(v), 8) AS max, round(sum(v), 8) AS total, count(*) AS n FROM w GROUP BY 1", lambda o: _list_stats(o))


def _list_stats(occ: DataFrame) -> DataFrame:
    v = occ.join(cube.labels(occ).select("label", "range"), "label").withColumn("v", 1.0 / F.col("range"))
    r = lambda c, n: F.round(c, 8).alias(n)
    return v.groupBy("grp").agg(r(F.avg("v"), "mean"), r(stats.sd(F.col("v")), "sd"), r(F.min("v"), "min"), r(F.max("v"), "max"), r(F.sum("v"), "total"), F.count("*").alias("n"))


# ---- orders: a place is a column, as tables have none

_add("sort_by_axes", f"{GROUPS} SELECT grp, row_number() OVER (PARTITION BY x ORDER BY y) AS place FROM gps", lambda o: cube.groups(o).select("grp", F.row_number().over(Window.partitionBy("x").orderBy("y")).alias("place")))
_add("get_element_list_sorted", f"{OCC} SELECT grp, list(label ORDER BY label) AS labels FROM occ GROUP BY 1", lambda o: o.groupBy("grp").agg(F.sort_array(F.collect_list("label")).alias("labels")))

# ---- matrices

_PAIRS = f"""{OCC}, v AS (SELECT grp, count(*) AS v FROM occ GROUP BY 1), sh AS (SELECT x.grp AS e1, y.grp AS e2, count(*) AS a FROM occ x JOIN occ y ON x.label = y.label AND x.grp < y.grp GROUP BY 1, 2),
  mx AS (SELECT p.grp AS e1, q.grp AS e2, round(1 - 2e0 * coalesce(a, 0) / (p.v + q.v), 8) AS value FROM v p JOIN v q ON p.grp < q.grp LEFT JOIN sh ON e1 = p.grp AND e2 = q.grp)"""
_mx = lambda o: cluster.pair_matrix(o, "SORENSON")
_add("get_min_value", f"{_PAIRS} SELECT min(value) AS value FROM mx", lambda o: _mx(o).agg(F.min("value").alias("value")))
_add("get_max_value", f"{_PAIRS} SELECT max(value) AS value FROM mx", lambda o: _mx(o).agg(F.max("value").alias("value")))
_add("get_element_pairs_with_value", f"{_PAIRS} SELECT e1, e2 FROM mx WHERE round(value, 2) = 0.5", lambda o: _mx(o).where("round(value, 2) = 0.5").select("e1", "e2"))
_add("get_summary_stats", f"{_PAIRS}, s AS (SELECT value AS n FROM mx) SELECT max(n) AS mx, min(n) AS mn, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, {_RANK.format(2.5)} AS pct025, {_RANK.format(5)} AS pct05, {_RANK.format(95)} AS pct95, {_RANK.format(97.5)} AS pct975 FROM s", lambda o: _summary(_mx(o)))
_add("matrix_trim", f"{_PAIRS} SELECT * FROM mx WHERE e1 LIKE '0:%' AND e2 LIKE '0:%'", lambda o: _mx(o).where("e1 like '0:%' and e2 like '0:%'"))
_add("delete_all_pairs_with_element", f"{_PAIRS} SELECT * FROM mx WHERE e1 <> '0:0' AND e2 <> '0:0'", lambda o: _mx(o).where("e1 <> '0:0' and e2 <> '0:0'"))
_add("to_table_sparse", f"{_PAIRS} SELECT e1 AS element, e2 AS element2, value FROM mx UNION ALL SELECT e2, e1, value FROM mx", lambda o: _mx(o).select(F.col("e1").alias("element"), F.col("e2").alias("element2"), "value").union(_mx(o).select("e2", "e1", "value")))
_add("to_table_gdm", f"{_PAIRS} SELECT CAST(split_part(e1, ':', 1) AS DOUBLE) AS x1, CAST(split_part(e1, ':', 2) AS DOUBLE) AS y1, CAST(split_part(e2, ':', 1) AS DOUBLE) AS x2, CAST(split_part(e2, ':', 2) AS DOUBLE) AS y2, value FROM mx", lambda o: _mx(o).select(*[F.split(e, ":")[i].cast("double").alias(f"{'xy'[i]}{k}") for k, e in ((1, "e1"), (2, "e2")) for i in (0, 1)], "value"))
_add("to_table_normal", f"{_PAIRS}, both_ AS (SELECT e1, e2, value FROM mx UNION ALL SELECT e2, e1, value FROM mx) SELECT e1 AS element, list(e2 ORDER BY e2) AS columns, list(value ORDER BY e2) AS vals FROM both_ GROUP BY 1", lambda o: _normal(_mx(o)))


def _summary(mx: DataFrame) -> DataFrame:
    values = mx.select(F.lit(0).alias("k"), F.col("value").alias("v"), F.lit(1).alias("w"))
    rows = properties.weighted_stats(values, ["k"], (2.5, 5, 95, 97.5))
    names = {"q2.5": "pct025", "q5": "pct05", "q95": "pct95", "q97.5": "pct975"}
    return rows.select(F.col("max").alias("mx"), F.col("min").alias("mn"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def _normal(mx: DataFrame) -> DataFrame:
    both = mx.union(mx.select("e2", "e1", "value"))
    rows = both.groupBy(F.col("e1").alias("element")).agg(F.sort_array(F.collect_list(F.struct("e2", "value"))).alias("r"))
    return rows.select("element", F.transform("r", lambda x: x["e2"]).alias("columns"), F.transform("r", lambda x: x["value"]).alias("vals"))


# ---- the spatial index

_add("snap_to_index", f"{GROUPS} SELECT grp, CAST(floor(x / 3e0) AS BIGINT) AS bx, CAST(floor(y / 3e0) AS BIGINT) AS by_ FROM gps", lambda o: cube.groups(o).select("grp", cube.bin_index(F.col("x"), 3).alias("bx"), cube.bin_index(F.col("y"), 3).alias("by_")))
_add("get_index_elements", f"{GROUPS} SELECT CAST(floor(x / 3e0) AS BIGINT) AS bx, CAST(floor(y / 3e0) AS BIGINT) AS by_, list(grp ORDER BY grp) AS grps FROM gps GROUP BY 1, 2", lambda o: cube.groups(o).groupBy(cube.bin_index(F.col("x"), 3).alias("bx"), cube.bin_index(F.col("y"), 3).alias("by_")).agg(F.sort_array(F.collect_list("grp")).alias("grps")))
_add(
    "predict_offsets",
    f"{GROUPS}, i AS (SELECT *, floor(x / 3e0) AS bx, floor(y / 3e0) AS by_ FROM gps) SELECT DISTINCT CAST(b.bx - c.bx AS BIGINT) AS dx, CAST(b.by_ - c.by_ AS BIGINT) AS dy FROM i c JOIN i b ON sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2)) <= 2.5",
    lambda o: _offsets(cube.groups(o)),
)


def _offsets(groups: DataFrame) -> DataFrame:
    at = groups.select("grp", cube.bin_index(F.col("x"), 3).alias("bx"), cube.bin_index(F.col("y"), 3).alias("by_"))
    pairs = conditions.neighbours(groups, conditions.circle(2.5))
    rows = pairs.join(at.select(F.col("grp").alias("proc"), F.col("bx").alias("cx"), F.col("by_").alias("cy")), "proc").join(at, "grp")
    return rows.select((F.col("bx") - F.col("cx")).alias("dx"), (F.col("by_") - F.col("cy")).alias("dy")).distinct()


_add("get_distances", f"{NBRS} SELECT proc, nbrs.grp, abs(c.x - b.x) AS d0, abs(c.y - b.y) AS d1, round(sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2)), 10) AS d, round(sqrt(pow((c.x - b.x) / 2e0, 2) + pow((c.y - b.y) / 3e0, 2)), 10) AS c FROM nbrs JOIN gps c ON c.grp = proc JOIN gps b ON b.grp = nbrs.grp", lambda o: _distances(o))


def _distances(occ: DataFrame) -> DataFrame:
    """Map distances, and those that count cells of 2 by 3."""
    g = cube.groups(occ).select("grp", "x", "y")
    pairs = conditions.neighbours(cube.groups(occ), conditions.circle(1)).join(g.select(F.col("grp").alias("proc"), F.col("x").alias("cx"), F.col("y").alias("cy")), "proc").join(g, "grp")
    u, v = F.abs(F.col("cx") - F.col("x")), F.abs(F.col("cy") - F.col("y"))
    root = lambda a, b: F.round(F.sqrt(a * a + b * b), 10)
    return pairs.select("proc", "grp", u.alias("d0"), v.alias("d1"), root(u, v).alias("d"), root(u / 2, v / 3).alias("c"))


@register("get_nbrs_for_element", f"{NBRS} SELECT grp, s AS nbr_set FROM nbrs WHERE proc = '1:0'")
def get_nbrs_for_element(spark, sf_dir):
    return base_cube(spark, sf_dir)[1].where("proc = '1:0'").select("grp", F.col("set").alias("nbr_set"))


@register("get_recyclable_nbrhoods", f"{GROUPS}, b AS (SELECT c.grp AS proc, list(b.grp ORDER BY b.grp) AS members FROM gps c JOIN gps b ON floor(c.x / 3e0) = floor(b.x / 3e0) AND floor(c.y / 3e0) = floor(b.y / 3e0) GROUP BY 1) SELECT members, min(proc) AS first, count(*) AS n FROM b GROUP BY 1")
def get_recyclable_nbrhoods(spark, sf_dir):
    """Centres whose neighbourhoods have the same members, which need one calculation."""
    pairs = conditions.neighbours(cube.groups(shared(spark, sf_dir)[0]), conditions.block(3))
    sets = pairs.groupBy("proc").agg(F.sort_array(F.collect_list("grp")).alias("members"))
    return sets.groupBy("members").agg(F.min("proc").alias("first"), F.count("*").alias("n"))


# ---- more conditions

_NEAR = "SELECT c.grp AS proc, count(*) AS n_nbrs FROM gps c JOIN gps b ON {0} GROUP BY 1"
_SHAPES = [[(-0.5, -3.5), (1.5, -3.5), (1.5, 3.5), (-0.5, 3.5)], [(1.5, -9.5), (9.5, -9.5), (9.5, 0.5), (1.5, 0.5)]]
_IN = "CASE WHEN {0}.x BETWEEN 0 AND 1 AND {0}.y BETWEEN -3 AND 3 THEN 0 WHEN {0}.x BETWEEN 2 AND 9 AND {0}.y BETWEEN -9 AND 0 THEN 1 END"
_CLUSTER = "CASE WHEN {0}.x % 3 < 2 THEN {0}.x % 3 END"
_MORE = {
    "sp_circle_cell": (lambda o: conditions.circle_cell(1, (2, 3)), "sqrt(pow((c.x - b.x) / 2e0, 2) + pow((c.y - b.y) / 3e0, 2)) <= 1"),
    "sp_square_cell": (lambda o: conditions.square_cell(2, (2, 3)), "abs(c.x - b.x) <= 2 AND abs(c.y - b.y) <= 3"),
    "sp_point_in_poly_shape": (lambda o: conditions.in_polygon(_SHAPES[0]), "b.x BETWEEN 0 AND 1 AND b.y BETWEEN -3 AND 3"),
    "sp_points_in_same_poly_shape": (lambda o: conditions.same_polygon(_SHAPES), f"{_IN.format('c')} = {_IN.format('b')}"),
    "sp_in_label_range": (lambda o: conditions.among(o.where("label = 'Brand#11:PROMO'")), "b.grp IN (SELECT grp FROM occ WHERE label = 'Brand#11:PROMO')"),
    "sp_in_label_ancestor_range": (lambda o: conditions.among(o.where("label like 'Brand#11:%'")), "b.grp IN (SELECT grp FROM occ WHERE label LIKE 'Brand#11:%')"),
    "sp_in_assemblage_range": (lambda o: conditions.among(o.join(o.where("grp = '0:0'").select("label"), "label", "left_semi")), "b.grp IN (SELECT grp FROM occ WHERE label IN (SELECT label FROM occ WHERE grp = '0:0'))"),
    "sp_spatial_output_passed_defq": (lambda o: conditions.among(cube.groups(o).where("samples > 1000")), "b.samples > 1000"),
    "sp_get_spatial_output_list_value": (lambda o: conditions.among(_list_stats(o).where("total > 0.5")), "b.grp IN (SELECT grp FROM occ JOIN (SELECT label, count(*) AS r FROM occ GROUP BY 1) USING (label) GROUP BY 1 HAVING sum(1e0 / r) > 0.5)"),
    "sp_point_in_cluster": (lambda o: conditions.among(cube.groups(o).where("x % 3 = 1")), "b.x % 3 = 1"),
    "sp_points_in_same_cluster": (lambda o: conditions.same_key(cube.groups(o).where("x % 3 < 2").select("grp", (F.col("x") % 3).alias("key"))), f"{_CLUSTER.format('c')} IS NOT DISTINCT FROM {_CLUSTER.format('b')}"),
}
for _name, (_condition, _sql) in _MORE.items():
    _add(_name, f"{GROUPS} {_NEAR.format(_sql)}", lambda o, c=_condition: conditions.counts(cube.groups(o), c(o)))


@register("get_label_range_circumcircle")
def get_label_range_circumcircle(spark, sf_dir):
    return ranges.circles(shared(spark, sf_dir)[0])


@register("get_label_range_hull")
def get_label_range_hull(spark, sf_dir):
    return ranges.hulls(shared(spark, sf_dir)[0])
