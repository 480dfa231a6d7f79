"""Registered calculations over properties, numeric labels and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import properties
from quadrat.plans.registry import ABC, GROUPS, LABELS, NBRS, base_cube, register, shared


def label_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIZE of every label, PRICE of those with an even SIZE."""
    part = cube.table(spark, sf_dir, "part").groupBy(F.concat_ws(":", "p_brand", "p_type").alias("label")).agg(F.floor(F.avg("p_size")).cast("double").alias("SIZE"), F.floor(F.avg("p_retailprice") / 100).cast("double").alias("price"))
    rows = part.select("label", "SIZE", F.when(F.col("SIZE") % 2 == 0, F.col("price")).alias("PRICE"))
    return rows.unpivot("label", ["SIZE", "PRICE"], "prop", "value").where("value is not null")


def group_properties(groups: DataFrame) -> DataFrame:
    """ROW: the second axis; ROOT: the floor of the root of the samples, of groups with an even first axis."""
    rows = groups.select("grp", F.col("y").cast("double").alias("ROW"), F.when(F.col("x") % 2 == 0, F.floor(F.sqrt("samples")).cast("double")).alias("ROOT"))
    return rows.unpivot("grp", ["ROW", "ROOT"], "prop", "value").where("value is not null")


_LB = """, sizes AS (SELECT p_brand || ':' || p_type AS label, CAST(floor(avg(p_size)) AS DOUBLE) AS s, CAST(floor(avg(p_retailprice) / 100) AS DOUBLE) AS p FROM part GROUP BY 1),
  lb AS (SELECT label, 'SIZE' AS prop, s AS value FROM sizes UNION ALL SELECT label, 'PRICE', p FROM sizes WHERE CAST(s AS BIGINT) % 2 = 0)"""
_GP = ", gp AS (SELECT grp, 'ROW' AS prop, CAST(y AS DOUBLE) AS value FROM gps UNION ALL SELECT grp, 'ROOT', floor(sqrt(samples)) FROM gps WHERE x % 2 = 0)"
_VALUES = {
    "lbprop": ABC + _LB + ", vals AS (SELECT proc, prop, label AS el, value AS v, 1 AS w FROM abc JOIN lb USING (label)), each AS (SELECT * FROM vals)",
    "lbprop_abc2": ABC + _LB + ", vals AS (SELECT proc, prop, label AS el, value AS v, g1 + g2 AS w FROM abc JOIN lb USING (label)), each AS (SELECT proc, prop, el, v, 1 AS w, unnest(range(w)) FROM vals)",
    "gpprop": NBRS + _GP + ", vals AS (SELECT proc, prop, grp AS el, value AS v, 1 AS w FROM nbrs JOIN gp USING (grp)), each AS (SELECT * FROM vals)",
}


def _values(spark, sf_dir, kind: str) -> DataFrame:
    occ, nbrs = base_cube(spark, sf_dir)
    if kind == "gpprop":
        return properties.group_values(nbrs, group_properties(cube.groups(occ)))
    return properties.label_values(occ, nbrs, label_properties(spark, sf_dir), kind.endswith("abc2"))


_RANK = "list_extract(list_sort(list(v)), CAST(floor(0.5 + (count(*) - 1) * {0} / 100.0) AS BIGINT) + 1)"
_STATS = {
    "COUNT": ("n", "count(*)"), "MEAN": ("mean", "avg(v)"), "MIN": ("min", "min(v)"), "MAX": ("max", "max(v)"), "MEDIAN": ("median", "median(v)"), "SUM": ("total", "sum(v)"),
    "SKEWNESS": ("skew", "CASE WHEN count(*) > 2 AND stddev_samp(v) > 1e-6 THEN skewness(v) END"), "KURTOSIS": ("kurt", "CASE WHEN count(*) > 3 AND stddev_samp(v) > 1e-6 THEN kurtosis(v) END"),
    "SD": ("sd", "coalesce(stddev_samp(v), 0)"), "IQR": ("iqr", f"{_RANK.format(75)} - {_RANK.format(25)}"),
}
_GLOBAL = {
    "lbprop": "SELECT prop, avg(value) AS m, stddev_samp(value) AS sd, CAST(count(*) AS DOUBLE) AS n FROM labs JOIN lb USING (label) GROUP BY 1",
    "lbprop_abc2": "SELECT prop, sum(value * r) / sum(r) AS m, sqrt((sum(value * value * r) - sum(value * r) * sum(value * r) / sum(r)) / (sum(r) - 1)) AS sd, CAST(sum(r) AS DOUBLE) AS n FROM labs JOIN lb USING (label) GROUP BY 1",
    "gpprop": "SELECT prop, avg(value) AS m, stddev_samp(value) AS sd, CAST(count(*) AS DOUBLE) AS n FROM gp GROUP BY 1",
}


def _register_properties(kind: str) -> None:
    base, suffix = kind.removesuffix("_abc2"), "_abc2" if kind.endswith("abc2") else ""
    stats = {k: v for k, v in _STATS.items() if base == "lbprop" or k not in ("SKEWNESS", "KURTOSIS")}

    @register(f"calc_{base}_stats{suffix}", f"{_VALUES[kind]} SELECT proc, prop, {', '.join(f'round(CAST({e} AS DOUBLE), 6) AS {n}' for n, (_, e) in stats.items())} FROM each GROUP BY 1, 2")
    def _stats(spark, sf_dir):
        rows = properties.weighted_stats(_values(spark, sf_dir, kind), ["proc", "prop"])
        return rows.select("proc", "prop", *[F.round(c, 6).alias(n) for n, (c, _) in stats.items()])

    @register(f"calc_{base}_quantiles{suffix}", f"{_VALUES[kind]} SELECT proc, prop, {', '.join(f'{_RANK.format(p)} AS Q{p:02d}' for p in properties.QUANTILES)} FROM each GROUP BY 1, 2")
    def _quantiles(spark, sf_dir):
        rows = properties.weighted_stats(_values(spark, sf_dir, kind), ["proc", "prop"], properties.QUANTILES)
        return rows.select("proc", "prop", *[F.col(f"q{p}").alias(f"Q{p:02d}") for p in properties.QUANTILES])

    @register(f"calc_{base}_hashes{suffix}", f"{_VALUES[kind]} SELECT proc, prop, v, CAST(count(*) AS BIGINT) AS w FROM each GROUP BY 1, 2, 3")
    def _hashes(spark, sf_dir):
        return properties.value_counts(_values(spark, sf_dir, kind)).select("proc", "prop", "v", F.col("w").cast("long").alias("w"))

    @register(
        f"calc_{base}_gistar{suffix}",
        f"""{_VALUES[kind]}, whole_ AS ({_GLOBAL[kind]}), loc_ AS (SELECT proc, prop, sum(v) AS s, CAST(count(*) AS DOUBLE) AS k FROM each GROUP BY 1, 2)
  SELECT proc, prop, round(coalesce((s - k * m) / nullif(sd * sqrt(greatest((n * k - k * k) / (n - 1), 0)), 0), 0), 6) AS GISTAR FROM loc_ JOIN whole_ USING (prop)""",
    )
    def _gistar(spark, sf_dir):
        occ = base_cube(spark, sf_dir)[0]
        if base == "gpprop":
            groups = cube.groups(occ)
            whole = properties.summary(groups, "grp", group_properties(groups))
        else:
            whole = properties.summary(cube.labels(occ), "label", label_properties(spark, sf_dir), F.col("range") if suffix else None)
        return properties.gistar(_values(spark, sf_dir, kind), whole).select("proc", "prop", F.round("gistar", 6).alias("GISTAR"))


for _kind in _VALUES:
    _register_properties(_kind)


@register("calc_lbprop_lists", f"{_VALUES['lbprop']} SELECT proc, prop, el AS label, v AS value FROM vals")
def calc_lbprop_lists(spark, sf_dir):
    return _values(spark, sf_dir, "lbprop").select("proc", "prop", "label", F.col("v").alias("value"))


@register("calc_lbprop_data", f"{_VALUES['lbprop']} SELECT proc, prop, list_sort(list(v)) AS data FROM each GROUP BY 1, 2")
def calc_lbprop_data(spark, sf_dir):
    return properties.expanded(_values(spark, sf_dir, "lbprop"), ["proc", "prop"])


@register("calc_gpprop_lists", f"{_VALUES['gpprop']} SELECT proc, prop, list_sort(list(v)) AS data FROM each GROUP BY 1, 2")
def calc_gpprop_lists(spark, sf_dir):
    return properties.expanded(_values(spark, sf_dir, "gpprop"), ["proc", "prop"])


@register("get_element_properties_summary_stats", f"{GROUPS}{LABELS}{_LB} SELECT prop, round(sum(value * r) / sum(r), 6) AS mean, round(sum(value * r), 6) AS total, round(sqrt((sum(value * value * r) - sum(value * r) * sum(value * r) / sum(r)) / (sum(r) - 1)), 6) AS sd, CAST(sum(r) AS DOUBLE) AS n FROM labs JOIN lb USING (label) GROUP BY 1")
def get_element_properties_summary_stats(spark, sf_dir):
    rows = properties.summary(cube.labels(shared(spark, sf_dir)[0]), "label", label_properties(spark, sf_dir), F.col("range"))
    return rows.select("prop", *[F.round(c, 6).alias(c) for c in ("mean", "total", "sd")], "n")


@register("assign_element_properties", f"{GROUPS}{LABELS}{_LB} SELECT label, prop, CASE WHEN prop = 'SIZE' AND label LIKE '%#1%' THEN -1 ELSE value END AS value FROM lb UNION ALL SELECT label, 'RANGE', CAST(r AS DOUBLE) FROM labs")
def assign_element_properties(spark, sf_dir):
    props = label_properties(spark, sf_dir)
    fixed = props.where("prop = 'SIZE' and label like '%#1%'").withColumn("value", F.lit(-1.0))
    ranges = cube.labels(shared(spark, sf_dir)[0]).select("label", F.lit("RANGE").alias("prop"), F.col("range").cast("double").alias("value"))
    return properties.assign(props, "label", fixed.unionByName(ranges))


@register("transfer_element_properties", f"{GROUPS}{_LB} SELECT label, prop, value FROM lb WHERE label IN (SELECT label FROM occ WHERE grp LIKE '1:%')")
def transfer_element_properties(spark, sf_dir):
    return properties.transfer(label_properties(spark, sf_dir), "label", shared(spark, sf_dir)[0].where("grp like '1:%'"))


@register("attach_label_ranges_as_properties", f"{GROUPS}{LABELS} SELECT label, 'RANGE' AS prop, CAST(r AS DOUBLE) AS value FROM labs")
def attach_label_ranges_as_properties(spark, sf_dir):
    return cube.labels(shared(spark, sf_dir)[0]).select("label", F.lit("RANGE").alias("prop"), F.col("range").cast("double").alias("value"))


@register("attach_label_abundances_as_properties", f"{GROUPS}{LABELS} SELECT label, 'ABUNDANCE' AS prop, a AS value FROM labs")
def attach_label_abundances_as_properties(spark, sf_dir):
    return cube.labels(shared(spark, sf_dir)[0]).select("label", F.lit("ABUNDANCE").alias("prop"), F.col("abundance").alias("value"))


# ---- numeric labels: sizes of parts, by the cells of the canonical cube


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = cube.table(spark, sf_dir, "lineitem"), cube.table(spark, sf_dir, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    months = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return cube.from_records(rows, [cube.bin_index(F.col("l_suppkey"), 5), cube.bin_index(months, 6)], [F.col("p_size")], F.col("l_quantity")).select("grp", F.col("label").cast("double").alias("v"), F.col("n").alias("w"))


_NUMBERS = NBRS + """, num AS (SELECT CAST(floor(l_suppkey / 5) AS BIGINT) || ':' || CAST(floor(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) / 6) AS BIGINT) AS grp, CAST(p_size AS DOUBLE) AS v, sum(l_quantity) AS w
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  nv AS (SELECT proc, s, v, sum(w) AS w FROM nbrs JOIN num USING (grp) GROUP BY 1, 2, 3),
  one AS (SELECT proc, v, sum(w) AS w FROM nv GROUP BY 1, 2), mm AS (SELECT proc, sum(w) AS n, sum(w * v) / sum(w) AS m FROM one GROUP BY 1),
  mo AS (SELECT proc, max(n) AS n, max(m) AS m, sum(w * pow(v - m, 2)) AS m2, sum(w * pow(v - m, 3)) AS m3, sum(w * pow(v - m, 4)) AS m4, min(v) AS lo, max(v) AS hi, sum(w / v) AS h, sum(w * ln(v)) AS g FROM one JOIN mm USING (proc) GROUP BY 1)"""  # fmt: skip


@register(
    "calc_numeric_label_stats",
    f"""{_NUMBERS} SELECT proc, n AS NUM_N, round(m, 6) AS NUM_MEAN, round(sqrt(m2 / (n - 1)), 6) AS NUM_SD, lo AS NUM_MIN, hi AS NUM_MAX, hi - lo AS NUM_RANGE, round(sqrt(m2 / (n - 1)) / m, 6) AS NUM_CV,
  round(n / ((n - 1) * (n - 2)) * m3 / pow(m2 / (n - 1), 1.5), 6) AS NUM_SKEW, round(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * m4 / pow(m2 / (n - 1), 2) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)), 6) AS NUM_KURT FROM mo""",
)
def calc_numeric_label_stats(spark, sf_dir):
    rows = properties.weighted_stats(properties.numeric_values(_numbers(spark, sf_dir), shared(spark, sf_dir)[1]), ["proc"])
    names = {"mean": "NUM_MEAN", "sd": "NUM_SD", "skew": "NUM_SKEW", "kurt": "NUM_KURT"}
    return rows.select("proc", F.col("n").alias("NUM_N"), *[F.col(c).alias(f"NUM_{c.upper()}") for c in ("min", "max", "range")], *[F.round(c, 6).alias(n) for c, n in names.items()], F.round(F.try_divide(F.col("sd"), F.col("mean")), 6).alias("NUM_CV"))


@register("calc_numeric_label_other_means", f"{_NUMBERS} SELECT proc, round(n / h, 6) AS NUM_HMEAN, round(exp(g / n), 6) AS NUM_GMEAN FROM mo")
def calc_numeric_label_other_means(spark, sf_dir):
    rows = properties.weighted_stats(properties.numeric_values(_numbers(spark, sf_dir), shared(spark, sf_dir)[1]), ["proc"])
    return rows.select("proc", F.round("hmean", 6).alias("NUM_HMEAN"), F.round("gmean", 6).alias("NUM_GMEAN"))


_FIVES = range(5, 100, 5)


@register(
    "calc_numeric_label_quantiles",
    f"""{_NUMBERS}, cu AS (SELECT proc, v, sum(w) OVER (PARTITION BY proc ORDER BY v) AS upto, sum(w) OVER (PARTITION BY proc) AS n FROM one)
  SELECT proc, {', '.join(f'min(v) FILTER (upto >= floor(0.5 + (n - 1) * {p} / 100) + 1) AS NUM_Q{p:03d}' for p in _FIVES)} FROM cu GROUP BY 1""",
)
def calc_numeric_label_quantiles(spark, sf_dir):
    rows = properties.weighted_stats(properties.numeric_values(_numbers(spark, sf_dir), shared(spark, sf_dir)[1]), ["proc"], _FIVES)
    return rows.select("proc", *[F.col(f"q{p}").alias(f"NUM_Q{p:03d}") for p in _FIVES])


@register("calc_numeric_label_data", f"{_NUMBERS} SELECT grp, list_sort(list(v)) AS NUM_DATA_ARRAY FROM (SELECT grp, v, unnest(range(CAST(w AS BIGINT))) FROM num) GROUP BY 1")
def calc_numeric_label_data(spark, sf_dir):
    return properties.expanded(_numbers(spark, sf_dir), ["grp"]).select("grp", F.col("data").alias("NUM_DATA_ARRAY"))


@register(
    "calc_numeric_label_dissimilarity",
    f"""{_NUMBERS}, pr AS (SELECT a.proc, sum(a.w * b.w) AS n, sum(a.w * b.w * abs(a.v - b.v)) AS x, sum(a.w * b.w * (a.v - b.v) * (a.v - b.v)) AS q FROM nv a JOIN nv b ON a.proc = b.proc AND a.s = 1 AND b.s = 2 GROUP BY 1)
  SELECT mm.proc, round(x / pr.n, 6) AS NUMD_ABSMEAN, round(q / pr.n, 6) AS NUMD_VARIANCE, pr.n AS NUMD_COUNT FROM mm LEFT JOIN pr ON mm.proc = pr.proc""",
)
def calc_numeric_label_dissimilarity(spark, sf_dir):
    rows = properties.numeric_dissimilarity(properties.numeric_values(_numbers(spark, sf_dir), shared(spark, sf_dir)[1]))
    return rows.select("proc", F.round("absmean", 6).alias("NUMD_ABSMEAN"), F.round("variance", 6).alias("NUMD_VARIANCE"), F.col("pairs").alias("NUMD_COUNT"))


# ---- a label matrix: differences of size within a brand


def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = label_properties(spark, sf_dir).where("prop = 'SIZE'").select("label", F.split("label", ":")[0].alias("brand"), F.col("value").alias("s"))
    return size.alias("a").join(size.alias("b"), F.expr("a.brand = b.brand and a.label < b.label")).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.abs(F.col("a.s") - F.col("b.s")).alias("value"))


_MX = ABC + _LB + """, mx AS (SELECT a.label AS a, b.label AS b, abs(a.s - b.s) AS value FROM sizes a JOIN sizes b ON split_part(a.label, ':', 1) = split_part(b.label, ':', 1) AND a.label < b.label),
  inmx AS (SELECT a AS label FROM mx UNION SELECT b FROM mx),
  each AS (SELECT x.proc, value AS v FROM mx JOIN abc x ON mx.a = x.label JOIN abc y ON mx.b = y.label AND x.proc = y.proc)"""


@register("calc_matrix_stats", f"{_MX} SELECT proc, {', '.join(f'round(CAST({e} AS DOUBLE), 6) AS MX_{n}' for n, (_, e) in {**{k: v for k, v in _STATS.items() if k not in ('SUM', 'IQR')}, **{f'PCT{p:02d}': ('', _RANK.format(p)) for p in (5, 25, 75, 95)}, 'RANGE': ('', 'max(v) - min(v)')}.items())} FROM each GROUP BY 1")
def calc_matrix_stats(spark, sf_dir):
    values = properties.matrix_values(*base_cube(spark, sf_dir), label_matrix(spark, sf_dir)).select("proc", F.col("value").alias("v"), F.lit(1).alias("w"))
    rows = properties.weighted_stats(values, ["proc"], (5, 25, 75, 95))
    names = {n: c for n, (c, _) in _STATS.items() if n not in ("SUM", "IQR")} | {f"PCT{p:02d}": f"q{p}" for p in (5, 25, 75, 95)} | {"RANGE": "range"}
    return rows.select("proc", *[F.round(c, 6).alias(f"MX_{n}") for n, c in names.items()])


@register(
    "calc_compare_dissim_matrix_values",
    f"""{_MX}, l AS (SELECT abc.* FROM abc JOIN inmx USING (label)), pr AS (SELECT x.proc, coalesce(value, 0) AS v FROM l x JOIN l y ON x.proc = y.proc AND x.g1 > 0 AND y.g2 > 0
    LEFT JOIN mx ON mx.a = least(x.label, y.label) AND mx.b = greatest(x.label, y.label) AND x.label <> y.label)
  SELECT p.proc, round(avg(v), 6) AS MXD_MEAN, round(avg(v * v), 6) AS MXD_VARIANCE, CAST(count(v) AS DOUBLE) AS MXD_COUNT FROM (SELECT DISTINCT proc FROM l) p LEFT JOIN pr ON p.proc = pr.proc GROUP BY 1""",
)
def calc_compare_dissim_matrix_values(spark, sf_dir):
    rows = properties.matrix_dissimilarity(*base_cube(spark, sf_dir), label_matrix(spark, sf_dir))
    return rows.select("proc", F.round("mean", 6).alias("MXD_MEAN"), F.round("variance", 6).alias("MXD_VARIANCE"), F.col("pairs").alias("MXD_COUNT"))


@register("calc_mx_rao_qe", f"{_MX}, k AS (SELECT proc, CAST(count(*) AS DOUBLE) AS k FROM abc JOIN inmx USING (label) GROUP BY 1), t AS (SELECT proc, sum(v) AS t FROM each GROUP BY 1) SELECT proc, round(2 * coalesce(t, 0) / k / k, 6) AS MX_RAO_QE, k * k AS MX_RAO_TN FROM k LEFT JOIN t USING (proc)")
def calc_mx_rao_qe(spark, sf_dir):
    rows = properties.matrix_entropy(*base_cube(spark, sf_dir), label_matrix(spark, sf_dir))
    return rows.select("proc", F.round("qe", 6).alias("MX_RAO_QE"), F.col("tn").alias("MX_RAO_TN"))
