"""Registered comparisons with randomised results, and what randomisations keep.

Draws that depend on hashes can't be stated in SQL.  Comparisons therefore run
over draws by a formula, and models over what must stay: ranges and samples of
labels, values of properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import randomise, remap
from quadrat.plans.properties import group_properties
from quadrat.plans.registry import GROUPS, LABELS, OCC, register, shared

_DRAWS = 40


def _base(occ: DataFrame) -> DataFrame:
    known = occ.join(cube.labels(occ).select("label", "range"), "label")
    return known.groupBy(F.col("grp").alias("proc")).agg(F.count("*").cast("double").alias("RICHNESS"), F.sum(1 / F.col("range")).alias("WE"))


def _drawn(base: DataFrame) -> DataFrame:
    each = base.crossJoin(base.sparkSession.range(_DRAWS).select(F.col("id").cast("int").alias("iter")))
    factor = 0.58 + 0.02 * ((F.col("RICHNESS").cast("long") * 7 + F.col("iter") * 13) % 41)
    return each.select("iter", "proc", (F.col("RICHNESS") * factor).alias("RICHNESS"), (F.col("WE") * factor).alias("WE"))


def _compared(spark, sf_dir) -> DataFrame:
    base = _base(shared(spark, sf_dir)[0])
    return randomise.compare(base, _drawn(base), ["RICHNESS", "WE"])


_SQL = f"""{OCC}{LABELS}, base AS (SELECT grp AS proc, CAST(count(*) AS DOUBLE) AS rich, sum(1e0 / r) AS we FROM occ JOIN labs USING (label) GROUP BY 1),
  lng AS (SELECT proc, 'RICHNESS' AS idx, rich AS b, rich FROM base UNION ALL SELECT proc, 'WE', we, rich FROM base),
  dr AS (SELECT proc, idx, b, b * (0.58 + 0.02 * ((CAST(rich AS BIGINT) * 7 + i * 13) % 41)) AS x FROM lng, range(0, {_DRAWS}) t(i)),
  cp AS (SELECT proc, idx, max(b) AS b, count(*) FILTER (b - x > 1e-10) AS C, count(*) FILTER (abs(b - x) <= 1e-10) AS T, count(*) AS Q, avg(x) AS m, stddev_pop(x) AS sd, sum(x) AS sx, sum(x * x) AS sxx FROM dr GROUP BY 1, 2),
  rk AS (SELECT *, C / CAST(Q AS DOUBLE) AS P, (C + T) / CAST(Q AS DOUBLE) AS L FROM cp)"""
_RANK = "CASE WHEN P > 0.5 THEN P ELSE L END"


def _add(name: str, sql: str, make) -> None:
    register(name, f"{_SQL} SELECT proc, idx, {sql} FROM rk")(lambda spark, sf_dir: make(_compared(spark, sf_dir)))


_ALL = "C, T, Q, round(P, 8) AS P, round(sx, 6) AS SUMX, round(sxx, 6) AS SUMXX"
for _name in ("compare", "compare_lists_by_item"):
    _add(_name, _ALL, lambda r: r.select("proc", "idx", "C", "T", "Q", F.round("P", 8).alias("P"), F.round("SUMX", 6).alias("SUMX"), F.round("SUMXX", 6).alias("SUMXX")))
_add("get_sig_rank_from_comp_results", f"round({_RANK}, 8) AS rank", lambda r: r.select("proc", "idx", F.round(randomise.p_rank(), 8).alias("rank")))
_add(
    "get_significance_from_comp_results",
    "CASE WHEN P > 0.99 THEN 0.01 WHEN P > 0.95 THEN 0.05 WHEN L < 0.01 THEN -0.01 WHEN L < 0.05 THEN -0.05 END AS SIG_1TAIL, CASE WHEN P > 0.995 THEN 0.01 WHEN P > 0.975 THEN 0.05 WHEN L < 0.005 THEN -0.01 WHEN L < 0.025 THEN -0.05 END AS SIG_2TAIL",
    lambda r: r.select("proc", "idx", randomise.significance(1).alias("SIG_1TAIL"), randomise.significance(2).alias("SIG_2TAIL")),
)
_add(
    "get_sig_rank_threshold_from_comp_results",
    "CASE WHEN P > 0.995 THEN 0.995 WHEN P > 0.99 THEN 0.99 WHEN P > 0.975 THEN 0.975 WHEN P > 0.95 THEN 0.95 WHEN L < 0.005 THEN 0.005 WHEN L < 0.01 THEN 0.01 WHEN L < 0.025 THEN 0.025 WHEN L < 0.05 THEN 0.05 END AS threshold",
    lambda r: r.select("proc", "idx", randomise.rank_threshold().alias("threshold")),
)
_add("get_zscore_from_comp_results", "round(CASE WHEN sd > 1e-9 THEN (b - m) / sd ELSE 0 END, 5) AS z", lambda r: r.select("proc", "idx", F.round(randomise.z_score(), 5).alias("z")))


@register("reintegrate_after_parallel_randomisations", f"{_SQL} SELECT proc, idx, 2 * C AS C, 2 * T AS T, 2 * Q AS Q, round(P, 8) AS P FROM rk")
def reintegrate_after_parallel_randomisations(spark, sf_dir):
    one = _compared(spark, sf_dir)
    return randomise.reintegrate(one, one).select("proc", "idx", "C", "T", "Q", F.round("P", 8).alias("P"))


_CODES = "CASE WHEN {0} <= 0.95 AND {1} <= 0.95 THEN 0 WHEN {2} < 0.025 THEN 1 WHEN {2} > 0.975 THEN 2 WHEN {0} > 0.99 AND {1} > 0.99 THEN 4 ELSE 3 END"
_FAKE = f"{OCC}, g AS (SELECT grp AS proc, count(*) AS k FROM occ GROUP BY 1), f AS (SELECT proc, 0.9 + (k * 7 % 11) / 100.0 AS a, 0.9 + (k * 5 % 11) / 100.0 AS b, (k * 3 % 40) / 39.0 AS r FROM g)"


def _fake(spark, sf_dir) -> DataFrame:
    """Ranks by a formula."""
    k = shared(spark, sf_dir)[0].groupBy(F.col("grp").alias("proc")).agg(F.count("*").alias("k"))
    return k.select("proc", (0.9 + F.col("k") * 7 % 11 / 100).alias("a"), (0.9 + F.col("k") * 5 % 11 / 100).alias("b"), (F.col("k") * 3 % 40 / 39).alias("r"))


_FLAGS = ", ".join(f"CAST(code = {i} AS INT) AS {n}" for i, n in ((1, "NEO"), (2, "PALAEO"), (3, "MIXED"), (4, "SUPER")))
for _name in ("assign_canape_codes_from_p_rank_results", "calculate_canape"):

    @register(_name, f"{_FAKE}, c AS (SELECT proc, {_CODES.format('round(a, 6)', 'round(b, 6)', 'r')} AS code FROM f) SELECT proc, code AS CANAPE_CODE, {_FLAGS} FROM c")
    def _canape(spark, sf_dir):
        rows = _fake(spark, sf_dir).withColumn("CANAPE_CODE", randomise.canape(F.round("a", 6), F.round("b", 6), F.col("r")))
        return rows.select("proc", "CANAPE_CODE", *[(F.col("CANAPE_CODE") == i).cast("int").alias(n) for i, n in ((1, "NEO"), (2, "PALAEO"), (3, "MIXED"), (4, "SUPER"))])


# ---- what models keep

_KEEPS = f"{OCC} SELECT CAST(i AS INT) AS iter, label, count(*) AS range, sum(n) AS abundance FROM occ, range(0, 2) t(i) GROUP BY 1, 2"
for _name, _model in (("rand_csr_by_group", randomise.csr_by_group), ("rand_curveball", randomise.curveball), ("rand_independent_swaps", randomise.independent_swaps), ("rand_structured", randomise.structured), ("rand_nochange", randomise.unchanged)):
    register(f"{_name}_keeps", _KEEPS)(lambda spark, sf_dir, model=_model: model(shared(spark, sf_dir)[0], 2).groupBy("iter", "label").agg(F.count("*").alias("range"), F.sum("n").alias("abundance")))
register("rand_nochange", f"{OCC} SELECT CAST(i AS INT) AS iter, grp, label, n FROM occ, range(0, 2) t(i)")(lambda spark, sf_dir: randomise.unchanged(shared(spark, sf_dir)[0], 2))

_PROPS = f"{GROUPS}, gp AS (SELECT grp, 'ROW' AS prop, CAST(y AS DOUBLE) AS value FROM gps UNION ALL SELECT grp, 'ROOT', floor(sqrt(samples)) FROM gps WHERE x % 2 = 0) SELECT CAST(i AS INT) AS iter, prop, value, count(*) AS n FROM gp, range(0, 2) t(i) GROUP BY 1, 2, 3"
for _name, _by_item in (("process_group_props_by_set", False), ("process_group_props_by_item", True)):

    @register(_name, _PROPS)
    def _props(spark, sf_dir, by_item=_by_item):
        groups = cube.groups(shared(spark, sf_dir)[0])
        made = randomise.shuffled_properties(group_properties(groups), groups, 2, by_item=by_item)
        return made.groupBy("iter", "prop", "value").agg(F.count("*").alias("n"))


# ---- names


@register(
    "guess_remap",
    f"""{OCC}, have AS (SELECT DISTINCT label AS known FROM occ), ask AS (SELECT DISTINCT CASE WHEN label LIKE '%PROMO' THEN label WHEN label LIKE '%ECONOMY' THEN replace(lower(label), '#', ' ') ELSE label || 'X' END AS old FROM occ)
  SELECT old, coalesce((SELECT known FROM have WHERE known = old), (SELECT min(known) FROM have WHERE regexp_replace(lower(known), '[^a-z0-9]', '', 'g') = regexp_replace(lower(old), '[^a-z0-9]', '', 'g')), (SELECT arg_min(known, levenshtein(known, old) * 1000000 + rk) FROM (SELECT known, row_number() OVER (ORDER BY known) AS rk FROM have) WHERE levenshtein(known, old) <= 2)) AS new FROM ask""",
)
def guess_remap(spark, sf_dir):
    have = shared(spark, sf_dir)[0].select(F.col("label").alias("known")).distinct()
    old = F.when(F.col("known").like("%PROMO"), F.col("known")).when(F.col("known").like("%ECONOMY"), F.replace(F.lower("known"), F.lit("#"), F.lit(" "))).otherwise(F.concat("known", F.lit("X")))
    return remap.guess(have.select(old.alias("old")).distinct(), have)
