"""Registered queries on conditions written as text, and on intervals of numeric labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import conditions, expressions, properties
from quadrat.plans.registry import GROUPS, register, shared

_TEXTS = {
    "get_conditions_code_ref": ("sp_circle(radius=3) and not sp_circle(radius=1)", "sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2)) <= 3 AND NOT sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2)) <= 1"),
    "evaluate": ("D <= 2.5 and d[0] < 2 or sp_self_only()", "(sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2)) <= 2.5 AND abs(c.x - b.x) < 2) OR c.grp = b.grp"),
    "sp_calc_conditions": ("sp_block(size=3) and Dsqr >= 1 and not sp_is_left_of()", "floor(c.x / 3e0) = floor(b.x / 3e0) AND floor(c.y / 3e0) = floor(b.y / 3e0) AND pow(c.x - b.x, 2) + pow(c.y - b.y, 2) >= 1 AND NOT b.x < c.x"),
}
for _name, (_text, _sql) in _TEXTS.items():
    register(_name, f"{GROUPS} SELECT c.grp AS proc, count(*) AS n_nbrs FROM gps c JOIN gps b ON {_sql} GROUP BY 1")(
        lambda spark, sf_dir, text=_text: conditions.counts(cube.groups(shared(spark, sf_dir)[0]), expressions.parse(text))
    )


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


register("parse_distances", "SELECT unnest(['C', 'D', 'd[0]', 'sp_block', 'sp_circle']) AS used")(lambda spark, sf_dir: _rows(spark, [(u,) for u in expressions.used("sp_circle(radius=2) and D < 3 or d[0] >= 1 and C <= 2 and not sp_block(size=3)")], "used string"))
register("verify_conditions", "SELECT * FROM (VALUES ('D <= 2', true), ('sp_circle(radius=1) and', false), ('sp_nothing()', false), ('sp_circle()', false), ('open(1)', false), ('not sp_select_all()', true)) t(condition, valid)")(
    lambda spark, sf_dir: _rows(spark, [(t, expressions.verify(t) is None) for t in ("D <= 2", "sp_circle(radius=1) and", "sp_nothing()", "sp_circle()", "open(1)", "not sp_select_all()")], "condition string, valid boolean")
)
_KINDS = {"sp_self_only()": "self_only", "sp_select_all()": "always_true", "sp_block(size=2)": "by_key", "D <= 3": "within_reach", "sp_circle(radius=2) or D > 3": "complex"}
register("get_result_type", f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {chr(39)}{k}{chr(39)})' for t, k in _KINDS.items())}) t(condition, kind)")(lambda spark, sf_dir: _rows(spark, [(t, expressions.result_type(t)) for t in _KINDS], "condition string, kind string"))


@register("get_conditions_bbox", f"{GROUPS} SELECT grp, x - 2.5e0 AS x_min, x + 2.5e0 AS x_max, y - 2.5e0 AS y_min, y + 2.5e0 AS y_max FROM gps")
def get_conditions_bbox(spark, sf_dir):
    reach = expressions.parse("D <= 2.5 and sp_circle(radius=4)").reach
    return cube.groups(shared(spark, sf_dir)[0]).select("grp", *[(F.col(a) + s * reach).cast("double").alias(f"{a}_{n}") for a in "xy" for s, n in ((-1, "min"), (1, "max"))])


# ---- intervals between numeric labels: values of a user's events

_IEI = "WITH e AS (SELECT user_id, floor(value) AS v FROM events WHERE value IS NOT NULL), d AS (SELECT user_id, v - lag(v) OVER (PARTITION BY user_id ORDER BY v) AS i FROM e), k AS (SELECT user_id, i FROM d WHERE i IS NOT NULL)"


def _intervals(spark, sf_dir) -> DataFrame:
    """Intervals between the sorted numeric labels of a group; repeated labels add intervals of 0."""
    e = cube.table(spark, sf_dir, "events").where("value is not null").select("user_id", F.floor("value").cast("double").alias("v"))
    d = e.select("user_id", (F.col("v") - F.lag("v").over(Window.partitionBy("user_id").orderBy("v"))).alias("v"), F.lit(1).alias("w"))
    return d.where("v is not null")


@register(
    "calc_iei_stats",
    f"""{_IEI} SELECT user_id, CAST(count(*) AS DOUBLE) AS IEI_N, round(avg(i), 6) AS IEI_MEAN, round(coalesce(stddev_samp(i), 0), 6) AS IEI_SD, min(i) AS IEI_MIN, max(i) AS IEI_MAX, max(i) - min(i) AS IEI_RANGE,
  round(CASE WHEN count(*) > 2 AND stddev_samp(i) > 0 THEN skewness(i) END, 5) AS IEI_SKEW, round(CASE WHEN count(*) > 3 AND stddev_samp(i) > 0 THEN kurtosis(i) END, 5) AS IEI_KURT, round(coalesce(stddev_samp(i), 0) / nullif(avg(i), 0), 6) AS IEI_CV,
  round(CASE WHEN min(i) > 0 THEN exp(avg(CASE WHEN i > 0 THEN ln(i) END)) END, 6) AS IEI_GMEAN FROM k GROUP BY 1""",
)
def calc_iei_stats(spark, sf_dir):
    s = properties.weighted_stats(_intervals(spark, sf_dir), ["user_id"])
    r = lambda c, n, d=6: F.round(c, d).alias(f"IEI_{n}")
    return s.select("user_id", F.col("n").alias("IEI_N"), r("mean", "MEAN"), r("sd", "SD"), F.col("min").alias("IEI_MIN"), F.col("max").alias("IEI_MAX"), F.col("range").alias("IEI_RANGE"), r("skew", "SKEW", 5), r("kurt", "KURT", 5), r(F.try_divide(F.col("sd"), F.col("mean")), "CV"), r("gmean", "GMEAN"))


@register("calc_iei_data", f"{_IEI} SELECT user_id, list_sort(list(i)) AS IEI_DATA_ARRAY FROM k GROUP BY 1")
def calc_iei_data(spark, sf_dir):
    return properties.expanded(_intervals(spark, sf_dir), ["user_id"]).select("user_id", F.col("data").alias("IEI_DATA_ARRAY"))


@register("calc_iei_data_hash", f"{_IEI} SELECT user_id, i AS v, count(*) AS IEI_DATA_HASH FROM k GROUP BY 1, 2")
def calc_iei_data_hash(spark, sf_dir):
    return _intervals(spark, sf_dir).groupBy("user_id", "v").agg(F.count("*").alias("IEI_DATA_HASH"))
