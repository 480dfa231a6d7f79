"""Registered richness estimators, over a cube that counts order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import estimators, indices
from quadrat.plans.registry import ABC, register, shared


def _counts(spark: SparkSession, sf_dir: str, incidence: bool) -> DataFrame:
    """(proc, v, k, and t for incidences): histograms for the estimators; the labels of a centre are met in one partition."""
    rows = indices.local(cube.canonical(spark, sf_dir, count=False), shared(spark, sf_dir)[1])
    if not incidence:
        return rows.groupBy("proc", F.col("ns").alias("v")).agg(F.count("*").alias("k"))
    groups = shared(spark, sf_dir)[1].groupBy("proc").agg(F.count("*").alias("t"))
    return rows.groupBy("proc", F.col("g").alias("v")).agg(F.count("*").alias("k")).join(groups, "proc")


_LINES = ABC.replace("sum(l_quantity) AS n", "CAST(count(*) AS DOUBLE) AS n", 1)
_FOUND = {
    "1": _LINES + ", q AS (SELECT proc, n1 + n2 AS v, sum(n1 + n2) OVER (PARTITION BY proc) AS t FROM abc)",
    "2": _LINES + ", q AS (SELECT proc, CAST(g1 + g2 AS DOUBLE) AS v, CAST(e1 + e2 AS DOUBLE) AS t FROM abc)",
}
_CHAO = """, z AS (SELECT proc, CAST(count(*) AS DOUBLE) AS s, sum(v) AS n, max(t) AS t, (max(t) - 1) / max(t) AS c, CAST(count(*) FILTER (v = 1) AS DOUBLE) AS f1, CAST(count(*) FILTER (v = 2) AS DOUBLE) AS f2,
    sum(exp(-v) - exp(-2 * v)) AS x1, sum(v * exp(-v)) AS x2, sum(exp(-v)) AS x3 FROM q GROUP BY 1),
  y AS (SELECT *, CASE WHEN f1 > 0 AND f2 > 0 THEN c * f1 * f1 / (2 * f2) WHEN f1 > 1 THEN c * f1 * (f1 - 1) / 2 ELSE 0 END AS unseen FROM z),
  x AS (SELECT *, greatest(0, CASE WHEN f1 > 0 AND f2 > 0 THEN c * f1 * f1 / f2 / 2 + c * c * f1 * f1 * f1 / f2 / f2 + c * c * pow(f1, 4) / pow(f2, 3) / 4
      WHEN f1 > 1 THEN c * f1 * (f1 - 1) / 2 + c * c * f1 * (2 * f1 - 1) * (2 * f1 - 1) / 4 - c * c * pow(f1, 4) / 4 / (s + unseen) ELSE x1 - x2 * x2 / t END) AS var_ FROM y),
  w AS (SELECT *, CASE WHEN unseen > 0 THEN exp(1.959964 * sqrt(ln(1 + var_ / (unseen * unseen)))) END AS k, 1 - x3 / s AS h, 1.959964 * sqrt(var_) AS e FROM x),
  chao AS (SELECT *, CASE WHEN unseen > 0 OR f1 > 1 THEN s + unseen / k WHEN f1 < s THEN greatest(s, (s - e) / h) END AS low, CASE WHEN unseen > 0 OR f1 > 1 THEN s + unseen * k WHEN f1 < s THEN (s + e) / h END AS high FROM w)"""
for _i, _f, _formulas in (("1", "F", (6, 7, 8, 2)), ("2", "Q", (10, 11, 12, 4))):
    _case = "CASE WHEN f1 > 0 AND f2 > 0 THEN {0} WHEN f1 > 1 THEN {1} ELSE {2} END"
    _sql = f"""{_FOUND[_i]}{_CHAO} SELECT proc, round(s + unseen, 6) AS CHAO{_i}_ESTIMATE, f1 AS CHAO{_i}_{_f}1_COUNT, f2 AS CHAO{_i}_{_f}2_COUNT, round(var_, 6) AS CHAO{_i}_VARIANCE, round(sqrt(var_), 6) AS CHAO{_i}_SE,
    round(unseen, 6) AS CHAO{_i}_UNDETECTED, round(low, 6) AS CHAO{_i}_CI_LOWER, round(high, 6) AS CHAO{_i}_CI_UPPER, {_case.format(*_formulas[:3])} AS CHAO{_i}_META_VARIANCE_FORMULA,
    CASE WHEN f1 > 1 OR (f1 > 0 AND f2 > 0) THEN {_formulas[3]} ELSE 0 END AS CHAO{_i}_META_CHAO_FORMULA, {_case.format(13, 13, 14)} AS CHAO{_i}_META_CI_FORMULA FROM chao"""

    @register(f"calc_chao{_i}", _sql)
    def _chao(spark, sf_dir, i=_i, f=_f, formulas=_formulas):
        rows = estimators.chao(_counts(spark, sf_dir, i == "2"))
        names = {"estimate": "ESTIMATE", "variance": "VARIANCE", "se": "SE", "undetected": "UNDETECTED", "ci_lower": "CI_LOWER", "ci_upper": "CI_UPPER"}
        case = F.col("variance_case")
        return rows.select(
            "proc", F.col("f1").alias(f"CHAO{i}_{f}1_COUNT"), F.col("f2").alias(f"CHAO{i}_{f}2_COUNT"), *[F.round(c, 6).alias(f"CHAO{i}_{n}") for c, n in names.items()],
            F.element_at(F.array(*map(F.lit, formulas[:3])), case + 1).alias(f"CHAO{i}_META_VARIANCE_FORMULA"), (F.col("unseen_case") * formulas[3]).alias(f"CHAO{i}_META_CHAO_FORMULA"),
            F.when(case == 2, 14).otherwise(13).alias(f"CHAO{i}_META_CI_FORMULA"),
        )


#: Derivatives written term by term from the estimator's closed form D/C + k f1 D a / (C^2 m (m - 1)) - f1/C.
_COVERAGE = """, r AS (SELECT proc, CAST(count(*) FILTER (v <= 10) AS DOUBLE) AS d, coalesce(sum(v) FILTER (v <= 10), 0) AS m, coalesce(sum(v * v - v) FILTER (v <= 10), 0) AS a FROM q GROUP BY 1),
  b AS (SELECT chao.*, d, m, a, {none} AS none, NOT {none} AND (m = 0 OR f1 = 0 OR f1 = m) AS alt FROM chao JOIN r USING (proc)),
  b1 AS (SELECT *, {c} AS cc, {k} AS kk FROM b WHERE NOT none AND NOT alt),
  b2 AS (SELECT *, greatest(0, d * kk * a / nullif(cc * m * (m - 1), 0) - 1) AS g FROM b1),
  b3 AS (SELECT *, s - d + d / cc + coalesce(g, 0) * f1 / cc AS est FROM b2),
  fr AS (SELECT proc, v, count(*) AS cnt FROM q GROUP BY 1, 2),
  dd AS (SELECT b3.*, fr.v, cnt, {dc} AS dc FROM b3 JOIN fr USING (proc)),
  sl AS (SELECT *, CASE WHEN v > 10 THEN 1e0 ELSE 1 / cc - d * dc / (cc * cc) + CASE WHEN g > 0 THEN
      kk * ((CASE WHEN v = 1 THEN d * a ELSE 0 END + f1 * a + f1 * d * (v * v - v)) / (cc * cc * m * (m - 1)) - f1 * d * a * (2 * dc / cc + v / m + v / (m - 1)) / (cc * cc * m * (m - 1)))
      - CASE WHEN v = 1 THEN 1 / cc ELSE 0 END + f1 * dc / (cc * cc) ELSE 0 END END AS slope FROM dd),
  vv AS (SELECT i.proc, sum(i.slope * j.slope * CASE WHEN i.v = j.v THEN i.cnt * (1 - i.cnt / i.est) ELSE -i.cnt * j.cnt / i.est END) AS va FROM sl i JOIN sl j ON i.proc = j.proc GROUP BY 1),
  b4 AS (SELECT b3.*, nullif(va, 0) AS va, est - s AS un, CASE WHEN est - s >= 0.00001 THEN exp(1.959964 * sqrt(ln(1 + va / pow(est - s, 2)))) END AS kx, 1.959964 * sqrt(greatest(x1 - x2 * x2 / n, 0)) AS ex FROM b3 JOIN vv USING (proc)),
  fin AS (SELECT proc, est, sqrt(va) AS se, va, CASE WHEN kx IS NOT NULL THEN s + un / kx ELSE greatest(s, (s - ex) / h) END AS lo, CASE WHEN kx IS NOT NULL THEN s + un * kx ELSE (s + ex) / h END AS hi, un, d, 0 AS used FROM b4
    UNION ALL SELECT proc, s + unseen, sqrt(var_), var_, low, high, unseen, d, 1 FROM b WHERE alt
    UNION ALL SELECT proc, s, NULL, NULL, NULL, NULL, NULL, d, 0 FROM b WHERE none)
  SELECT proc, round(est, 5) AS {p}_ESTIMATE, round(se, 5) AS {p}_SE, round(va, 5) AS {p}_VARIANCE, round(lo, 5) AS {p}_CI_LOWER, round(hi, 5) AS {p}_CI_UPPER, round(un, 5) AS {p}_UNDETECTED, d AS {p}_INFREQUENT_COUNT, used AS {p}_ESTIMATE_USED_CHAO FROM fin"""
_PARTS = {
    "ACE": ("1", {"none": "(f1 = s)", "c": "1 - f1 / m", "k": "1e0", "dc": "f1 * v / (m * m) - CASE WHEN v = 1 THEN 1 / m ELSE 0 END"}),
    "ICE": ("2", {
        "none": "(f1 = s OR t <= 1)", "k": "t / (t - 1)",
        "c": "1 - f1 / m * (1 - CASE WHEN f2 > 0 THEN 2 * f2 / ((t - 1) * f1 + 2 * f2) ELSE 2 / ((t - 1) * (f1 - 1) + 2) END)",
        "dc": "(t - 1) * f1 * f1 / (m * ((t - 1) * f1 + 2 * f2)) * (v / m + (CASE WHEN v = 1 THEN t - 1 WHEN v = 2 THEN 2 ELSE 0 END) / ((t - 1) * f1 + 2 * f2) - CASE WHEN v = 1 THEN 2 / f1 ELSE 0 END)",
    }),
}
for _p, (_i, _parts) in _PARTS.items():

    @register(f"calc_{_p.lower()}", _FOUND[_i] + _CHAO + _COVERAGE.format(p=_p, **_parts))
    def _coverage(spark, sf_dir, p=_p):
        rows = estimators.coverage(_counts(spark, sf_dir, p == "ICE"), p == "ICE")
        names = {"estimate": "ESTIMATE", "se": "SE", "variance": "VARIANCE", "ci_lower": "CI_LOWER", "ci_upper": "CI_UPPER", "undetected": "UNDETECTED"}
        return rows.select("proc", *[F.round(c, 5).alias(f"{p}_{n}") for c, n in names.items()], F.col("infrequent").alias(f"{p}_INFREQUENT_COUNT"), F.col("used_chao").alias(f"{p}_ESTIMATE_USED_CHAO"))


@register(
    "calc_hurlbert_es",
    f"""{_FOUND["1"]}, d AS (SELECT unnest([5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000]) AS k)
  SELECT proc, CAST(k AS INT) AS n, round(sum(CASE WHEN t - v >= k THEN 1 - exp(lgamma(t - v + 1) + lgamma(t - k + 1) - lgamma(t + 1) - lgamma(t - v - k + 1)) ELSE 1 END), 6) AS HURLBERT_ES FROM q, d WHERE k <= t GROUP BY 1, 2""",
)
def calc_hurlbert_es(spark, sf_dir):
    return estimators.hurlbert(_counts(spark, sf_dir, False)).select("proc", "n", F.round("es", 6).alias("HURLBERT_ES"))
