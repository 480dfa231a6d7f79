"""Richness estimators: Chao1 and Chao2, ACE and ICE, Hurlbert's expected richness.

counts(proc, v, t, k): how often labels of a centre are found (samples for Chao1
and ACE, groups for Chao2 and ICE) and t, the number of all samples or groups;
t is the sum of all v if it is left out.  A row stands for k labels, 1 if that is
left out.  Everything is one aggregation, which keeps the rare labels' histogram
where variances sum over it; formulas are columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 per cent quantile of the normal distribution.
Z = 1.959964
#: Labels that are found so often at most are rare.
RARE = 10


def _c(name: str) -> Column:
    return F.col(name)


def _labels(counts: DataFrame) -> Column:
    return _c("k") if "k" in counts.columns else F.lit(1)


def _summed(counts: DataFrame, *more: Column) -> DataFrame:
    """Aggregates of a centre: s labels, n found in all, f1 and f2 found once and twice, sums of exponentials, t."""
    v, k = _c("v"), _labels(counts)
    often = lambda x: F.sum(F.when(v == x, k).otherwise(0)).cast("double")
    return counts.groupBy("proc").agg(
        F.sum(k).cast("double").alias("s"), F.sum(v * k).cast("double").alias("n"), (F.max("t") if "t" in counts.columns else F.sum(v * k)).cast("double").alias("t"),
        often(1).alias("f1"), often(2).alias("f2"),
        F.sum(k * (F.exp(-v) - F.exp(-2 * v))).alias("x1"), F.sum(k * v * F.exp(-v)).alias("x2"), F.sum(k * F.exp(-v)).alias("x3"), *more,
    )


def chao(counts: DataFrame) -> DataFrame:
    """(proc, estimate, f1, f2, variance, se, undetected, ci_lower, ci_upper, variance_case, unseen_case) of Chao's estimators.

    t is n for abundances and the number of groups for incidences.
    variance_case: 0 with labels found twice, 1 with several found once and none
    twice, 2 otherwise; unseen_case: 0 where the estimate adds nothing.
    """
    return _chao(_summed(counts)).select(
        "proc", "estimate", "f1", "f2", "variance", F.sqrt("variance").alias("se"), "undetected", "ci_lower", "ci_upper", F.col("case").alias("variance_case"), (F.col("case") < 2).cast("int").alias("unseen_case"),
    )


def _chao(summed: DataFrame) -> DataFrame:
    """Sums with case, undetected, estimate, variance, ci_lower and ci_upper."""
    s, f1, f2, t = map(_c, ("s", "f1", "f2", "t"))
    c = F.when(t > 0, (t - 1) / t).otherwise(1.0)
    case = F.when((f1 > 0) & (f2 > 0), 0).when(f1 > 1, 1).otherwise(2)
    rows = summed.withColumns({"c": c, "case": case})
    rows = rows.withColumn("undetected", _c("c") * F.when(_c("case") == 0, f1 * f1 / F.nullif(2 * f2, F.lit(0.0))).when(_c("case") == 1, f1 * (f1 - 1) / 2).otherwise(0.0))
    rows = rows.withColumn("estimate", s + _c("undetected"))
    ratio, c = F.try_divide(f1, f2), _c("c")
    variance = (
        F.when(_c("case") == 0, f2 * (c * ratio**2 / 2 + c**2 * ratio**3 + c**2 * ratio**4 / 4))
        .when(_c("case") == 1, c * f1 * (f1 - 1) / 2 + c**2 * f1 * (2 * f1 - 1) ** 2 / 4 - c**2 * f1**4 / 4 / _c("estimate"))
        .otherwise(_c("x1") - F.try_divide(_c("x2") ** 2, t))
    )
    rows = rows.withColumn("variance", F.greatest(variance, F.lit(0.0)))
    return rows.withColumns(_interval(_c("variance"), _c("case") < 2, _c("undetected"))).drop("c")


def _interval(variance: Column, lognormal: Column, unseen: Column) -> dict[str, Column]:
    """ci_lower and ci_upper: log-normal about the unseen labels, or from the share of labels that chance alone hides."""
    s, p = _c("s"), _c("x3") / _c("s")
    k = F.exp(Z * F.sqrt(F.log1p(F.try_divide(variance, unseen**2))))
    hidden = F.when(_c("f1") < s, 1 - p)
    wide = Z * F.sqrt(variance)
    return {
        "ci_lower": F.when(lognormal, s + F.try_divide(unseen, k)).otherwise(F.when(hidden.isNotNull(), F.greatest(s, s / hidden - wide / hidden))),
        "ci_upper": F.when(lognormal, s + unseen * k).otherwise(s / hidden + wide / hidden),
    }


def coverage(counts: DataFrame, incidence: bool = False) -> DataFrame:
    """(proc, estimate, se, variance, ci_lower, ci_upper, undetected, infrequent, used_chao): ACE, or with incidence ICE.

    Where no rare label is found once, or all are, Chao's estimate stands in;
    where all labels are found once (or there is one group) there is none.
    """
    v, n = _c("v"), _labels(counts)
    rare = v <= RARE
    of_rare = lambda x: F.coalesce(F.sum(F.when(rare, x)), F.lit(0)).cast("double")
    rows = _chao(_summed(
        counts, of_rare(n).alias("d"), of_rare(v * n).alias("m"), of_rare(v * (v - 1) * n).alias("a"), F.sum(F.when(rare, 0).otherwise(n)).cast("double").alias("abundant"),
        F.collect_list(F.when(rare, F.struct(v.cast("double").alias("v"), n.cast("double").alias("n")))).alias("rare"),
    ))
    parts = ("estimate", "variance", "ci_lower", "ci_upper", "undetected")
    rows = rows.withColumn("instead", F.struct(*parts)).drop(*parts)
    f1, f2, m, d, t, a, s = map(_c, ("f1", "f2", "m", "d", "t", "a", "s"))
    rows = rows.withColumn("none", (f1 == s) | ((t <= 1) if incidence else F.lit(False))).withColumn("chao", ~_c("none") & ((m == 0) | (f1 == 0) | (f1 == m)))
    # Centres with an estimate of their own; what follows is null for others.
    own, over = ~_c("none") & ~_c("chao"), F.try_divide
    if incidence:
        left = F.when(f2 > 0, over(2 * f2, (t - 1) * f1 + 2 * f2)).otherwise(over(F.lit(2.0), (t - 1) * (f1 - 1) + 2))
        rows = rows.withColumns({"c": F.when(own, 1 - over(f1, m) * (1 - left)), "k": F.when(own, over(t, t - 1))})
    else:
        rows = rows.withColumns({"c": F.when(own, 1 - over(f1, m)), "k": F.lit(1.0)})
    c, k, g = _c("c"), _c("k"), _c("g")
    rows = rows.withColumn("g", F.when(own, F.greatest(F.coalesce(over(d * k * a, c * m * (m - 1)) - 1, F.lit(0.0)), F.lit(0.0))))
    rows = rows.withColumn("estimate", F.when(own, s - d + over(d, c) + over(f1, c) * g))

    # Delta method: the estimate's derivative by the number of labels of each frequency, and the covariance of these numbers.
    def slope(v: Column) -> Column:
        one, two = (v == 1).cast("double"), (v == 2).cast("double")
        if incidence:
            h = (t - 1) * f1 + 2 * f2
            top, below = (t - 1) * f1**2, m * h
            dc = -over((2 * (t - 1) * f1 * one) * below - top * (v * h + m * ((t - 1) * one + 2 * two)), below**2)
        else:
            dc = -over(one * m - f1 * v, m**2)
        plain = over(c - d * dc, c**2)
        product = c**2 * m * (m - 1)
        spread = k * over((one * d * a + f1 * a + f1 * d * v * (v - 1)) * product - f1 * d * a * (2 * c * dc * m * (m - 1) + c**2 * v * (2 * m - 1)), product**2) - over(one * c - f1 * dc, c**2)
        return F.when(g > 0, plain + spread).otherwise(plain)

    slopes = F.transform("rare", lambda x: F.struct(x["n"].alias("n"), slope(x["v"]).alias("slope")))
    rows = rows.withColumn("slopes", F.when(own, slopes))
    summed = lambda f: F.aggregate("slopes", F.lit(0.0), lambda acc, x: acc + x["n"] * f(x["slope"])) + _c("abundant")
    rows = rows.withColumn("variance", F.nullif(summed(lambda x: x * x) - over(summed(lambda x: x) ** 2, _c("estimate")), F.lit(0.0)))

    unseen = _c("estimate") - s
    far = unseen >= 0.00001
    seen = F.when(far, _c("variance")).otherwise(_c("x1") - over(_c("x2") ** 2, _c("n")))
    rows = rows.withColumns({**_interval(seen, far, unseen), "undetected": unseen})
    of = lambda x: F.when(own, _c(x)).when(_c("chao"), _c(f"instead.{x}"))
    return rows.select(
        "proc", F.coalesce(of("estimate"), s).alias("estimate"), F.sqrt(of("variance")).alias("se"), *[of(x).alias(x) for x in parts[1:]], d.alias("infrequent"), _c("chao").cast("int").alias("used_chao"),
    ).select("proc", "estimate", "se", "variance", "ci_lower", "ci_upper", "undetected", "infrequent", "used_chao")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series eight steps up, which leaves an error below 1e-10."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    return series - F.ln(steps)


def hurlbert(counts: DataFrame, sizes: tuple[int, ...] = (5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)) -> DataFrame:
    """(proc, n, es): labels expected among n samples drawn without replacement, for n up to the number of samples."""
    found = counts.groupBy("proc", "v").agg(F.sum(_labels(counts)).alias("k"))
    total = F.sum(F.col("v") * F.col("k")).over(Window.partitionBy("proc")).cast("double")
    rows = found.withColumn("whole", total).withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where("n <= whole")
    rest = F.col("whole") - F.col("v")
    some = F.greatest(rest - F.col("n"), F.lit(0.0))
    missed = F.when(rest >= F.col("n"), F.exp(log_gamma(rest + 1) + log_gamma(F.col("whole") - F.col("n") + 1) - log_gamma(F.col("whole") + 1) - log_gamma(some + 1))).otherwise(0.0)
    return rows.groupBy("proc", "n").agg(F.sum(F.col("k") * (1 - missed)).alias("es"))
