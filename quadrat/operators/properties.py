"""Properties of labels and groups, numeric labels and label matrices: weighted statistics of values over neighbourhoods.

Properties are rows (key, prop, value).  All statistics come from one routine:
values with whole-number weights are summed by value, and running sums of the
weights give nearest-rank percentiles without expanding or collecting them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators import indices, lists, phylo

#: Percentiles that the property quantiles list.
QUANTILES = (5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95)


def weighted_stats(rows: DataFrame, keys: Sequence[str], percentiles: Sequence[int] = ()) -> DataFrame:
    """(keys, n, total, mean, sd, min, max, range, median, skew, kurt, iqr, hmean, gmean, q<p>...) of rows(keys, v, w).

    Moments are those of each value repeated w times; skew and kurt are bias-corrected.
    """
    by_value = rows.groupBy(*keys, "v").agg(F.sum("w").cast("double").alias("w"))
    over, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v")
    ranked = by_value.withColumns({"upto": F.sum("w").over(before), "n": F.sum("w").over(over)})
    ranked = ranked.withColumn("mean", F.sum(F.col("v") * F.col("w")).over(over) / F.col("n"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    rank = lambda p: F.floor(0.5 + (F.col("n") - 1) * p / 100)
    d = F.col("v") - F.col("mean")
    moment = lambda k: F.sum(F.col("w") * d**k)
    out = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("v") * F.col("w")).alias("total"), F.max("mean").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), (at(rank(75)) - at(rank(25))).alias("iqr"),
        moment(2).alias("m2"), moment(3).alias("m3"), moment(4).alias("m4"), F.sum(F.try_divide(F.col("w"), F.col("v"))).alias("inverse"), F.sum(F.when(F.col("v") > 0, F.col("w") * F.ln("v"))).alias("logs"),
        *[at(rank(p)).alias(f"q{p}") for p in percentiles],
    )
    n, m2 = F.col("n"), F.col("m2")
    spread = m2 > 1e-12
    g1 = F.sqrt(n) * F.col("m3") / m2**1.5
    g2 = n * F.col("m4") / m2**2 - 3
    return out.withColumns({
        "sd": F.when(n > 1, F.sqrt(m2 / (n - 1))).when(n == 1, 0.0), "range": F.col("max") - F.col("min"),
        "skew": F.when((n > 2) & spread, g1 * F.sqrt(n * (n - 1)) / (n - 2)), "kurt": F.when((n > 3) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
        "hmean": F.try_divide(n, F.col("inverse")), "gmean": F.when(F.col("min") > 0, F.exp(F.col("logs") / n)),
    }).drop("m2", "m3", "m4", "inverse", "logs")


def attach(elements: DataFrame, key: str, props: DataFrame) -> DataFrame:
    """Elements with their properties in a row each; props(key, prop, value).  Elements without one are left out."""
    return elements.join(props, key)


def assign(props: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """props with the values of new, which stand over old ones; null values delete."""
    kept = props.join(new.select(key, "prop"), [key, "prop"], "left_anti")
    return kept.unionByName(new.where("value is not null"))


def transfer(props: DataFrame, key: str, elements: DataFrame) -> DataFrame:
    """The properties of the elements that another cube, elements(key), has too."""
    return props.join(elements.select(key).distinct(), key, "left_semi")


def label_values(occ: DataFrame, nbrs: DataFrame, props: DataFrame, by_range: bool = False) -> DataFrame:
    """(proc, prop, label, v, w) of the labels of both sets; weights are 1 or local ranges."""
    weight = F.col("g") if by_range else F.lit(1)
    return lists.label_rows(occ, nbrs).join(props, "label").select("proc", "prop", "label", F.col("value").alias("v"), weight.alias("w"))


def group_values(nbrs: DataFrame, props: DataFrame) -> DataFrame:
    """(proc, prop, grp, v, w) of the groups of both sets, with weight 1."""
    return nbrs.join(props, "grp").select("proc", "prop", "grp", F.col("value").alias("v"), F.lit(1).alias("w"))


def summary(elements: DataFrame, key: str, props: DataFrame, weight: Column | None = None) -> DataFrame:
    """(prop, mean, total, sd, n) over all elements, each weighing 1 or as given."""
    w = F.lit(1) if weight is None else weight
    return weighted_stats(elements.join(props, key).select("prop", F.col("value").alias("v"), w.alias("w")), ["prop"]).select("prop", "mean", "total", "sd", "n")


def gistar(values: DataFrame, whole: DataFrame) -> DataFrame:
    """(proc, prop, gistar): how far a neighbourhood's sum is from what the whole leads to expect; whole(prop, mean, sd, n)."""
    local = values.groupBy("proc", "prop").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").cast("double").alias("k"))
    rows = local.join(F.broadcast(whole.select("prop", "mean", "sd", "n")), "prop")
    below = F.col("sd") * F.sqrt(F.greatest(F.try_divide(F.col("n") * F.col("k") - F.col("k") ** 2, F.col("n") - 1), F.lit(0.0)))
    return rows.select("proc", "prop", F.coalesce(F.try_divide(F.col("s") - F.col("k") * F.col("mean"), below), F.lit(0.0)).alias("gistar"))


def value_counts(values: DataFrame) -> DataFrame:
    """(proc, prop, v, w): how often each value stands in a neighbourhood."""
    return values.groupBy("proc", "prop", "v").agg(F.sum("w").alias("w"))


def expanded(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, data): sorted values, each as often as its weight says."""
    by_value = values.groupBy(*keys, "v").agg(F.sum("w").cast("int").alias("w"))
    runs = by_value.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("r"))
    return runs.select(*keys, F.flatten(F.transform("r", lambda x: F.array_repeat(x["v"], x["w"]))).alias("data"))


def numeric_values(numbers: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(proc, set, v, w): numeric labels of each set with their samples; numbers(grp, v, w)."""
    return nbrs.join(numbers, "grp").groupBy("proc", "set", "v").agg(F.sum("w").alias("w"))


def numeric_dissimilarity(values: DataFrame) -> DataFrame:
    """(proc, absmean, variance, pairs): mean absolute and mean squared difference between the values of two sets, over all pairs by weight.

    Running sums along the values of both sets stand in for the pairs.
    """
    one, two = F.col("set") == 1, F.col("set") == 2
    flat = values.groupBy("proc", "v").agg(F.sum(F.when(one, F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(two, F.col("w")).otherwise(0.0)).alias("b"))
    before = Window.partitionBy("proc").orderBy("v")
    over = Window.partitionBy("proc")
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    rows = flat.withColumns({"n": F.sum("b").over(before), "s": F.sum(b * v).over(before), "nn": F.sum("b").over(over), "ss": F.sum(b * v).over(over)})
    far = a * (v * F.col("n") - F.col("s") + (F.col("ss") - F.col("s")) - v * (F.col("nn") - F.col("n")))
    sums = rows.groupBy("proc").agg(F.sum(far).alias("far"), F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(a * v).alias("sa"), F.sum(b * v).alias("sb"), F.sum(a * v * v).alias("qa"), F.sum(b * v * v).alias("qb"))
    pairs = F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))
    square = F.col("qa") * F.col("nb") + F.col("qb") * F.col("na") - 2 * F.col("sa") * F.col("sb")
    return sums.select("proc", (F.col("far") / pairs).alias("absmean"), (square / pairs).alias("variance"), pairs.alias("pairs"))


def both_ways(matrix: DataFrame) -> DataFrame:
    """(a, b, value) in both directions of matrix(a, b, value), which has each pair once."""
    return matrix.union(matrix.where("a <> b").select("b", "a", "value"))


def matrix_values(occ: DataFrame, nbrs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(proc, a, b, value): the matrix's values between labels of both sets, each pair once.

    Each label of a centre brings the matrix's rows that it stands in, and those
    that both labels brought are kept: the rows of a centre lie in one partition,
    so they are not joined with its labels.
    """
    ends = matrix.select(F.explode(F.array("a", "b")).alias("label"), "a", "b", "value")
    found = indices.local(occ, nbrs).select("proc", "label").join(phylo.sent(matrix, ends), "label").groupBy("proc", "a", "b").agg(F.count("*").alias("k"), F.max("value").alias("value"))
    return found.where("k = 2").select("proc", "a", "b", "value")


def matrix_dissimilarity(occ: DataFrame, nbrs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(proc, mean, variance, pairs): mean and mean square of the values between set 1 and set 2, over all pairs of labels that the matrix has; missing and equal ones are 0."""
    whole = both_ways(matrix)
    rows = lists.label_rows(occ, nbrs).join(whole.select(F.col("a").alias("label")).distinct(), "label", "left_semi")
    counts = rows.groupBy("proc").agg((F.sum("in1") * F.sum("in2")).cast("double").alias("pairs"))
    one, two = rows.where("in1 = 1").select("proc", F.col("label").alias("a")), rows.where("in2 = 1").select("proc", F.col("label").alias("b"))
    found = one.join(whole.where("a <> b"), "a").join(two, ["proc", "b"]).groupBy("proc").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    share = lambda c: F.when(F.col("pairs") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col("pairs"))
    return counts.join(found, "proc", "left").select("proc", share("s").alias("mean"), share("q").alias("variance"), "pairs")


def matrix_entropy(occ: DataFrame, nbrs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(proc, qe, tn): quadratic entropy of the labels that the matrix has, each counted once; missing pairs are 0 and the diagonal counts twice."""
    named = matrix.select(F.explode(F.array("a", "b")).alias("label")).distinct()
    k = indices.local(occ, nbrs).join(phylo.sent(matrix, named), "label", "left_semi").groupBy("proc").agg(F.count("*").cast("double").alias("k"))
    total = matrix_values(occ, nbrs, matrix).groupBy("proc").agg(F.sum("value").alias("s"))
    return k.join(total, "proc", "left").select("proc", (2 * F.coalesce("s", F.lit(0.0)) / (F.col("k") * F.col("k"))).alias("qe"), (F.col("k") * F.col("k")).alias("tn"))
