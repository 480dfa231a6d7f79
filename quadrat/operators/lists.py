"""Results that are lists: rows of (proc, key, values) over the labels, groups or nodes of each centre.

A reference list is a map from a key to a value.  Here it is a table with a row
a key, which joins and aggregates like any other; as_map() folds one back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import indices


def as_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(proc, map): a list as one map a centre."""
    return rows.groupBy("proc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(value))


def when_in(one: str, value: str) -> Column:
    return F.when(F.col(one) == 1, F.col(value))


def label_rows(occ: DataFrame, nbrs: DataFrame) -> DataFrame:
    """Rows of indices.abc with g and n, the local groups and samples of both sets."""
    return indices.abc(occ, nbrs).withColumns({"g": F.col("g1") + F.col("g2"), "ns": F.col("n1") + F.col("n2")})


def label_sets(occ: DataFrame, nbrs: DataFrame, kind: int) -> DataFrame:
    """(proc, label, set1, set2, both): presence (1), local groups (2) or samples (3) of each label; null where a set lacks it."""
    rows = label_rows(occ, nbrs)
    a, b, c = {1: ("in1", "in2", None), 2: ("g1", "g2", "g"), 3: ("n1", "n2", "ns")}[kind]
    both = F.lit(1) if c is None else F.col(c)
    return rows.select("proc", "label", when_in("in1", a).cast("double").alias("set1"), when_in("in2", b).cast("double").alias("set2"), both.cast("double").alias("both"))


def weights(occ: DataFrame, nbrs: DataFrame, of: str, central: bool) -> DataFrame:
    """(proc, label, weight, total): local over global range (of = 'range') or samples ('abundance'), of set 1's labels or of all."""
    rows = label_rows(occ, nbrs)
    local, whole = ("g", "r") if of == "range" else ("ns", "a")
    return rows.where("in1 = 1" if central else "true").select("proc", "label", (F.col(local) / F.col(whole)).alias("weight"), F.col(whole).cast("double").alias("total"))


def absolute_endemics(occ: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(proc, label, set1, set2, both): local ranges of labels that set 1, set 2 or both together hold wholly."""
    rows = label_rows(occ, nbrs)
    held = lambda g: F.when(F.col("r") <= F.col(g), F.col(g))
    return rows.select("proc", "label", held("g1").alias("set1"), held("g2").alias("set2"), held("g").alias("both")).where("both is not null")


def nearest_rank(values: Column, p: Column) -> Column:
    """The value at int(0.5 + (n - 1) p / 100) of sorted values."""
    return F.get(values, F.floor(0.5 + (F.size(values) - 1) * p / 100).cast("int"))


def count_quantiles(occ: DataFrame, nbrs: DataFrame, step: int = 5) -> DataFrame:
    """(proc, q, both, set1, set2): nearest-rank quantiles of the sample counts of labels."""
    rows = label_rows(occ, nbrs)
    lists = rows.groupBy("proc").agg(*[F.sort_array(F.collect_list(v)).alias(c) for c, v in (("all_", F.col("ns")), ("one", when_in("in1", "n1")), ("two", when_in("in2", "n2")))])
    at = lists.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step))))
    return at.select("proc", "q", *[nearest_rank(F.col(c), F.col("q")).alias(a) for c, a in (("all_", "both"), ("one", "set1"), ("two", "set2"))])


def rank_among_neighbours(occ: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(proc, label, pct): share of the other groups that have fewer samples of a label than the centre; a label that is absent counts 0."""
    others = nbrs.where("proc <> grp")
    total = others.groupBy("proc").agg(F.count("*").alias("k"))
    own = occ.select(F.col("grp").alias("proc"), "label", F.col("n").alias("own"))
    held = nbrs.join(occ, "grp").join(own, ["proc", "label"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    other = F.col("proc") != F.col("grp")
    rows = held.groupBy("proc", "label").agg(F.max("own").alias("own"), F.count_if(other).alias("present"), F.count_if(other & (F.col("n") < F.col("own"))).alias("fewer"))
    absent = F.when(F.col("own") > 0, F.col("k") - F.col("present")).otherwise(0)
    return rows.join(total, "proc", "left").select("proc", "label", (100.0 * (F.col("fewer") + absent) / F.col("k")).alias("pct"))


def elements(nbrs: DataFrame) -> DataFrame:
    """(proc, set1, set2, both): sorted names of the groups of each set."""
    names = lambda s: F.sort_array(F.collect_list(F.when(F.col("set") == s, F.col("grp"))))
    return nbrs.groupBy("proc").agg(names(1).alias("set1"), names(2).alias("set2"), F.sort_array(F.collect_list("grp")).alias("both"))


def used_elements(nbrs: DataFrame, occ: DataFrame) -> DataFrame:
    """(proc, set1, set2, both): groups of each set that hold a label; nbrs may hold groups that occ lacks."""
    full = nbrs.join(occ.select("grp").distinct(), "grp", "left_semi")
    counts = full.groupBy("proc").agg(F.count_if(F.col("set") == 1).alias("set1"), F.count_if(F.col("set") == 2).alias("set2"), F.count("*").alias("both"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nbrs.select("proc").distinct().join(counts, "proc", "left").select("proc", zero("set1"), zero("set2"), zero("both"))


def proportions(occ: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(proc, label, p): a label's share of the samples of both sets."""
    rows = label_rows(occ, nbrs)
    total = rows.groupBy("proc").agg(F.sum("ns").alias("t"))
    return rows.join(total, "proc").select("proc", "label", F.try_divide(F.col("ns"), F.col("t")).alias("p"))


def hierarchy_parts(occ: DataFrame, nbrs: DataFrame, central: bool) -> DataFrame:
    """(proc, level, part, share, count, expected, surplus): weighted endemism by the prefixes of the label axes.

    share: of the centre's weighted endemism; count: labels below the prefix;
    expected: their share of the labels; surplus: share less expected.
    """
    w = weights(occ, nbrs, "range", central)
    total = w.groupBy("proc").agg(F.sum("weight").alias("we"), F.count("*").alias("k"))
    axes = F.split("label", ":")
    rows = w.select("proc", "weight", F.explode(F.transform(axes, lambda x, i: F.struct(i.alias("level"), F.array_join(F.slice(axes, F.lit(1), i + 1), ":").alias("part")))).alias("p"))
    parts = rows.groupBy("proc", "p.level", "p.part").agg(F.sum("weight").alias("w"), F.count("*").alias("count")).join(total, "proc")
    share, expected = F.try_divide(F.col("w"), F.col("we")), F.col("count") / F.col("k")
    return parts.select("proc", "level", "part", share.alias("share"), "count", expected.alias("expected"), (share - expected).alias("surplus"))


def label_ratios(occ: DataFrame, nbrs: DataFrame, levels: int) -> DataFrame:
    """(proc, level, a, b, c, asum, arat, brat, crat, asumrat): shared and unshared labels by level, and ratios to the level before.

    Every level counts the same labels, so ratios are 1 where their base isn't 0.
    """
    rows = label_rows(occ, nbrs).groupBy("proc").agg(
        F.sum(F.col("in1") * F.col("in2")).alias("a"), F.sum(F.col("in1") * (1 - F.col("in2"))).alias("b"), F.sum(F.col("in2") * (1 - F.col("in1"))).alias("c"),
        F.sum(F.col("in1") * F.col("in2") * F.col("ns")).alias("asum"),
    )
    at = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    ratio = lambda c: F.when(F.col("level") > 0, F.try_divide(F.col(c).cast("double"), F.col(c).cast("double"))).alias(f"{c}rat")
    loss = F.when(F.col("level") > 0, F.when(F.col("asum") == 0, 1.0).otherwise(0.0)).alias("asumrat")
    return at.select("proc", "level", "a", "b", "c", "asum", ratio("a"), ratio("b"), ratio("c"), loss)


def range_overrides(occ: DataFrame, overrides: DataFrame) -> DataFrame:
    """labels() of the cube with the larger of its own and the given ranges and abundances."""
    return cube.labels(occ, overrides)
