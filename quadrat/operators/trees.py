"""Changes of trees, and questions about them, over nodes(node, parent, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators import clades, phylo


def tips(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def from_labels(occ: DataFrame) -> DataFrame:
    """The tree that the axes of labels span, with branches of length 1."""
    axes = F.split("label", ":")
    rows = occ.select("label").distinct().select(F.explode(F.transform(axes, lambda x, i: F.struct(F.array_join(F.slice(axes, F.lit(1), i + 1), ":").alias("node"), F.when(i > 0, F.array_join(F.slice(axes, F.lit(1), F.greatest(i, F.lit(1))), ":")).otherwise("root").alias("parent")))).alias("n"))
    root = occ.sparkSession.createDataFrame([("root", None, 0.0)], "node string, parent string, length double")
    return rows.select("n.*").distinct().withColumn("length", F.lit(1.0)).unionByName(root)


def tips_by_depth(nodes: DataFrame, depth: int) -> DataFrame:
    """(depth, n): tips at each number of steps from the root."""
    return tips(nodes).select("node").join(clades.depths(nodes, depth), "node").groupBy("depth").agg(F.count("*").alias("n"))


def is_ultrametric(nodes: DataFrame, depth: int, tolerance: float = 1e-6) -> DataFrame:
    d = tips(nodes).select("node").join(clades.depths(nodes, depth), "node")
    return d.agg((F.max("dist_root") - F.min("dist_root") < tolerance).alias("ultrametric"))


def shared_by(nodes: DataFrame, depth: int, names: DataFrame) -> DataFrame:
    """(node): the deepest node above all of names(node)."""
    wanted = names.select("node").distinct()
    count = wanted.agg(F.count("*").alias("k"))
    above = clades.ancestry(nodes, depth).join(wanted, "node").groupBy("anc").agg(F.count("*").alias("c")).join(F.broadcast(count), F.col("c") == F.col("k"))
    deep = clades.depths(nodes, depth).withColumnRenamed("node", "anc")
    return above.join(deep, "anc").agg(F.max_by("anc", "depth").alias("node"))


def trimmed_nodes(nodes: DataFrame, depth: int, keep: DataFrame) -> DataFrame:
    """The nodes above the tips of keep(tip), themselves included."""
    held = phylo.closure(nodes, depth).join(keep.select("tip").distinct(), "tip", "left_semi").select("node").distinct()
    return nodes.join(held, "node", "left_semi")


def rooted_at_shared(nodes: DataFrame, depth: int) -> DataFrame:
    """The tree from the last node above all tips down; that one becomes the root."""
    last = shared_by(nodes, depth, tips(nodes)).select(F.col("node").alias("anc"))
    below = clades.ancestry(nodes, depth).join(F.broadcast(last), "anc").select("node", F.col("anc").alias("top"))
    return nodes.join(below, "node").select("node", F.when(F.col("node") != F.col("top"), F.col("parent")).alias("parent"), "length")


def without_knuckles(nodes: DataFrame, depth: int) -> DataFrame:
    """Inner nodes with one child merge into that child, whose length grows by theirs."""
    single = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k")).where("k = 1 and node is not null").select("node")
    up = clades.ancestry(nodes, depth).join(single.select(F.col("node").alias("anc"), F.lit(True).alias("knuckle")), "anc", "left").withColumn("knuckle", F.coalesce("knuckle", F.lit(False)))
    kept = nodes.join(single, "node", "left_anti").select("node")
    rows = up.join(kept, "node", "left_semi").where("steps > 0")
    stop = rows.where("not knuckle").groupBy("node").agg(F.min("steps").alias("stop"), F.min_by("anc", "steps").alias("parent"))
    added = rows.join(stop.select("node", "stop"), "node", "left").where("knuckle and (stop is null or steps < stop)").groupBy("node").agg(F.sum("length").alias("more"))
    return nodes.join(kept, "node").select("node", "length").join(stop.select("node", "parent"), "node", "left").join(added, "node", "left").select("node", "parent", (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length"))


def rooted(nodes: DataFrame, name: str = "root") -> DataFrame:
    """Several roots become children of a new one."""
    root = nodes.sparkSession.createDataFrame([(name, None, 0.0)], "node string, parent string, length double")
    return nodes.withColumn("parent", F.coalesce("parent", F.lit(name))).unionByName(root)


def shuffled_tips(nodes: DataFrame, seed: int) -> DataFrame:
    """Tips swap their names by a seeded order; lengths and places stay."""
    t = tips(nodes).select("node")
    one = t.select("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")).alias("i"))
    two = t.select(F.col("node").alias("new"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), "node"), "node")).alias("i"))
    names = one.join(two, "i").select("node", "new")
    return nodes.join(names, "node", "left").select(F.coalesce("new", "node").alias("node"), "parent", "length")


def range_weighted(nodes: DataFrame, occ: DataFrame, depth: int) -> DataFrame:
    """Lengths over ranges, of the nodes that the cube has."""
    paths = phylo.trimmed(phylo.closure(nodes, depth), occ)
    ranges = phylo.group_nodes(occ, paths).groupBy("node").agg(F.count("*").alias("r"))
    return nodes.join(ranges, "node").select("node", "parent", (F.col("length") / F.col("r")).alias("length"))


def cut_at_depth(nodes: DataFrame, depth: int, at: int) -> DataFrame:
    """(tip, cluster): the node at a depth above each tip, or the tip where it lies higher."""
    deep = clades.depths(nodes, depth).select(F.col("node").alias("anc"), F.col("depth").alias("d"))
    above = clades.ancestry(nodes, depth).join(tips(nodes).select("node"), "node", "left_semi").join(deep, "anc").where(F.col("d") <= at)
    return above.groupBy(F.col("node").alias("tip")).agg(F.max_by("anc", "d").alias("cluster"))


def compare(one: DataFrame, two: DataFrame, depth: int) -> DataFrame:
    """(node, best, identical): the least Sorenson dissimilarity of each inner node's tips to those of an inner node of another tree; pairs without a shared tip aren't made, their value is 1."""
    inner = lambda nodes: phylo.closure(nodes, depth).where("steps > 0").select("tip", "node")
    a, b = inner(one), inner(two).withColumnRenamed("node", "other")
    na, nb = a.groupBy("node").agg(F.count("*").alias("na")), b.groupBy("other").agg(F.count("*").alias("nb"))
    both = a.join(b, "tip").groupBy("node", "other").agg(F.count("*").alias("c")).join(nb, "other").join(na, "node")
    best = both.groupBy("node").agg(F.min(1 - 2.0 * F.col("c") / (F.col("na") + F.col("nb"))).alias("best"))
    return na.join(best, "node", "left").select("node", F.round(F.coalesce("best", F.lit(1.0)), 8).alias("best"), (F.coalesce("best", F.lit(1.0)) < 1e-12).alias("identical"))


def mean_nearest_distance(nodes: DataFrame, depth: int) -> DataFrame:
    d = clades.tip_distances(nodes, depth)
    return d.groupBy("a").agg(F.min("d").alias("d")).agg(F.avg("d").alias("mean"))
