"""Node lists and clade calculations: what the nodes of a centre's labels hold, contribute and would lose.

nodes(node, parent, length) is a tree; ancestry() is its closure over all
nodes.  A centre's sub-tree is a table of its nodes, so each result is a join
with the closure and an aggregate by centre and node.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators import indices, phylo


def ancestry(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, anc, steps, length): each node with itself and all nodes above it; length is that of anc."""
    return phylo.kept_closure("ancestry", nodes, depth, lambda: _ancestry(nodes, depth))


def _ancestry(nodes: DataFrame, depth: int) -> DataFrame:
    up = nodes.select(F.col("node").alias("u"), F.col("parent").alias("p"), F.col("length").alias("l"))
    step = nodes.select("node", F.col("node").alias("anc"), "parent", "length", F.lit(0).alias("steps"))
    out = step
    for k in range(1, depth + 1):
        step = step.join(up, step["parent"] == up["u"]).select("node", F.col("u").alias("anc"), F.col("p").alias("parent"), F.col("l").alias("length"), F.lit(k).alias("steps"))
        out = out.unionByName(step)
    return out.select("node", "anc", "steps", "length")


def depths(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, depth, dist_root): steps to the root, and the sum of lengths up to it, the root's included."""
    return ancestry(nodes, depth).groupBy("node").agg(F.max("steps").alias("depth"), F.sum("length").alias("dist_root"))


def sampled(occ: DataFrame, nbrs: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(proc, node, tips, first, total): nodes on the paths of a centre's labels, with the labels below each, the first of them, and all labels on the tree.  A centre's rows lie in one partition."""
    labels = nbrs.join(occ.select("grp", "label"), "grp").repartition("proc").select("proc", "label").distinct()
    paths = phylo.sent(nodes, phylo.closure(nodes, depth).select("tip", "node"))
    held = labels.join(paths, F.col("label") == F.col("tip")).groupBy("proc", "node").agg(F.count("*").alias("tips"), F.min("label").alias("first"))
    return held.withColumn("total", F.max("tips").over(Window.partitionBy("proc")))


def shared_ancestor(occ: DataFrame, nbrs: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(proc, node, depth, length, dist_root, dist_tip, pos_rel, is_tip): the deepest node above all labels of a centre.

    dist_tip is the largest distance from it to the labels; pos_rel its place between root and tips.
    """
    deep = depths(nodes, depth)
    rows = sampled(occ, nbrs, nodes, depth).join(deep, "node")
    last = rows.where("tips = total").groupBy("proc").agg(F.max_by("node", "depth").alias("node"), F.max("depth").alias("depth"), F.max_by("dist_root", "depth").alias("dist_root"))
    tips = nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(True).alias("is_tip"))
    far = rows.join(tips, "node", "left_semi").groupBy("proc").agg(F.max("dist_root").alias("far"))
    out = last.join(far, "proc").join(tips, "node", "left").join(nodes.select("node", "length"), "node").withColumn("is_tip", F.coalesce("is_tip", F.lit(False)))
    # Distances don't count the root's own length.
    root = F.when(F.col("depth") == 0, 0.0).otherwise(F.col("dist_root"))
    out = out.withColumns({"dist_tip": F.when(F.col("is_tip"), 0.0).otherwise(F.col("far") - root), "dist_root": root})
    return out.select("proc", "node", "depth", "length", "dist_root", "dist_tip", F.coalesce(F.try_divide(F.col("dist_root"), F.col("dist_root") + F.col("dist_tip")), F.lit(0.0)).alias("pos_rel"), "is_tip")


def contributions(weights: DataFrame, nodes: DataFrame, depth: int, occ: DataFrame, nbrs: DataFrame, tree_length: Column) -> DataFrame:
    """(proc, node, tips, first, score, contr, contr_p) of weights(proc, node, w): sums over the clade of each node below the shared ancestor, and their shares of the centre's sum and of tree_length, cut off after eleven digits; first is the first label below."""
    of = Window.partitionBy("proc")
    known = sampled(occ, nbrs, nodes, depth).join(phylo.sent(nodes, depths(nodes, depth).select("node", "depth")), "node")
    last = F.max(F.when(F.col("tips") == F.col("total"), F.struct("depth", "node"))).over(of)
    inside = known.withColumn("last", last).where("tips < total or node = last.node").select("proc", "node", "tips", "first")
    up = phylo.sent(nodes, ancestry(nodes, depth).select("node", "anc"))
    scores = weights.withColumn("p", F.sum("w").over(of)).join(up, "node").groupBy("proc", F.col("anc").alias("node")).agg(F.sum("w").alias("score"), F.max("p").alias("p"))
    cut = lambda x: F.floor(1e11 * x) / 1e11
    return inside.join(scores, ["proc", "node"]).select("proc", "node", "tips", "first", "score", cut(F.try_divide(F.col("score"), F.col("p"))).alias("contr"), cut(F.try_divide(F.col("score"), tree_length)).alias("contr_p"))


def losses(contributed: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(proc, node, score, contr, contr_p, ancestral, ancestral_p): what would go with a clade, which is the score of the highest node that has no other labels below it.

    Nodes above the same labels, which are those with as many and the same first
    one, lie on one path; of them the one nearest to the root is the highest.
    """
    rows = contributed.join(phylo.sent(nodes, depths(nodes, depth).select("node", "depth")), "node")
    high = F.min_by(F.struct("score", "contr", "contr_p"), "depth").over(Window.partitionBy("proc", "first", "tips"))
    top = rows.withColumn("high", high)
    lost = F.col("high.score") - F.col("score")
    return top.select("proc", "node", "high.score", "high.contr", "high.contr_p", lost.alias("ancestral"), F.coalesce(F.try_divide(lost, F.col("high.score")), F.lit(0.0)).alias("ancestral_p"))


def distinctness(occ: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(label, es, ed, aed) of the tree trimmed to the cube: lengths on the way to the root, shared equally at each fork, by tips below, or by samples below."""
    paths = phylo.trimmed(phylo.closure(nodes, depth), occ)
    kept = paths.select("node").distinct()
    children = nodes.join(kept, "node", "left_semi").groupBy(F.col("parent").alias("node")).agg(F.count("*").cast("double").alias("children"))
    amounts = occ.groupBy(F.col("label").alias("tip")).agg(F.sum("n").alias("n"))
    below = paths.join(amounts, "tip").groupBy("node").agg(F.count("*").alias("tips"), F.sum("n").alias("amount"))
    rows = paths.join(below, "node").join(children, "node", "left")
    # The share of a node is the product over the forks from the tip up to it.
    forks = F.sum(F.ln(F.coalesce("children", F.lit(1.0)))).over(Window.partitionBy("tip").orderBy("steps"))
    rows = rows.withColumn("share", F.exp(-forks))
    return rows.groupBy(F.col("tip").alias("label")).agg(F.sum(F.col("length") * F.col("share")).alias("es"), F.sum(F.col("length") / F.col("tips")).alias("ed"), F.sum(F.col("length") / F.col("amount")).alias("aed"))


def tip_distances(nodes: DataFrame, depth: int, occ: DataFrame | None = None) -> DataFrame:
    """(a, b, d, up): distances between tips in both directions, and the largest distance from their last shared node down to any tip, itself included; occ trims the tree."""
    paths = phylo.closure(nodes, depth)
    if occ is not None:
        paths = phylo.trimmed(paths, occ)
    upto = F.sum("length").over(Window.partitionBy("tip").orderBy("steps"))
    p = paths.withColumn("upto", upto)
    high = p.groupBy("node").agg(F.max("upto").alias("high"))
    p = p.join(high, "node")
    a, b = (p.select("node", F.col("tip").alias(t), (F.col("upto") - F.col("length")).alias(f"d{t}"), F.col("steps").alias(f"s{t}"), F.col("high").alias(f"h{t}")) for t in "ab")
    pairs = a.join(b, "node").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("d"), F.min_by("ha", "sa").alias("up"))


def forks(nodes: DataFrame, depth: int, occ: DataFrame) -> DataFrame:
    """(label, fork, child, d, own, high): the inner nodes above each tip of the tree trimmed to the cube, with the node below on the way to the tip, the distance from the tip, the tip's own length, and the largest distance from there down to any tip, itself included."""
    up = Window.partitionBy("tip").orderBy("steps")
    paths = phylo.trimmed(phylo.closure(nodes, depth), occ).withColumns({"upto": F.sum("length").over(up), "child": F.lag("node").over(up), "own": F.first("length").over(up)})
    rows = paths.withColumn("high", F.max("upto").over(Window.partitionBy("node"))).where("steps > 0")
    return phylo.sent(nodes, rows.select(F.col("tip").alias("label"), F.col("node").alias("fork"), "child", (F.col("upto") - F.col("length")).alias("d"), "own", "high"))


def _others(values: str) -> Column:
    """The sum of an expression over the tips of a centre that are below a fork, but not below the same child of it."""
    return F.expr(f"sum({values}) over (partition by proc, fork) - sum({values}) over (partition by proc, fork, child)")


def pair_distances(occ: DataFrame, nbrs: DataFrame, nodes: DataFrame, depth: int, kind: int) -> DataFrame:
    """(proc, measure, mean, variance, rmsd, n, min, max) for PMPD and PNTD: distances between a centre's labels, and to each label's nearest; kind: weights 1, local ranges or samples.

    No pairs are made: two tips part at one fork, their distance is the sum of
    those to it, so sums over the other children of each fork above a tip, and
    their least and largest distance, stand in for the tips there.
    """
    w = {1: F.lit(1.0), 2: F.col("g").cast("double"), 3: F.col("ns")}[kind]
    rows = indices.local(occ, nbrs).select("proc", "label", w.alias("w")).join(forks(nodes, depth, occ).select("label", "fork", "child", "d"), "label")
    rows = rows.withColumns({"w0": _others("w"), "w1": _others("w * d"), "w2": _others("w * d * d")})
    fork = Window.partitionBy("proc", "fork")
    least, most = F.struct("d", "child"), F.struct((-F.col("d")).alias("d"), "child")
    rows = rows.withColumns({"near": F.min(least).over(fork), "far": F.min(most).over(fork)})
    apart = lambda end: F.col("child") != F.col(f"{end}.child")
    rows = rows.withColumns({"near2": F.min(F.when(apart("near"), F.col("d"))).over(fork), "far2": F.max(F.when(apart("far"), F.col("d"))).over(fork)})
    d, other = F.col("d"), lambda end, first: F.when(apart(end), first).otherwise(F.col(f"{end}2"))
    rows = rows.withColumns({"near": d + other("near", F.col("near.d")), "far": d + other("far", -F.col("far.d"))}).where("near is not null")
    tips = rows.groupBy("proc", "label").agg(
        F.max("w").alias("w"), F.sum("w0").alias("w0"), F.sum(d * F.col("w0") + F.col("w1")).alias("w1"), F.sum(d * d * F.col("w0") + 2 * d * F.col("w1") + F.col("w2")).alias("w2"), F.min("near").alias("near"), F.max("far").alias("far"),
    )
    w, near = F.col("w"), F.col("near")
    sums = tips.groupBy("proc").agg(
        F.struct(F.lit("PMPD").alias("measure"), F.sum(w * F.col("w0")).alias("n"), F.sum(w * F.col("w1")).alias("s"), F.sum(w * F.col("w2")).alias("q"), F.min("near").alias("min"), F.max("far").alias("max")).alias("every"),
        F.struct(F.lit("PNTD").alias("measure"), F.sum("w").alias("n"), F.sum(w * near).alias("s"), F.sum(w * near * near).alias("q"), F.min("near").alias("min"), F.max("near").alias("max")).alias("nearest"),
    )
    sums = sums.select("proc", F.explode(F.array("every", "nearest")).alias("m")).select("proc", "m.*")
    mean, square = F.col("s") / F.col("n"), F.col("q") / F.col("n")
    return sums.select("proc", "measure", mean.alias("mean"), F.greatest(square - mean**2, F.lit(0.0)).alias("variance"), F.sqrt(square).alias("rmsd"), "n", "min", "max")


def taxonomic_distinctness(occ: DataFrame, nbrs: DataFrame, nodes: DataFrame, depth: int, binary: bool) -> DataFrame:
    """(proc, distinctness, denominator, numerator, variation): depth of the last shared node above the second label, over ordered pairs weighted by samples, or by 1; sums over the other children of each fork stand in for the first labels."""
    rows = indices.local(occ, nbrs).select("proc", "label", (F.lit(1.0) if binary else F.col("ns")).alias("w")).join(forks(nodes, depth, occ), "label")
    rows = rows.withColumns({"w0": _others("w"), "q0": _others("w * w"), "k0": _others("1")}).where("k0 > 0")
    x = F.col("w") * (F.col("high") - F.col("own"))
    sums = rows.groupBy("proc").agg(F.sum(x * F.col("w0")).alias("numerator"), F.sum(F.col("w") * F.col("w0")).alias("denominator"), F.sum(x * x * F.col("q0")).alias("q"))
    ratio = F.col("numerator") / F.col("denominator")
    return sums.select("proc", ratio.alias("distinctness"), "denominator", "numerator", (F.col("q") / F.col("denominator") - ratio**2).alias("variation"))


def elbow(values: DataFrame) -> DataFrame:
    """(elbow): of sorted values(v) the first that lies farthest from the line between the first and the last.  One row a tree node meets in a window, so this is for values of a tree."""
    every = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = values.withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("v")) - 1, "lo": F.first("v").over(every), "hi": F.last("v").over(every), "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    far = F.abs(F.col("i") * (F.col("hi") - F.col("lo")) - (F.col("n") - 1) * (F.col("v") - F.col("lo")))
    return ranked.agg(F.max_by("v", F.struct(F.round(far, 9), -F.col("i"))).alias("elbow"))


def branch_codes(occ: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(node, code, diff, rare): branches of the trimmed tree by range and length.

    diff: length less 1 (0 for branches without length) over range; rare: its
    value if the range is below the elbow of 1 / range; code: 0 for others, else 1
    (short), 3 (long) or 2, by the elbows of the diffs below and above 0.
    """
    ranges = phylo.held_ranges(occ, phylo.sent(nodes, phylo.closure(nodes, depth).select("tip", "node")))
    rows = nodes.join(phylo.sent(nodes, ranges), "node").select("node", (1.0 / F.col("r")).alias("inverse"), ((F.col("length") - F.when(F.col("length") != 0, 1.0).otherwise(0.0)) / F.col("r")).alias("diff"))
    named = lambda df, n: elbow(df).withColumnRenamed("elbow", n)
    limits = named(rows.select(F.col("inverse").alias("v")), "rare_from").crossJoin(named(rows.where("diff >= 0").select(F.col("diff").alias("v")), "high")).crossJoin(named(rows.where("diff <= 0").select(F.col("diff").alias("v")), "low"))
    rare = F.col("inverse") >= F.col("rare_from")
    code = F.when(~rare, 0).when(F.col("diff") <= F.col("low"), 1).when(F.col("diff") >= F.col("high"), 3).otherwise(2)
    return rows.crossJoin(F.broadcast(limits)).select("node", code.alias("code"), "diff", F.when(rare, F.col("diff")).alias("rare"))


def expected_mpd(nodes: DataFrame, depth: int, sizes: tuple[int, ...]) -> DataFrame:
    """(r, mean, sd): mean and standard deviation of the mean pairwise distance of r tips drawn at random, exactly.

    The variance needs three sums over pairs of tips with 2, 1 or 0 tips in
    common; each follows from tip sums of distances, as d is a tree distance.
    """
    tips = nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node")
    d = tip_distances(nodes, depth)
    by_tip = d.groupBy("a").agg(F.sum("d").alias("t"), F.sum(F.col("d") ** 2).alias("q"))
    sums = by_tip.agg(F.sum("t").alias("total"), F.sum(F.col("t") ** 2).alias("tt"), F.sum("q").alias("qq")).crossJoin(tips.agg(F.count("*").cast("double").alias("s")))
    # Ordered pairs: total D; pairs of ordered pairs that share one tip: 4 (sum of t squared - q); the same pair twice: 2 q.
    rows = sums.withColumn("r", F.explode(F.array(*[F.lit(float(x)) for x in sizes]))).where("r <= s")
    s, r, total = F.col("s"), F.col("r"), F.col("total")
    mean = total / (s * (s - 1))
    same, one = F.col("qq"), F.col("tt") - F.col("qq")
    none = total**2 - 2 * same - 4 * one
    p2 = r * (r - 1) / (s * (s - 1))
    p3 = p2 * F.coalesce(F.try_divide(r - 2, s - 2), F.lit(0.0))
    p4 = p3 * F.coalesce(F.try_divide(r - 3, s - 3), F.lit(0.0))
    square = (2 * same * p2 + 4 * one * p3 + none * p4) / (r * (r - 1)) ** 2
    return rows.select(r.cast("int").alias("r"), mean.alias("mean"), F.when(r == s, 0.0).when(r > 1, F.sqrt(F.greatest(square - mean**2, F.lit(0.0)))).alias("sd"))


def expected_mntd(nodes: DataFrame, depth: int, sizes: tuple[int, ...]) -> DataFrame:
    """(r, mean): expected mean distance to the nearest of r random tips of a tree whose tips are equally far from the root, exactly."""
    from quadrat.operators.estimators import log_gamma

    paths = phylo.closure(nodes, depth)
    below = paths.groupBy("node").agg(F.count("*").cast("double").alias("t"), F.first("length").alias("length"))
    total = paths.where("steps = 0").agg(F.count("*").cast("double").alias("s"))
    rows = below.crossJoin(F.broadcast(total)).withColumn("r", F.explode(F.array(*[F.lit(float(x)) for x in sizes]))).where("r <= s and s - t >= r - 1")
    s, t, r = F.col("s"), F.col("t"), F.col("r")
    choose = lambda n, k: log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    share = F.exp(choose(s - t, r - 1) - choose(s, r))
    return rows.groupBy(r.cast("int").alias("r")).agg((F.sum(F.col("length") * t * share) * 2 / F.max(r)).alias("mean"))


