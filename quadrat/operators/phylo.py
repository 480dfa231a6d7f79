"""Trees as tables, and phylogenetic indices over them.

nodes(node, parent, length): a root has no parent.  paths(tip, node, length,
steps) is the closure: every node from a tip up to the root.  Indices sum over
the distinct nodes on the paths of a neighbourhood's labels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat import cube


def label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree of the canonical labels: root, brands, brand:type tips and a tip of each brand that no group holds.  Lengths differ: mean size at tips, mean price / 1000 at brands."""
    part = cube.table(spark, sf_dir, "part")
    tips = part.groupBy(F.concat_ws(":", "p_brand", "p_type").alias("node"), F.col("p_brand").alias("parent")).agg(F.avg("p_size").alias("length"))
    brands = part.groupBy(F.col("p_brand").alias("node")).agg((F.avg("p_retailprice") / 1000).alias("length")).select("node", F.lit("root").alias("parent"), "length")
    gone = part.select(F.concat_ws(":", "p_brand", F.lit("gone")).alias("node"), F.col("p_brand").alias("parent")).distinct().withColumn("length", F.lit(7.0))
    root = spark.createDataFrame([("root", None, 0.0)], "node string, parent string, length double")
    return tips.unionByName(gone).unionByName(brands).unionByName(root)


#: Closures of trees that many calculations share, by tree; they go when the tree does.
_KEPT: WeakKeyDictionary[DataFrame, dict[tuple[str, int], DataFrame]] = WeakKeyDictionary()


#: Partitions of a kept tree and its closures.  They are small beside the cube, and each partition of each step is a task that reports to the driver.
PARTS = 8


def keep_closures(nodes: DataFrame) -> DataFrame:
    """The tree, whose closures are persisted from now on, the first time each is asked for."""
    _KEPT[nodes] = {}
    return nodes


def drop_closures(nodes: DataFrame) -> None:
    for kept in _KEPT.pop(nodes, {}).values():
        kept.unpersist()


def kept_closure(kind: str, nodes: DataFrame, depth: int, make: Callable[[], DataFrame]) -> DataFrame:
    if nodes not in _KEPT:
        return make()
    if (kind, depth) not in _KEPT[nodes]:
        _KEPT[nodes][kind, depth] = make().coalesce(PARTS).persist()
    return _KEPT[nodes][kind, depth]


#: Nodes of a tree whose tables go to every task in full.
MOST_SENT = 200_000
_SIZES: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def sent(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """A table with a few rows a node of a tree, to be joined with rows of centres: broadcast unless the tree is large, so that those stay where they are.  The tree is counted once."""
    if nodes not in _SIZES:
        _SIZES[nodes] = nodes.count()
    return F.broadcast(rows) if _SIZES[nodes] <= MOST_SENT else rows


def closure(nodes: DataFrame, depth: int) -> DataFrame:
    """paths of a tree whose tips are `depth` steps below the root at most; `depth` joins with a table of one row a node."""
    return kept_closure("paths", nodes, depth, lambda: _closure(nodes, depth))


def _closure(nodes: DataFrame, depth: int) -> DataFrame:
    tips = nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    step = tips.select(F.col("node").alias("tip"), "node", "parent", "length", F.lit(0).alias("steps"))
    out = step
    up = nodes.select(F.col("node").alias("u"), F.col("parent").alias("p"), F.col("length").alias("l"))
    for k in range(1, depth + 1):
        step = step.join(up, step["parent"] == up["u"]).select("tip", F.col("u").alias("node"), F.col("p").alias("parent"), F.col("l").alias("length"), F.lit(k).alias("steps"))
        out = out.unionByName(step)
    return out.select("tip", "node", "length", "steps")


def equalised(nodes: DataFrame, to: float | None = None) -> DataFrame:
    """Nonzero branch lengths become their mean, or the one given."""
    if to is not None:
        return nodes.select("node", "parent", F.when(F.col("length") != 0, F.lit(to)).otherwise(0.0).alias("length"))
    mean = nodes.where("length <> 0").agg(F.avg("length").alias("m"))
    return nodes.crossJoin(F.broadcast(mean)).select("node", "parent", F.when(F.col("length") != 0, F.col("m")).otherwise(0.0).alias("length"))


def rescaled(nodes: DataFrame, depth: int, longest: float = 1.0) -> DataFrame:
    """Lengths scaled so that the farthest tip is `longest` from the root."""
    far = closure(nodes, depth).groupBy("tip").agg(F.sum("length").alias("d")).agg(F.max("d").alias("far"))
    return nodes.crossJoin(F.broadcast(far)).select("node", "parent", F.coalesce(F.try_divide(F.col("length") * longest, "far"), F.lit(0.0)).alias("length"))


def trimmed(paths: DataFrame, occ: DataFrame) -> DataFrame:
    """Paths of the tips that the cube has."""
    return paths.join(occ.select(F.col("label").alias("tip")).distinct(), "tip", "left_semi")


def node_ranges(occ: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, range): groups that hold a tip below each node."""
    return occ.join(paths, occ["label"] == paths["tip"]).groupBy("node").agg(F.count_distinct("grp").alias("range"))


def group_nodes(occ: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, node, n): samples below each node that a group holds; neighbourhoods share them, so tips are climbed from once.  A group's rows lie in one partition."""
    return occ.repartition("grp").join(paths, F.col("label") == F.col("tip")).groupBy("grp", "node").agg(F.sum(F.coalesce("n", F.lit(0.0))).alias("n"))


def held_ranges(occ: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, r): groups that hold each node.  n is counted as it is never null: so the shuffled cube is the one of group_nodes()."""
    return group_nodes(occ, paths).groupBy("node").agg(F.count("n").alias("r"))


def local_nodes(occ: DataFrame, nbrs: DataFrame, paths: DataFrame) -> DataFrame:
    """(proc, node, k1, k2, n): groups of each set that hold the node, and samples below it.  A centre's rows lie in one partition."""
    held = nbrs.join(group_nodes(occ, paths), "grp").repartition("proc")
    return held.groupBy("proc", "node").agg(F.count_if(F.col("set") == 1).alias("k1"), F.count_if(F.col("set") == 2).alias("k2"), F.sum("n").alias("n"))


#: Sums over a neighbourhood's nodes; len, eq: branch length, and its equalised one; r: the node's range.
AGGREGATES = {
    "PD": "sum(len)", "PDE": "sum(eq)",
    "PA": "sum(case when k1 > 0 and k2 > 0 then len else 0 end)", "PB": "sum(case when k1 > 0 and k2 = 0 then len else 0 end)", "PC": "sum(case when k1 = 0 and k2 > 0 then len else 0 end)",
    "PE": "sum(len * (k1 + k2) / r)", "PEE": "sum(eq * (k1 + k2) / r)", "PES": "sum(len / r)", "PENW": "sum(case when k1 + k2 = r then len else 0 end)",
    "PEC": "sum(case when k1 > 0 then len * (k1 + k2) / r else 0 end)", "PDC": "sum(case when k1 > 0 then len else 0 end)",
    "XA": "sum(case when k1 > 0 and k2 > 0 then len * (k1 + k2) / r else 0 end)", "XB": "sum(case when k1 > 0 and k2 = 0 then len * k1 / r else 0 end)", "XC": "sum(case when k1 = 0 and k2 > 0 then len * k2 / r else 0 end)",
    "PEEC": "sum(case when k1 > 0 then eq * (k1 + k2) / r else 0 end)", "PET": "sum(is_tip * (k1 + k2) / r)",
    "AB": "sum(len * n)", "TIPS": "sum(is_tip)",
    # Length, that with equalised branches, and tips: of the whole tree, and of the one trimmed to the cube's labels.
    "T": "max(tree)", "TE": "max(tree_eq)", "NTIPS": "max(n_tips)", "TT": "max(trim)", "TTE": "max(trim_eq)", "TNTIPS": "max(n_trim_tips)",
}

CALCULATIONS: dict[str, dict[str, str]] = {
    "calc_pd": {"PD": "PD", "PD_P": "PD / nullif(T, 0)"},
    "calc_pd_terminal_node_count": {"PD_INCLUDED_TERMINAL_NODE_COUNT": "TIPS"},
    "calc_count_labels_on_tree": {"PHYLO_LABELS_ON_TREE_COUNT": "TIPS"},
    "calc_pe": {"PE_WE": "PE", "PE_WE_P": "PE / nullif(TT, 0)"},
    "calc_pe_single": {"PE_WE_SINGLE": "PES", "PE_WE_SINGLE_P": "PES / nullif(TT, 0)"},
    "calc_pe_central": {"PEC_WE": "PEC", "PEC_WE_P": "PEC / nullif(TT, 0)"},
    "calc_pe_central_cwe": {"PEC_CWE": "PEC / nullif(PDC, 0)", "PEC_CWE_PD": "PDC"},
    "calc_pd_endemism": {"PD_ENDEMISM": "PENW", "PD_ENDEMISM_P": "PENW / nullif(TT, 0)"},
    "calc_phylo_corrected_weighted_endemism": {"PE_CWE": "PE / nullif(PD, 0)"},
    "calc_phylo_abundance": {"PHYLO_ABUNDANCE": "AB"},
    "calc_phylo_abc": {"PHYLO_A": "PA", "PHYLO_B": "PB", "PHYLO_C": "PC", "PHYLO_ABC": "PA + PB + PC"},
    "calc_phylo_sorenson": {"PHYLO_SORENSON": "1 - 2 * PA / nullif(2 * PA + PB + PC, 0)"},
    "calc_phylo_jaccard": {"PHYLO_JACCARD": "1 - PA / nullif(PA + PB + PC, 0)"},
    "calc_phylo_s2": {"PHYLO_S2": "1 - PA / nullif(PA + least(PB, PC), 0)"},
    "calc_phylo_rw_turnover": {"PHYLO_RW_TURNOVER": "1 - XA / nullif(XA + XB + XC, 0)", "PHYLO_RW_TURNOVER_A": "XA", "PHYLO_RW_TURNOVER_B": "XB", "PHYLO_RW_TURNOVER_C": "XC"},
    "calc_phylo_rpd1": {"PHYLO_RPD1": "PD / nullif(T, 0) / nullif(1e0 * TIPS / nullif(NTIPS, 0), 0)", "PHYLO_RPD_NULL1": "1e0 * TIPS / nullif(NTIPS, 0)", "PHYLO_RPD_DIFF1": "T * (PD / nullif(T, 0) - 1e0 * TIPS / nullif(NTIPS, 0))"},
    "calc_phylo_rpd2": {"PHYLO_RPD2": "PD / nullif(T, 0) / nullif(PDE / nullif(TE, 0), 0)", "PHYLO_RPD_NULL2": "PDE / nullif(TE, 0)", "PHYLO_RPD_DIFF2": "T * (PD / nullif(T, 0) - PDE / nullif(TE, 0))"},
    "calc_phylo_rpe1": {"PHYLO_RPE1": "PE / nullif(TT, 0) / nullif(PET / nullif(TNTIPS, 0), 0)", "PHYLO_RPE_NULL1": "PET / nullif(TNTIPS, 0)", "PHYLO_RPE_DIFF1": "TT * (PE / nullif(TT, 0) - PET / nullif(TNTIPS, 0))"},
    "calc_phylo_rpe_central": {"PHYLO_RPEC": "PEC / nullif(TT, 0) / nullif(PEEC / nullif(TTE, 0), 0)", "PHYLO_RPE_NULLC": "PEEC / nullif(TTE, 0)", "PHYLO_RPE_DIFFC": "TT * (PEC / nullif(TT, 0) - PEEC / nullif(TTE, 0))"},
    "calc_phylo_rpe2": {"PHYLO_RPE2": "PE / nullif(TT, 0) / nullif(PEE / nullif(TTE, 0), 0)", "PHYLO_RPE_NULL2": "PEE / nullif(TTE, 0)", "PHYLO_RPE_DIFF2": "TT * (PE / nullif(TT, 0) - PEE / nullif(TTE, 0))"},
}


def measured(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """(node, len, eq, is_tip) of nodes; tips(tip)."""
    return equalised(nodes, 1.0).select("node", F.col("length").alias("eq")).join(nodes.select("node", F.col("length").alias("len")), "node").join(tips.select(F.col("tip").alias("node"), F.lit(1).alias("is_tip")), "node", "left").withColumn("is_tip", F.coalesce("is_tip", F.lit(0)))


def rows_of(occ: DataFrame, nbrs: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """A row for each node of a centre, of the tree trimmed to the cube's labels: local and global ranges, lengths, and totals of the whole tree and of the trimmed one."""
    whole = closure(nodes, depth)
    # The cube joins with the paths of its own labels only, so they need no trimming.
    paths = sent(nodes, whole.select("tip", "node"))
    every = measured(nodes, whole.where("steps = 0").select("tip"))
    known = every.join(sent(nodes, held_ranges(occ, paths)), "node")
    sums = lambda rows, a, b, c: rows.agg(F.sum("len").alias(a), F.sum("eq").alias(b), F.sum("is_tip").alias(c))
    totals = sums(every, "tree", "tree_eq", "n_tips").crossJoin(sums(known, "trim", "trim_eq", "n_trim_tips"))
    return local_nodes(occ, nbrs, paths).join(sent(nodes, known), "node").crossJoin(F.broadcast(totals))


def calculate(occ: DataFrame, nbrs: DataFrame, nodes: DataFrame, depth: int, names: Sequence[str], digits: int = 8) -> DataFrame:
    """(proc, indices...) over the tree; what is relative to its length takes the whole tree for PD and the trimmed one for PE."""
    summed = rows_of(occ, nbrs, nodes, depth).groupBy("proc").agg(*[F.expr(e).alias(a) for a, e in AGGREGATES.items()])
    columns = {i: e for n in names for i, e in CALCULATIONS[n].items()}
    return summed.select("proc", *[F.round(F.expr(e).cast("double"), digits).alias(i) for i, e in columns.items()])


def patristic(paths: DataFrame) -> DataFrame:
    """(a, b, distance) of tips a < b.

    Distance is the sum of both root distances less twice that of the last
    shared ancestor, the shared node with the largest distance from the root.
    """
    up = paths.groupBy("tip").agg(F.sum("length").alias("d"))
    below = paths.alias("p").join(paths.alias("q"), F.expr("p.tip = q.tip and q.steps >= p.steps")).groupBy(F.col("p.tip").alias("tip"), F.col("p.node").alias("node")).agg(F.sum("q.length").alias("h"))
    pair = below.alias("a").join(below.alias("b"), F.expr("a.node = b.node and a.tip < b.tip")).groupBy(F.col("a.tip").alias("a"), F.col("b.tip").alias("b")).agg(F.max("a.h").alias("h"))
    return pair.join(up.select(F.col("tip").alias("a"), F.col("d").alias("da")), "a").join(up.select(F.col("tip").alias("b"), F.col("d").alias("db")), "b").select("a", "b", (F.col("da") + F.col("db") - 2 * F.col("h")).alias("distance"))
