"""Pairwise matrices and agglomerative clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements that are clustered on the driver: the matrix of more would not fit there.
MOST_ELEMENTS = 5000
#: Blocks of groups whose pairs meet in tasks, and words of bits that are columns.
BLOCKS = 48
MOST_WORDS = 64
INDICES = {"SORENSON": "1 - 2 * A / (v1 + v2)", "JACCARD": "1 - A / (v1 + v2 - A)", "S2": "1 - A / least(v1, v2)"}
LINKAGES = ("link_average", "link_average_unweighted", "link_minimum", "link_maximum")


def _packed(occ: DataFrame) -> tuple[DataFrame, int]:
    """(grp, v, w0, w1, ...) and the number of words: a group's labels, numbered, as bits of 64 to a word."""
    names = occ.select("label").distinct()
    words = names.count() // 64 + 1
    # One row a label meets in the window that numbers them.
    number = names.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")))
    if words <= MOST_WORDS:
        number = F.broadcast(number)
    bits = lambda k: F.bit_or(F.when(F.col("i").between(64 * k, 64 * k + 63), F.expr("shiftleft(1L, i % 64)")).otherwise(0)).alias(f"w{k}")
    made = occ.join(number, "label")
    return (made.groupBy("grp").agg(F.count("*").alias("v"), *map(bits, range(words))), words) if words <= MOST_WORDS else (made, words)


def pair_counts(occ: DataFrame, nbrs: DataFrame | None = None) -> DataFrame:
    """(e1, e2, v1, v2, A) with e1 < e2: labels of each group and those they share, of all pairs of groups, or of the pairs of nbrs(proc, grp) only.

    Labels are numbered and a group's are packed as bits, 64 to a word.  Groups
    are dealt into BLOCKS blocks, and each pair of blocks meets in a task, where
    pairs are made and compared one by one; they are never shuffled.  Beyond
    MOST_WORDS words shared labels come from a join on the word instead, so pairs
    without a word in common are not compared.
    """
    packed, words = _packed(occ)
    if words > MOST_WORDS:
        return _sparse_counts(occ, packed, nbrs)
    side = lambda n: packed.select(F.col("grp").alias(f"e{n}"), F.col("v").alias(f"v{n}"), *[F.col(f"w{k}").alias(f"w{n}_{k}") for k in range(words)])
    if nbrs is None:
        every, block = F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda n: F.pmod(F.xxhash64(f"e{n}"), F.lit(BLOCKS)).cast("int")
        one = side(1).select("*", block(1).alias("i"), F.explode(every).alias("j"))
        two = side(2).select("*", F.explode(every).alias("i"), block(2).alias("j"))
        rows = one.join(two, ["i", "j"]).where("e1 < e2")
    else:
        rows = _near(nbrs).join(side(1), "e1").join(side(2), "e2")
    shared = sum((F.bit_count(F.col(f"w1_{k}").bitwiseAND(F.col(f"w2_{k}"))) for k in range(words)), F.lit(0))
    return rows.select("e1", "e2", "v1", "v2", shared.cast("double").alias("A"))


def _near(nbrs: DataFrame) -> DataFrame:
    return nbrs.select(F.least("proc", "grp").alias("e1"), F.greatest("proc", "grp").alias("e2")).where("e1 < e2").distinct()


def _sparse_counts(occ: DataFrame, numbered: DataFrame, nbrs: DataFrame | None) -> DataFrame:
    size = occ.groupBy("grp").agg(F.count("*").alias("v"))
    bits = numbered.groupBy("grp", F.floor(F.col("i") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, i % 64)")).alias("bits"))
    a, b = bits.select(F.col("grp").alias("e1"), "word", F.col("bits").alias("b1")), bits.select(F.col("grp").alias("e2"), "word", F.col("bits").alias("b2"))
    held = a.join(b, "word").where("e1 < e2")
    shared = held.groupBy("e1", "e2").agg(F.sum(F.bit_count(F.col("b1").bitwiseAND(F.col("b2")))).alias("A"))
    s1, s2 = size.select(F.col("grp").alias("e1"), F.col("v").alias("v1")), size.select(F.col("grp").alias("e2"), F.col("v").alias("v2"))
    pairs = s1.join(s2, F.col("e1") < F.col("e2")) if nbrs is None else _near(nbrs).join(s1, "e1").join(s2, "e2")
    return pairs.join(shared, ["e1", "e2"], "left").select("e1", "e2", "v1", "v2", F.coalesce("A", F.lit(0)).cast("double").alias("A"))


def pair_matrix(occ: DataFrame, index: str = "SORENSON", nbrs: DataFrame | None = None, digits: int = 8) -> DataFrame:
    """(e1, e2, value) with e1 < e2: SORENSON, JACCARD or S2 of each pair of groups, or of the pairs of nbrs(proc, grp) only; 1 without a label in common."""
    return pair_counts(occ, nbrs).select("e1", "e2", F.round(F.expr(INDICES[index]), digits).alias("value"))


def agglomerate(matrix: DataFrame, linkage: str = "link_average", maximise: bool = False) -> DataFrame:
    """(node, parent, value, n_tips) of the cluster tree; inner nodes are 0___, 1___, ... in the order of merging.

    Of equally near pairs the one with the first names merges.  The matrix of
    at most MOST_ELEMENTS elements comes to the driver, which is checked first.
    """
    spark = matrix.sparkSession
    names = sorted(r[0] for r in matrix.select(F.explode(F.array("e1", "e2")).alias("e")).distinct().limit(MOST_ELEMENTS + 1).collect())
    if len(names) > MOST_ELEMENTS:
        raise ValueError(f"more than {MOST_ELEMENTS} elements to cluster")
    at = {e: i for i, e in enumerate(names)}
    n = len(names)
    d = np.full((n, n), np.inf)
    for e1, e2, value in matrix.collect():
        d[at[e1], at[e2]] = d[at[e2], at[e1]] = -value if maximise else value
    size, live, label, out = np.ones(n), np.ones(n, bool), list(names), []
    for k in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        if not np.isfinite(d[i, j]):
            break
        i, j = min(i, j), max(i, j)
        value, node = float(-d[i, j] if maximise else d[i, j]), f"{k}___"
        out += [(label[i], node, value, int(size[i])), (label[j], node, value, int(size[j]))]
        a, b = d[i], d[j]
        merged = {
            "link_average": (size[i] * a + size[j] * b) / (size[i] + size[j]),
            "link_average_unweighted": (a + b) / 2,
            "link_minimum": np.minimum(a, b),
            "link_maximum": np.maximum(a, b),
        }[linkage]
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        live[j], size[i], label[i] = False, size[i] + size[j], node
    out += [(label[i], None, None, int(size[i])) for i in np.flatnonzero(live)]
    return spark.createDataFrame(out, "node string, parent string, value double, n_tips int")


def cut(tree: DataFrame, clusters: int) -> DataFrame:
    """(element, cluster): the tree cut into so many clusters by undoing the last merges."""
    spark = tree.sparkSession
    rows = tree.collect()
    up = {r["node"]: r["parent"] for r in rows}
    order = sorted({p for p in up.values() if p}, key=lambda s: int(s[:-3]))
    undone = set(order[len(order) - (clusters - 1) :]) if clusters > 1 else set()
    inner, out = set(order), []
    for tip in (n for n in up if n not in inner):
        node = tip
        while up[node] is not None and up[node] not in undone:
            node = up[node]
        out.append((tip, node))
    return spark.createDataFrame(out, "element string, cluster string")


def linked(matrix: DataFrame, one: str, two: str, name: str, linkage: str, sizes: DataFrame | None = None) -> DataFrame:
    """The matrix after `one` and `two` have merged into `name`: a step of clustering as a join, for matrices of any size.

    sizes(element, tips) weighs link_average; both elements' values to every
    other one are combined, and their own rows go.
    """
    both = matrix.select(F.col("e1").alias("e"), F.col("e2").alias("o"), "value").union(matrix.select("e2", "e1", "value"))
    mine = both.where(F.col("e").isin(one, two) & ~F.col("o").isin(one, two))
    if linkage == "link_average":
        mine = mine.join(sizes.select(F.col("element").alias("e"), "tips"), "e")
        value = F.sum(F.col("value") * F.col("tips")) / F.sum("tips")
    else:
        value = {"link_average_unweighted": F.avg, "link_minimum": F.min, "link_maximum": F.max}[linkage]("value")
    new = mine.groupBy("o").agg(value.alias("value")).select(F.least("o", F.lit(name)).alias("e1"), F.greatest("o", F.lit(name)).alias("e2"), "value")
    return matrix.where(~F.col("e1").isin(one, two) & ~F.col("e2").isin(one, two)).unionByName(new)


def recalculated(occ: DataFrame, one: str, two: str, name: str, index: str = "SORENSON") -> DataFrame:
    """The matrix after the merge, with the index of the merged assemblage made anew."""
    merged = occ.withColumn("grp", F.when(F.col("grp").isin(one, two), name).otherwise(F.col("grp"))).groupBy("grp", "label").agg(F.sum("n").alias("n"))
    return pair_matrix(merged, index)


def most_similar(matrix: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """(e1, e2, value) of the least value; of ties the pair with the largest tie, a column of the matrix or of ties(e1, e2, tie), then the first names."""
    rows = matrix if ties is None else matrix.join(ties, ["e1", "e2"])
    order = F.struct("value", *([(-F.col("tie")).alias("tie")] if "tie" in rows.columns else []), "e1", "e2")
    return rows.agg(F.min(order).alias("m")).select("m.e1", "m.e2", "m.value")
