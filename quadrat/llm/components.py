"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``; the component is its smallest node.

    A large-star round hangs a node's larger neighbours, and a small-star round
    its smaller ones, under the smallest node near it; each is one aggregate and
    one join, and rounds grow with the logarithm of the longest path; they end
    when one changes nothing.  Edges are written to the shared folder in each
    round, so a lost executor costs one round at most.  A star's centre is
    aggregated before the shuffle; its edges meet its row in a sort-merge join,
    which adaptive execution splits.  An empty edge table gives an empty result.
    """
    rows = table(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = rows.union(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        rows = table(small.select("e.a", "e.b").where("a <> b").distinct())
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    star = rows.groupBy("a").agg(F.min("b").alias("component"))
    return star.select(F.col("a").alias("node"), "component").union(star.select(F.col("component").alias("node"), "component").distinct())
