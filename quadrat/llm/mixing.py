"""Mixing sources to target weights, in DataFrame functions alone.

A source's documents are laid out in a permuted order (by a seeded hash) and
cut into blocks.  The source's target buys whole passes over its blocks and a
last part of a pass.  The blocks bought are the units that are dealt to output
shards: a splitting tree halves the range of shards and draws, at each node,
how many of each source's blocks go left from the multivariate hypergeometric
distribution, so quotas are exact and every shard is a fair sample.  A shard
then takes its quota of blocks from the source's permuted list, disjoint from
the others', and rows are shuffled inside the shard.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import WORD, table

#: Weights of the sources in their order, repeating, and the most passes over a source.
WEIGHTS = (1.0, 2.0, 3.0)
PASSES = 3
#: Rows of a block, and the most blocks of a source: beyond, its blocks grow.
BLOCK_ROWS = 128
MOST_BLOCKS = 1 << 16
#: Shards: LEAST_SHARDS, or more, of SHARD_WORDS words each.
LEAST_SHARDS, SHARD_WORDS = 16, 1 << 26
#: Sources whose rows are broadcast; of more they meet in a shuffle.
BROADCAST_SOURCES = 10_000


def sizes(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(missing, source, n, source_size, target) of each source of rows(missing, source, size).

    Targets share the size of all by weight; one above passes times its
    source's size is cut to that, and the rest is shared again until none is
    above.  That ends at target = min(cap, weight * level) with one level for
    all, which two running sums along cap / weight give.  Windows here run
    over one row a source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("i") - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    s = rows.groupBy("missing", "source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    s = s.withColumn("i", F.row_number().over(every.orderBy("missing", "source"))).withColumn("w", w)
    s = s.withColumn("cap", passes * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    along = every.orderBy("ratio", "i")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "i", "level"))).over(every)["level"])
    return s.select("missing", "source", "n", "source_size", F.round(F.least(F.col("cap"), F.col("level") * F.col("w")), 6).alias("target"))


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` units, taken without replacement, are among the good: inversion outward from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(c(good, mode) + c(bad, drawn - mode) - c(good + bad, drawn))
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def splitting_tree(blocks: list[int], shards: int, rng: random.Random) -> list[list[int]]:
    """Quotas by shard and source: each node sends its left half a multivariate hypergeometric draw of its blocks."""
    if shards == 1:
        return [blocks]
    left = shards // 2
    rest, drawn, taken = sum(blocks), sum(blocks) * left // shards, []
    for b in blocks:
        rest -= b
        x = hypergeometric(rng, b, rest, drawn)
        taken.append(x)
        drawn -= x
    return splitting_tree(taken, left, rng) + splitting_tree([b - x for b, x in zip(blocks, taken, strict=True)], shards - left, rng)


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    """What the plan needs of each row: doc_id, missing and source, size, and the hash u that gives its place."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(docs, seed), sizes(F.col("text")).alias("size"))


def _key(docs: DataFrame, seed: int) -> list[Column]:
    # The text is hashed, so that rows under one doc_id have places of their own.
    return [docs["source"].isNull().alias("missing"), F.coalesce(docs["source"], F.lit("")).alias("source"), F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("u")]


def _with_block(rows: DataFrame, share: DataFrame) -> DataFrame:
    """Rows with their source's columns and their block: the hash's upper 48 bits as a share of the whole."""
    part = (F.shiftrightunsigned("u", 16) * F.col("n_blocks") / F.lit(float(1 << 48))).cast("long")
    return rows.join(share, ["missing", "source"]).withColumn("block", part)


def _copies(rows: DataFrame, blocks: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows with ``copies``: array<struct<pass, shard>> of those of their block's that they are part of."""
    keys = ["missing", "source", "block"]
    rows = rows.join(blocks.select(*keys, "whole", "upto", "words", "rest", "copies"), keys, "left").join(picks, [*keys, "u"], "left")
    # Of the last pass, blocks wholly below its end are taken whole, and the one at its end row by row.
    last = (F.col("upto") <= F.col("rest")) | F.coalesce("pick", F.lit(False))
    some = F.filter("copies", lambda c: (c["pass"] < F.col("whole")) | last)
    return rows.withColumn("copies", F.coalesce(some, F.array().cast("array<struct<pass:int,shard:int>>"))).drop("whole", "upto", "words", "rest", "pick")


def plan(narrow: DataFrame, shards: int | None = None, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(share, blocks, picks) of rows(missing, source, size, u): sources with their targets, blocks with their copies in shards, and rows taken of the blocks where a last pass ends.

    A row is taken 0 to `passes` times.  The same rows, seed and weights give
    the same plan, however the rows are partitioned.  shards: SHARD_WORDS words
    each if not given, LEAST_SHARDS at least.
    """
    spark = narrow.sparkSession
    keys = ["missing", "source"]
    share = table(targets(narrow, weights, passes).withColumn("n_blocks", F.least(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(MOST_BLOCKS)).cast("long")))
    # A row a source: sent to all tasks while there are no more than BROADCAST_SOURCES.
    if share.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        share = F.broadcast(share)
    rows = _with_block(narrow, share)

    in_source = Window.partitionBy(*keys)
    blocks = rows.groupBy(*keys, "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = blocks.withColumn("upto", F.sum("words").over(in_source.orderBy("block")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    blocks = blocks.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # `left`: words of the last pass that this block may still give.
    blocks = blocks.withColumn("left", F.col("rest") - (F.col("upto") - F.col("words")))
    blocks = table(blocks.withColumn("units", F.col("whole") + F.when((F.col("left") > 0) & (F.col("words") > 0), 1).otherwise(0)))

    # One number a source comes to the driver, where the tree is drawn.
    counts = blocks.groupBy(*keys).agg(F.sum("units").cast("long").alias("units"), F.max("target").alias("target")).orderBy(*keys).collect()
    shards = shards or max(LEAST_SHARDS, math.ceil(sum(r["target"] for r in counts) / SHARD_WORDS))
    quotas = splitting_tree([r["units"] for r in counts], shards, random.Random(seed))
    upto: list[tuple] = []
    for s, r in enumerate(counts):
        ends, n = [], 0
        for q in quotas:
            n += q[s]
            ends.append(n)
        upto.append((r["missing"], r["source"], ends))
    ends = spark.createDataFrame(upto, "missing boolean, source string, ends array<long>")

    units = blocks.where("units > 0").select(*keys, "block", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("pass"))
    nth = F.row_number().over(in_source.orderBy(F.xxhash64(F.lit(seed + 1), "block", "pass"), "block", "pass"))
    units = units.withColumn("nth", nth).join(ends, keys)
    shard = F.size(F.filter("ends", lambda e: e < F.col("nth")))
    dealt = units.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct(F.col("pass").cast("int").alias("pass"), shard.alias("shard")))).alias("copies"))

    # A block a source where its last pass ends: rows in the order of their hashes, those that are longer than what is left behind the others.
    ends_in = blocks.where("left > 0 and upto > rest").select(*keys, "block", "left")
    same = rows.join(ends_in, [*keys, "block"]).groupBy(*keys, "block", "u").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    before = F.sum("size").over(Window.partitionBy(*keys, "block").orderBy(F.col("size") > 2 * F.col("left"), "u").rowsBetween(Window.unboundedPreceding, -1))
    picks = same.withColumn("pick", (F.col("size") > 0) & (F.coalesce(before, F.lit(0)) + F.col("size") / 2 <= F.col("left"))).where("pick").select(*keys, "block", "u", "pick")
    return share, table(blocks.join(dealt, [*keys, "block"], "left")), table(picks)


def mix(docs: DataFrame, shards: int | None = None, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mix itself: rows of docs, once for each time they are taken, in shards that are shuffled inside.

    A shard's rows are dealt over up to 16 partitions, each of which holds them
    in a shuffled order.  Returns the columns of docs under their names, whatever
    these are.  A row without words is part of whole passes only; repeated rows
    are rows of their own; see mix_digest for nulls, ties and long texts.
    """
    share, blocks, picks = plan(table(_narrow(docs, seed)), shards, seed, weights, passes)
    rows = _with_block(docs.select(F.struct("*").alias("row"), *_key(docs, seed)), share)
    taken = _copies(rows, blocks, picks).select("row", "u", F.explode("copies").alias("c"))
    taken = taken.withColumn("at", F.xxhash64(F.lit(seed + 2), "u", "c.pass"))
    return taken.repartition(F.col("c.shard"), F.shiftrightunsigned("at", 60)).sortWithinPartitions("c.shard", "at").select("row.*")


def mix_digest(docs: DataFrame, shards: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of it) of each row of docs.

    A null text has size 0, rows without a source form a source that comes
    last, a null doc_id is a value, repeated rows are taken alike, an empty table
    gives no rows, a text of any length is one unit, and a source's taken words
    miss its target by half its longest row at most; other columns are left out.
    """
    narrow = table(_narrow(docs, seed))
    share, blocks, picks = plan(narrow, shards, seed)
    rows = _copies(_with_block(narrow, share), blocks, picks)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))
