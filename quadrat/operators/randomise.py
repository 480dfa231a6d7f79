"""Randomisations and the comparison of indices with them.

Iterations are a key column: one job makes and analyses them all, and a final
aggregation compares.  Models whose steps depend on each other run one
iteration in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iterations(occ: DataFrame, count: int) -> DataFrame:
    return occ.crossJoin(occ.sparkSession.range(count).select(F.col("id").cast("int").alias("iter")))


def csr_by_group(occ: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(iter, grp, label, n): whole assemblages move to other groups."""
    each = iterations(occ.select("grp").distinct(), count)
    old = Window.partitionBy("iter").orderBy("grp")
    new = Window.partitionBy("iter").orderBy(F.xxhash64(F.lit(seed), "iter", "grp"), "grp")
    ranked = each.select("iter", "grp", F.row_number().over(old).alias("i"), F.row_number().over(new).alias("j"))
    moves = ranked.select("iter", F.col("grp").alias("old"), "i").join(ranked.select("iter", F.col("grp").alias("new"), F.col("j").alias("i")), ["iter", "i"])
    return moves.join(occ, F.col("old") == F.col("grp")).select("iter", F.col("new").alias("grp"), "label", "n")


def _per_iteration(occ: DataFrame, count: int, model) -> DataFrame:
    return iterations(occ, count).groupBy("iter").applyInPandas(model, "iter int, grp string, label string, n double")


def curveball(occ: DataFrame, count: int, seed: int = 1, trades: int | None = None) -> DataFrame:
    """Pairs of groups trade the labels they don't share; richness and ranges stay."""

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["grp", "label"])
        it = int(rows["iter"].iloc[0])
        rng = np.random.default_rng((seed, it))
        held = {g: set(x) for g, x in rows.groupby("grp")["label"]}
        names = sorted(held)
        for _ in range(trades or 5 * len(names)):
            if len(names) < 2:
                break
            a, b = (names[i] for i in rng.choice(len(names), 2, replace=False))
            mine, other = sorted(held[a] - held[b]), sorted(held[b] - held[a])
            pool = mine + other
            rng.shuffle(pool)
            both = held[a] & held[b]
            held[a], held[b] = both | set(pool[: len(mine)]), both | set(pool[len(mine) :])
        out = [(it, g, s) for g in names for s in sorted(held[g])]
        frame = pd.DataFrame(out, columns=["iter", "grp", "label"])
        # A label's counts are dealt to its new groups.
        frame, rows = frame.sort_values("label", kind="stable"), rows.sort_values("label", kind="stable")
        return frame.assign(n=rows["n"].to_numpy())

    return _per_iteration(occ, count, model)


def independent_swaps(occ: DataFrame, count: int, seed: int = 1, swaps: int | None = None) -> DataFrame:
    """2 x 2 checkerboards flip: twice as many as there are cells, with 100 attempts each at most."""

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["grp", "label"])
        it = int(rows["iter"].iloc[0])
        rng = np.random.default_rng((seed, it))
        g, s, n = rows["grp"].to_numpy(copy=True), rows["label"].to_numpy(copy=True), rows["n"].to_numpy()
        cells = set(zip(g, s, strict=True))
        wanted = swaps or 2 * len(g)
        done, tries = 0, 0
        while done < wanted and tries < 100 * wanted and len(g) > 1:
            for i, j in rng.integers(0, len(g), (4096, 2)):
                tries += 1
                if g[i] != g[j] and s[i] != s[j] and (g[i], s[j]) not in cells and (g[j], s[i]) not in cells:
                    cells -= {(g[i], s[i]), (g[j], s[j])}
                    g[i], g[j] = g[j], g[i]
                    cells |= {(g[i], s[i]), (g[j], s[j])}
                    done += 1
                if done >= wanted or tries >= 100 * wanted:
                    break
        return pd.DataFrame({"iter": it, "grp": g, "label": s, "n": n})

    return _per_iteration(occ, count, model)


def structured(occ: DataFrame, count: int, seed: int = 1, multiplier: float = 1.0, addition: float = 0.0) -> DataFrame:
    """Labels fill groups in random order up to their richness targets; leftovers swap their way in.  Ranges stay."""

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["grp", "label"])
        it = int(rows["iter"].iloc[0])
        rng = np.random.default_rng((seed, it))
        target = {g: int(k * multiplier + addition) for g, k in rows.groupby("grp").size().items()}
        names = sorted(target)
        held: dict[str, dict[str, float]] = {g: {} for g in names}
        by_label = {s: list(x) for s, x in rows.groupby("label")["n"]}
        todo = [(s, n) for s in rng.permutation(sorted(by_label)) for n in by_label[s]]
        for _ in range(200 * max(1, len(todo))):
            if not todo:
                break
            s, n = todo.pop()
            open_ = [g for g in names if len(held[g]) < target[g] and s not in held[g]]
            if open_:
                held[open_[rng.integers(len(open_))]][s] = n
                continue
            # Every open group has the label: it takes another's place, which goes to the pool.
            full = [g for g in names if s not in held[g] and held[g]]
            if not full:
                todo.append((s, n))
                break
            g = full[rng.integers(len(full))]
            free = {x for o in names if len(held[o]) < target[o] for x in held[g] if x not in held[o]}
            out = sorted(free or held[g])
            out = out[rng.integers(len(out))]
            todo.insert(0, (out, held[g].pop(out)))
            held[g][s] = n
        # What found no place within the attempts goes beyond a target rather than away.
        for s, n in todo:
            g = min((g for g in names if s not in held[g]), key=lambda g: (len(held[g]) - target[g], g))
            held[g][s] = n
        return pd.DataFrame([(it, g, s, n) for g in names for s, n in sorted(held[g].items())], columns=["iter", "grp", "label", "n"])

    return _per_iteration(occ, count, model)


def compare(base: DataFrame, randomised: DataFrame, indices: list[str]) -> DataFrame:
    """(proc, idx, C, T, Q, SUMX, SUMXX, P): how often base exceeds the randomised values; pairs with a null don't count."""
    long = lambda df, keys, v: df.unpivot(keys, indices, "idx", v)
    rows = long(randomised, ["iter", "proc"], "x").join(long(base, ["proc"], "b"), ["proc", "idx"]).where("x is not null and b is not null")
    d = F.col("b") - F.col("x")
    out = rows.groupBy("proc", "idx").agg(
        F.count_if(d > 1e-10).alias("C"), F.count_if(F.abs(d) <= 1e-10).alias("T"), F.count("*").alias("Q"),
        F.sum("x").alias("SUMX"), F.sum(F.col("x") * F.col("x")).alias("SUMXX"), F.first("b").alias("base"),
    )
    return out.withColumn("P", F.col("C") / F.col("Q"))


def reintegrate(*counters: DataFrame) -> DataFrame:
    """Counters of separate runs, summed."""
    rows = counters[0]
    for c in counters[1:]:
        rows = rows.unionByName(c)
    out = rows.groupBy("proc", "idx").agg(*[F.sum(c).alias(c) for c in ("C", "T", "Q", "SUMX", "SUMXX")], F.first("base").alias("base"))
    return out.withColumn("P", F.col("C") / F.col("Q"))


def p_rank() -> Column:
    """P above one half, else the share of values not below."""
    return F.when(F.col("P") > 0.5, F.col("P")).otherwise((F.col("C") + F.col("T")) / F.col("Q"))


def z_score() -> Column:
    mean = F.col("SUMX") / F.col("Q")
    variance = F.greatest(F.col("SUMXX") / F.col("Q") - mean * mean, F.lit(0.0))
    return F.when(variance > 0, (F.col("base") - mean) / F.sqrt(variance)).otherwise(0.0)


def significance(tails: int = 1) -> Column:
    """Signed threshold (0.01, 0.05) that a rank passes, or null."""
    rank = p_rank()
    out = F.lit(None).cast("double")
    for level in (0.05, 0.01):
        cut_ = level / tails
        out = F.when(rank > 1 - cut_, F.lit(level)).when(rank < cut_, F.lit(-level)).otherwise(out)
    return out


def rank_threshold() -> Column:
    """The outermost of 0.995, 0.99, 0.975 and 0.95 that P lies above, or of 0.005, 0.01, 0.025 and 0.05 that the share of values not below lies under; else null."""
    low = (F.col("C") + F.col("T")) / F.col("Q")
    out = F.lit(None).cast("double")
    for level in (0.05, 0.025, 0.01, 0.005):
        out = F.when(low < level, level).otherwise(out)
    for level in (0.95, 0.975, 0.99, 0.995):
        out = F.when(F.col("P") > level, level).otherwise(out)
    return out


def unchanged(occ: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """The cube itself in every iteration."""
    return iterations(occ, count).select("iter", "grp", "label", "n")


def shuffled_properties(props: DataFrame, groups: DataFrame, count: int, seed: int = 1, by_item: bool = False) -> DataFrame:
    """(iter, grp, prop, value): groups swap their property sets, or, by_item, each property for itself among the groups that have it.

    A window runs over the groups of an iteration, and of a property by_item.
    """
    keys = ["iter", "prop"] if by_item else ["iter"]
    each = iterations(props.select("grp", "prop").distinct() if by_item else groups.select("grp").distinct(), count)
    old = F.row_number().over(Window.partitionBy(*keys).orderBy("grp"))
    new = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, "grp"), "grp"))
    ranked = each.select(*keys, "grp", old.alias("i"), new.alias("j"))
    moves = ranked.select(*keys, F.col("grp").alias("from"), "i").join(ranked.select(*keys, F.col("grp").alias("to"), F.col("j").alias("i")), [*keys, "i"])
    sets = props.select(F.col("grp").alias("from"), "prop", "value")
    return moves.join(sets, ["from", "prop"] if by_item else ["from"]).select("iter", F.col("to").alias("grp"), "prop", "value")


def canape(observed: Column, null: Column, ratio: Column) -> Column:
    """Codes from ranks: 0 none, 1 neo, 2 palaeo, 3 mixed, 4 super."""
    endemic = (observed > 0.95) | (null > 0.95)
    return (
        F.when(~endemic, F.lit(0))
        .when(ratio < 0.025, F.lit(1))
        .when(ratio > 0.975, F.lit(2))
        .when((observed > 0.99) & (null > 0.99), F.lit(4))
        .otherwise(F.lit(3))
    )
