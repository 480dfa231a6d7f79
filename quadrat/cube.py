"""The group x label cube: occ(grp, label, n), one row a pair, and operations that give another cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bin_index(value: Column, size: float, origin: float = 0.0) -> Column:
    """Number of the cell a value falls into.  The quotient is rounded to 1e-10 first, so 0.3 / 0.1 is in cell 3."""
    return F.floor(F.round((value - origin) / size, 10)).cast("long")


def bin_centre(value: Column, size: float, origin: float = 0.0) -> Column:
    """Centre of the cell; a size of 0 leaves the value, a negative size is a text axis."""
    if size < 0:
        return value.cast("string")
    return value.cast("double") if size == 0 else bin_index(value, size, origin) * size + size / 2 + origin


def from_records(rows: DataFrame, groups: Sequence[Column], labels: Sequence[Column], count: Column | None = None, binarise: bool = False) -> DataFrame:
    """Cube of records: axis values joined by ':', counts summed, 1 a record without a count column."""
    key = lambda axes: F.concat_ws(":", *[a.cast("string") for a in axes])
    n = F.lit(1.0) if count is None else F.coalesce(count.cast("double"), F.lit(0.0))
    out = rows.select(key(groups).alias("grp"), key(labels).alias("label"), n.alias("n")).groupBy("grp", "label").agg(F.sum("n").alias("n"))
    return out.withColumn("n", F.lit(1.0)) if binarise else out


def from_wide(rows: DataFrame, group: str, label_columns: Sequence[str]) -> DataFrame:
    """Cube of a site by species table; null and zero cells are dropped."""
    long = rows.select(F.col(group).cast("string").alias("grp"), *label_columns).unpivot("grp", list(label_columns), "label", "n")
    return long.where("n is not null and n <> 0").groupBy("grp", "label").agg(F.sum(F.col("n").cast("double")).alias("n"))


def canonical(spark: SparkSession, sf_dir: str, count: bool = True) -> DataFrame:
    """occ of the order tables: cells of 5 suppliers by 6 months of shipping, labels brand:type, n the quantity, or the number of lines."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    months = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return from_records(rows, [bin_index(F.col("l_suppkey"), 5), bin_index(months, 6)], [F.col("p_brand"), F.col("p_type")], F.col("l_quantity") if count else None)


def groups(occ: DataFrame) -> DataFrame:
    """grp with its axes as x and y, richness, samples and redundancy."""
    g = occ.groupBy("grp").agg(F.count("*").alias("richness"), F.sum("n").alias("samples"))
    axes = F.split("grp", ":")
    return g.select("grp", axes[0].cast("long").alias("x"), axes[1].cast("long").alias("y"), "richness", "samples", (1 - F.try_divide(F.col("richness").cast("double"), F.col("samples"))).alias("redundancy"))


def labels(occ: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """label with range and abundance; overrides(label, range, abundance) count where they are larger."""
    out = occ.groupBy("label").agg(F.count("*").alias("range"), F.sum("n").alias("abundance"))
    if overrides is None:
        return out
    o = overrides.select("label", F.col("range").alias("r"), F.col("abundance").alias("a"))
    return out.join(o, "label", "left").select("label", F.greatest("range", F.coalesce("r", F.lit(-1))).alias("range"), F.greatest("abundance", F.coalesce("a", F.lit(-1.0))).alias("abundance"))


def transpose(occ: DataFrame) -> DataFrame:
    return occ.select(F.col("label").alias("grp"), F.col("grp").alias("label"), "n")


def _regroup(occ: DataFrame) -> DataFrame:
    return occ.groupBy("grp", "label").agg(F.sum("n").alias("n"))


def drop_axis(occ: DataFrame, column: str, axis: int) -> DataFrame:
    """Drops an axis of the keys in `column` (grp or label), counts are summed."""
    parts = F.split(column, ":")
    return _regroup(occ.withColumn(column, F.array_join(F.filter(parts, lambda p, i: i != axis), ":")))


def reorder_axes(occ: DataFrame, column: str, order: Sequence[int]) -> DataFrame:
    parts = F.split(column, ":")
    return _regroup(occ.withColumn(column, F.concat_ws(":", *[parts[i] for i in order])))


def coarsen(occ: DataFrame, factors: Sequence[int]) -> DataFrame:
    """Cells of a cube with integer axes, joined factor by factor."""
    parts = F.split("grp", ":")
    return _regroup(occ.withColumn("grp", F.concat_ws(":", *[F.floor(parts[i].cast("long") / f).cast("string") for i, f in enumerate(factors)])))


def rename(occ: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Renames or merges keys by names(old, new); others stay."""
    m = names.select(F.col("old").alias(column), "new")
    return _regroup(occ.join(m, column, "left").withColumn(column, F.coalesce("new", column)).drop("new"))


def binarise(occ: DataFrame) -> DataFrame:
    return occ.withColumn("n", F.lit(1.0))


def merge(*cubes: DataFrame) -> DataFrame:
    out = cubes[0]
    for c in cubes[1:]:
        out = out.unionByName(c)
    return _regroup(out)


def trim(occ: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    """Keeps, or drops, the labels of names(label)."""
    return occ.join(names.select("label").distinct(), "label", "left_semi" if keep else "left_anti").select("grp", "label", "n")


def exclude(occ: DataFrame, column: str, min_variety: int | None = None, max_variety: int | None = None, min_samples: float | None = None, max_samples: float | None = None, regex: str | None = None, negate: bool = False, names: Sequence[str] = ()) -> DataFrame:
    """Drops groups or labels: at or below a minimum, at or above a maximum, matching (or, negated, not matching) a pattern, or named."""
    e = occ.groupBy(column).agg(F.count("*").alias("v"), F.sum("n").alias("s"))
    drop = F.lit(False)
    for value, bound, low in (("v", min_variety, True), ("v", max_variety, False), ("s", min_samples, True), ("s", max_samples, False)):
        if bound is not None:
            drop = drop | (F.col(value) <= bound if low else F.col(value) >= bound)
    if regex is not None:
        drop = drop | (~F.col(column).rlike(regex) if negate else F.col(column).rlike(regex))
    if names:
        drop = drop | F.col(column).isin(*names)
    return occ.join(e.where(~drop).select(column), column, "left_semi").select("grp", "label", "n")


def range_union(occ: DataFrame, names: DataFrame) -> DataFrame:
    """Groups that hold any of names(label)."""
    return occ.join(names.select("label").distinct(), "label", "left_semi").select("grp").distinct()


def range_intersection(occ: DataFrame, names: DataFrame) -> DataFrame:
    """Groups that hold all of names(label)."""
    wanted = names.select("label").distinct()
    held = occ.join(wanted, "label", "left_semi").groupBy("grp").agg(F.count("*").alias("k"))
    return held.join(wanted.agg(F.count("*").alias("k")), "k").select("grp")


def coordinate_bounds(occ: DataFrame) -> DataFrame:
    """axis, low and high of the numeric axes of groups."""
    axes = occ.select("grp").distinct().select(F.posexplode(F.split("grp", ":")).alias("axis", "v"))
    return axes.groupBy("axis").agg(F.min(F.col("v").cast("double")).alias("low"), F.max(F.col("v").cast("double")).alias("high"))
