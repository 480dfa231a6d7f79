"""Spatial conditions and the joins that answer them.

A condition is a predicate over a centre ``c`` and a candidate ``b`` with
columns grp, x, y, richness, redundancy, plus what the planner may use of it:
a reach, for a join on coarse blocks, or a key, for a join on equality.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_D = lambda a: F.abs(F.col(f"c.{a}") - F.col(f"b.{a}"))


@dataclass(frozen=True)
class Condition:
    test: Callable[[], Column]
    #: Largest distance on an axis at which the test can hold.
    reach: float | None = None
    #: Expression over the axes that is equal for centre and candidate where the test holds.
    key: Callable[[str], Column] | None = None
    kind: str = "complex"
    names: DataFrame | None = None
    #: Whether the test asks of the candidate alone, so that every centre has the same neighbours.
    alone: bool = False
    #: Place of a group along a line, and which way a candidate lies (-1 below, 1 above the centre): left_of and right_of.
    along: tuple[Callable[[str], Column], int] | None = None

    def __and__(self, other: Condition) -> Condition:
        reach = min((r for r in (self.reach, other.reach) if r is not None), default=None)
        return Condition(lambda: self.test() & other.test(), reach, self.key or other.key, alone=self.alone and other.alone)

    def __or__(self, other: Condition) -> Condition:
        both = None if self.reach is None or other.reach is None else max(self.reach, other.reach)
        return Condition(lambda: self.test() | other.test(), both, alone=self.alone and other.alone)

    def __invert__(self) -> Condition:
        return Condition(lambda: ~self.test(), alone=self.alone)


def _distance() -> Column:
    return F.round(F.sqrt(_D("x") * _D("x") + _D("y") * _D("y")), 10)


def circle(radius: float) -> Condition:
    return Condition(lambda: _distance() <= radius, radius)


def annulus(inner: float, outer: float) -> Condition:
    return Condition(lambda: _distance().between(inner, outer), outer)


def rectangle(width: float, height: float) -> Condition:
    return Condition(lambda: (_D("x") <= width / 2) & (_D("y") <= height / 2), max(width, height) / 2)


def square(size: float) -> Condition:
    return rectangle(size, size)


def ellipse(major: float, minor: float, angle: float = 0.0) -> Condition:
    """Axes of an ellipse, turned by an angle in radians."""

    def test() -> Column:
        dx, dy = F.col("b.x") - F.col("c.x"), F.col("b.y") - F.col("c.y")
        u, v = dx * math.cos(angle) + dy * math.sin(angle), dy * math.cos(angle) - dx * math.sin(angle)
        return F.round(u * u / major**2 + v * v / minor**2, 10) <= 1

    return Condition(test, max(major, minor))


def block(size: float, origin: float = 0.0) -> Condition:
    def key(side: str) -> Column:
        return F.concat_ws(":", *[F.floor((F.col(f"{side}.{a}") - origin) / size).cast("string") for a in "xy"])

    return Condition(lambda: key("c") == key("b"), size, key, "block")


def self_only() -> Condition:
    return Condition(lambda: F.col("c.grp") == F.col("b.grp"), 0, lambda s: F.col(f"{s}.grp"), "self")


def select_all() -> Condition:
    return Condition(lambda: F.lit(True), kind="all", alone=True)


def select_element(name: str) -> Condition:
    return Condition(lambda: F.col("b.grp") == name, alone=True)


def _across(angle: float) -> Column:
    return F.round((F.col("b.x") - F.col("c.x")) * math.cos(angle) - (F.col("b.y") - F.col("c.y")) * math.sin(angle), 10)


def _place(angle: float) -> Callable[[str], Column]:
    return lambda s: F.col(f"{s}.x") * math.cos(angle) - F.col(f"{s}.y") * math.sin(angle)


def left_of(angle: float = 0.0) -> Condition:
    return Condition(lambda: _across(angle) < 0, along=(_place(angle), -1))


def right_of(angle: float = 0.0) -> Condition:
    return Condition(lambda: _across(angle) > 0, along=(_place(angle), 1))


def in_line_with(angle: float = 0.0) -> Condition:
    """Equal places across the line; they are the key of the join."""
    at = lambda s: F.round(F.col(f"{s}.x") * math.cos(angle) - F.col(f"{s}.y") * math.sin(angle), 9)
    return Condition(lambda: at("c") == at("b"), None, at)


def match_text(text: str, axis: int) -> Condition:
    return Condition(lambda: F.split("b.grp", ":")[axis] == text, alone=True)


def match_regex(pattern: str) -> Condition:
    return Condition(lambda: F.col("b.grp").rlike(pattern), alone=True)


def not_empty() -> Condition:
    return Condition(lambda: F.col("b.richness") > 0, alone=True)


def richness_greater_than(threshold: float) -> Condition:
    return Condition(lambda: F.col("b.richness") > threshold, alone=True)


def redundancy_greater_than(threshold: float) -> Condition:
    return Condition(lambda: F.col("b.redundancy") > threshold, alone=True)


def polygon_test(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting over a polygon's edges, as one expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def in_polygon(points: list[tuple[float, float]]) -> Condition:
    return Condition(lambda: polygon_test(F.col("b.x"), F.col("b.y"), points), alone=True)


def same_polygon(shapes: list[list[tuple[float, float]]]) -> Condition:
    """Centre and candidate lie in the same of some polygons, the first that holds each; the polygon is the key of the join."""

    def key(side: str) -> Column:
        inside = [F.when(polygon_test(F.col(f"{side}.x"), F.col(f"{side}.y"), p), i) for i, p in enumerate(shapes)]
        return F.coalesce(*inside)

    return Condition(lambda: key("c") == key("b"), None, key)


def circle_cell(radius: float, size: tuple[float, float]) -> Condition:
    """A circle whose radius counts cells of a size."""

    def test() -> Column:
        u, v = _D("x") / size[0], _D("y") / size[1]
        return F.round(F.sqrt(u * u + v * v), 10) <= radius

    return Condition(test, radius * max(size))


def square_cell(width: float, size: tuple[float, float]) -> Condition:
    return Condition(lambda: (_D("x") / size[0] <= width / 2) & (_D("y") / size[1] <= width / 2), width * max(size) / 2)


def among(names: DataFrame) -> Condition:
    """Candidates of names(grp), such as a label's range or the groups that passed an earlier query; neighbours() keeps them before it compares."""
    return Condition(lambda: F.lit(True), kind="among", names=names)


def same_key(keys: DataFrame) -> Condition:
    """Centre and candidate have the same value in keys(grp, key), such as a cluster; groups without one match each other."""
    return Condition(lambda: F.lit(True), kind="same", names=keys)


def neighbours(groups: DataFrame, condition: Condition, definition: Condition | None = None) -> DataFrame:
    """(proc, grp): for each centre the groups that meet the condition.

    Equality keys join on themselves.  A bounded reach joins on coarse blocks
    of that size: a candidate is copied into the nine blocks around its own.
    Only unbounded conditions compare each centre with each group; what they ask
    of the candidate alone is asked before, as the optimizer pushes it down.
    """
    c, b = groups.alias("c"), groups.alias("b")
    if definition is not None:
        passing = groups.alias("b").where(definition.test()).select("grp")
        c = groups.join(passing, "grp", "left_semi").alias("c")
    if condition.kind == "self":
        return c.select(F.col("grp").alias("proc"), "grp")
    out = [F.col("c.grp").alias("proc"), F.col("b.grp").alias("grp")]
    if condition.kind == "among":
        return c.crossJoin(groups.join(condition.names.select("grp").distinct(), "grp", "left_semi").alias("b")).select(*out)
    if condition.kind == "same":
        k = groups.select("grp").join(condition.names, "grp", "left")
        return c.select("grp").join(k, "grp").select(F.col("grp").alias("proc"), "key").alias("c").join(k.alias("b"), F.col("c.key").eqNullSafe(F.col("b.key"))).select("c.proc", "b.grp")
    if condition.key is not None:
        return c.join(b, (condition.key("c") == condition.key("b")) & condition.test()).select(*out)
    if condition.reach:
        r = float(condition.reach)
        at = lambda a: F.floor(F.col(a) / r).cast("long")
        near = F.sequence(F.lit(-1), F.lit(1))
        spread = groups.withColumn("kx", F.explode(F.transform(near, lambda d: at("x") + d))).withColumn("ky", F.explode(F.transform(near, lambda d: at("y") + d)))
        centres = c.select("*", at("x").alias("kx"), at("y").alias("ky")).alias("c")
        join = (F.col("c.kx") == F.col("b.kx")) & (F.col("c.ky") == F.col("b.ky")) & condition.test()
        return centres.join(spread.alias("b"), join).select(*out)
    return c.crossJoin(b).where(condition.test()).select(*out)


def counts(groups: DataFrame, condition: Condition, definition: Condition | None = None) -> DataFrame:
    """(proc, n_nbrs): how many neighbours each centre that has any has, without the pairs wherever they follow from a count.

    Conditions that ask of the candidate alone are counted once for all
    centres; those to one side of a line by running sums over its distinct
    places, which are a row each in one window; equal keys by key.  Others count
    the pairs of neighbours().
    """
    if condition.kind in ("self", "complex", "block") and not condition.alone and condition.along is None:
        return neighbours(groups, condition, definition).groupBy("proc").agg(F.count("*").alias("n_nbrs"))
    centres = groups
    if definition is not None:
        centres = groups.join(groups.alias("b").where(definition.test()).select("grp"), "grp", "left_semi")
    if condition.kind == "same":
        k = groups.select("grp").join(condition.names, "grp", "left")
        sizes = k.groupBy("key").agg(F.count("*").alias("n_nbrs"))
        return centres.select("grp").join(k, "grp").select(F.col("grp").alias("proc"), "key").alias("c").join(sizes.alias("b"), F.col("c.key").eqNullSafe(F.col("b.key"))).select("c.proc", "b.n_nbrs")
    if condition.along is not None:
        place, side = condition.along
        at = lambda s: -side * place(s)
        places = groups.alias("b").select(at("b").alias("place")).groupBy("place").agg(F.count("*").alias("k"))
        # Tests round differences to 1e-10.
        before = places.select("place", F.expr("sum(k) over (order by place range between unbounded preceding and 5e-11D preceding)").alias("n_nbrs")).where("n_nbrs is not null")
        return centres.alias("c").select(F.col("c.grp").alias("proc"), at("c").alias("place")).join(before, "place").select("proc", "n_nbrs")
    held = groups.join(condition.names.select("grp").distinct(), "grp", "left_semi") if condition.kind == "among" else groups.alias("b").where(condition.test())
    # One row.
    total = held.agg(F.count("*").alias("n_nbrs")).where("n_nbrs > 0")
    return centres.select(F.col("grp").alias("proc")).crossJoin(F.broadcast(total))


def sequence(groups: DataFrame, frequency: int, first: int = 0) -> DataFrame:
    """Every frequency-th group in the order of its name."""
    return groups.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("grp")) - 1).where((F.col("i") >= first) & ((F.col("i") - first) % frequency == 0)).select("grp")


def first_of_blocks(groups: DataFrame, size: float, count: int = 1, seed: int | None = None) -> DataFrame:
    """The first `count` groups of each block by name, or random ones by seed."""
    keys = [F.floor(F.col(a) / size) for a in "xy"]
    order = F.col("grp") if seed is None else F.xxhash64(F.lit(seed), "grp")
    return groups.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "grp"))).where(F.col("i") <= count).select("grp")


def two_sets(groups: DataFrame, one: Condition, two: Condition | None = None) -> DataFrame:
    """(proc, grp, set): the second set without the members of the first."""
    first = neighbours(groups, one).withColumn("set", F.lit(1))
    if two is None:
        return first
    second = neighbours(groups, two).join(first.select("proc", "grp"), ["proc", "grp"], "left_anti").withColumn("set", F.lit(2))
    return first.unionByName(second)
