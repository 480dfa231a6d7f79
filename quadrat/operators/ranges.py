"""Complements, element filters and shapes of ranges over the cube."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.conditions import polygon_test


def delete(occ: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """The cube without some groups or labels."""
    return occ.where(~F.col(column).isin(*names))


def missing(elements: DataFrame, column: str, occ: DataFrame) -> DataFrame:
    """Elements (groups or labels) that hold nothing in the cube."""
    return elements.select(column).distinct().join(occ.select(column), column, "left_anti")


def groups_without(occ: DataFrame, label: str) -> DataFrame:
    return occ.select("grp").distinct().join(occ.where(F.col("label") == label).select("grp"), "grp", "left_anti")


def labels_without(occ: DataFrame, group: str) -> DataFrame:
    return occ.select("label").distinct().join(occ.where(F.col("grp") == group).select("label"), "label", "left_anti")


def axis_values(occ: DataFrame, column: str, axis: int) -> DataFrame:
    """Distinct values of an axis of groups or labels."""
    return occ.select(F.split(column, ":")[axis].alias("value")).distinct()


def cells(occ: DataFrame) -> DataFrame:
    """(label, x, y): the cells of each label's range."""
    at = F.split("grp", ":")
    return occ.select("label", at[0].cast("double").alias("x"), at[1].cast("double").alias("y"))


def bounds(occ: DataFrame) -> DataFrame:
    """(label, x_min, y_min, x_max, y_max) of the centres of each label's cells."""
    return cells(occ).groupBy("label").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def within_circle(groups: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    return groups.where((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 <= radius**2).select("grp")


def within_polygon(groups: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    return groups.where(polygon_test(F.col("x"), F.col("y"), points)).select("grp")


def _hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull, counterclockwise from the least."""
    rows = sorted(set(map(tuple, points.tolist())))
    if len(rows) < 3:
        return rows
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(items):
        out: list[tuple[float, float]] = []
        for p in items:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(rows) + chain(reversed(rows))


def _corners(occ: DataFrame, size: float) -> DataFrame:
    """Of each label and row of cells the outermost corners: what a hull or a circle can touch, two columns a row at most."""
    h = size / 2
    rows = cells(occ).groupBy("label", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rows.select("label", F.explode(F.array(*[F.struct((F.col(x) + s * h).alias("x"), (F.col("y") + t * h).alias("y")) for x, s in (("lo", -1), ("hi", 1)) for t in (-1, 1)])).alias("p")).select("label", "p.x", "p.y")


def hulls(occ: DataFrame, size: float = 1.0) -> DataFrame:
    """(label, corners, area) of the convex hull around the cells of each label."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(rows[["x", "y"]].to_numpy())
        x, y = np.array(hull).T
        area = abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "corners": [len(hull)], "area": [area]})

    return _corners(occ, size).groupBy("label").applyInPandas(make, "label string, corners int, area double")


def _circle(points: np.ndarray) -> tuple[float, float, float]:
    """Least circle around points: their hull's corners are added one by one, and the circle grows through those outside it."""
    pts = np.array(_hull(points))

    def two(a, b):
        return *((a + b) / 2), float(np.hypot(*(a - b)) / 2)

    def three(a, b, c):
        m = 2 * np.array([b - a, c - a])
        if abs(np.linalg.det(m)) < 1e-12:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda z: z[2])
        centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        return *centre, float(np.hypot(*(centre - a)))

    out = lambda z, p: np.hypot(p[0] - z[0], p[1] - z[1]) > z[2] + 1e-9
    z = (*pts[0], 0.0)
    for i, p in enumerate(pts):
        if out(z, p):
            z = (*p, 0.0)
            for j, q in enumerate(pts[:i]):
                if out(z, q):
                    z = two(p, q)
                    for r in pts[:j]:
                        if out(z, r):
                            z = three(p, q, r)
    return tuple(map(float, z))


def circles(occ: DataFrame, size: float = 1.0) -> DataFrame:
    """(label, x, y, radius) of the least circle around the cells of each label."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, r = _circle(rows[["x", "y"]].to_numpy())
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "x": [x], "y": [y], "radius": [r]})

    return _corners(occ, size).groupBy("label").applyInPandas(make, "label string, x double, y double, radius double")


def first_at(values: Column, largest: bool) -> Column:
    """Place, from 0, of the first largest or least of an array's values."""
    return (F.array_position(values, F.array_max(values) if largest else F.array_min(values)) - 1).cast("int")


