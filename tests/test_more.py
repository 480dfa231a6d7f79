"""Readers, sinks, shapes, statistics, trees and text conditions on hand-made data."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import clades, conditions, estimators, expressions, properties, ranges, trees
from quadrat.sinks import text as sink
from quadrat.sources import text as source
from quadrat.sources import trees as readers

NODES = [("root", None, 0.0), ("a", "root", 1.0), ("b", "root", 2.0), ("a:x", "a", 3.0), ("a:y", "a", 4.0), ("b:z", "b", 5.0)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node string, parent string, length double").cache()


def test_newick_with_quotes_comments_and_names():
    found = readers.newick_nodes("(('it''s, x':1.5[note],B:2)inner:0.5,(C,D:1e-1):3)top;")
    assert [n for n in found if n[0] in ("it's, x", "B", "inner", "D", "top")] == [("top", None, 0.0), ("inner", "top", 0.5), ("it's, x", "inner", 1.5), ("B", "inner", 2.0), ("D", "0___", 0.1)]
    assert readers.newick_nodes("A;") == [("A", None, 0.0)]


def test_nexus_translates():
    ((name, names, newick),) = readers.nexus_trees("#NEXUS\nBegin trees;\n translate 1 'Genus sp1', 2 sp2;\n tree t1 = (1:1,2:2)r;\nend;")
    assert (name, names["1"]) == ("t1", "Genus sp1") and readers.newick_nodes(newick, names)[1] == ("Genus sp1", "r", 1.0)


def test_trees_survive_text(nodes):
    assert readers.read_newick(sink.newick(nodes, 2).withColumn("tree", F.lit("t"))).drop("tree").exceptAll(nodes).count() == 0
    assert readers.read_tabular(sink.tabular_tree(nodes)).exceptAll(nodes).count() == 0


def test_delimited_lines(spark):
    lines = spark.createDataFrame([('1;"a;b";2',), ('3;"say ""c""";4',), ('5;d;0',)], "line string")
    assert source.guess_separator(lines).first()[0] == ";" and source.guess_quote(lines).first()[0] == '"'
    rows = source.records(lines, ["x", "name", "n"], ";").collect()
    assert [r["name"] for r in rows] == ["a;b", 'say "c"', "d"]
    occ = source.import_lines(lines, ["x", "name", "n"], [("x", 2)], ["name"], "n", ";", exclude=F.col("name") == "d")
    assert {(r["grp"], r["label"]): r["n"] for r in occ.collect()} == {("0", "a;b"): 2.0, ("1", 'say "c"'): 4.0}
    assert [r[0] for r in sink.delimited(spark.createDataFrame([('a,"b', 1)], "s string, i int")).collect()] == ['"a,""b",1']


def test_shapes_of_ranges(spark):
    occ = spark.createDataFrame([(f"{x}:{y}", "sq", 1.0) for x in range(3) for y in range(3)] + [("5:5", "one", 1.0)], "grp string, label string, n double")
    hull = {r["label"]: r for r in ranges.hulls(occ).collect()}
    assert (hull["sq"]["corners"], hull["sq"]["area"], hull["one"]["area"]) == (4, 9.0, 1.0)
    circle = {r["label"]: r for r in ranges.circles(occ).collect()}
    assert (circle["sq"]["x"], circle["sq"]["y"], circle["sq"]["radius"]) == pytest.approx((1, 1, 1.5 * math.sqrt(2)))
    rng = np.random.default_rng(2)
    for _ in range(20):
        p = rng.random((30, 2))
        x, y, r = ranges._circle(p)
        far = np.hypot(p[:, 0] - x, p[:, 1] - y)
        assert far.max() <= r + 1e-7 and (far > r - 1e-7).sum() >= 2


def test_weighted_statistics_equal_repeated_values(spark):
    rows = [(1, 2.0, 3), (1, 5.0, 1), (1, 9.0, 2), (2, 4.0, 1)]
    s = {r["k"]: r for r in properties.weighted_stats(spark.createDataFrame(rows, "k int, v double, w int"), ["k"], (50,)).collect()}
    v = np.repeat([2.0, 5, 9], [3, 1, 2])
    assert (s[1]["n"], s[1]["mean"], s[1]["sd"], s[1]["median"]) == pytest.approx((6, v.mean(), v.std(ddof=1), np.median(v)))
    assert s[1]["q50"] == sorted(v)[int(0.5 + 5 * 0.5)] and s[2]["sd"] == 0 and s[2]["skew"] is None


def test_estimators_by_hand(spark):
    counts = spark.createDataFrame([("p", float(v), 12.0) for v in (1, 1, 1, 2, 2, 5)], "proc string, v double, t double")
    r = estimators.chao(counts).first()
    assert r["estimate"] == pytest.approx(6 + 11 / 12 * 9 / 4) and r["ci_lower"] < r["estimate"] < r["ci_upper"]
    es = {x["n"]: x["es"] for x in estimators.hurlbert(counts, (5, 12)).collect()}
    assert es[12] == pytest.approx(6) and es[5] == pytest.approx(sum(1 - math.comb(12 - v, 5) / math.comb(12, 5) for v in (1, 1, 1, 2, 2, 5)), abs=1e-9)
    a = estimators.coverage(counts).first()
    assert a["used_chao"] == 0 and a["infrequent"] == 6 and a["estimate"] > 6


def test_trees_change(spark, nodes):
    knot = spark.createDataFrame([("root", None, 0.0), ("k", "root", 1.0), ("t", "k", 2.0), ("u", "root", 4.0)], "node string, parent string, length double")
    assert {tuple(r) for r in trees.without_knuckles(knot, 2).collect()} == {("root", None, 0.0), ("t", "root", 3.0), ("u", "root", 4.0)}
    assert trees.shared_by(nodes, 2, spark.createDataFrame([("a:x",), ("a:y",)], "node string")).first()[0] == "a"
    assert not trees.is_ultrametric(nodes, 2).first()[0]
    d = {(r["a"], r["b"]): r["d"] for r in clades.tip_distances(nodes, 2).collect()}
    assert d["a:x", "a:y"] == 7 and d["a:x", "b:z"] == 11
    mean, sd = next(iter(clades.expected_mpd(nodes, 2, (2,)).collect()))[1:]
    every = [7.0, 11.0, 12.0]
    assert mean == pytest.approx(np.mean(every)) and sd == pytest.approx(np.std(every))


def test_conditions_as_text(spark):
    groups = spark.createDataFrame([(f"{x}:{y}", x, y, 1, 0.0) for x in range(-3, 4) for y in range(-3, 4)], "grp string, x long, y long, richness int, redundancy double")
    made = conditions.neighbours(groups, expressions.parse("sp_circle(radius=2) and not d[0] > 1"))
    slow = conditions.neighbours(groups, conditions.Condition(lambda: conditions._distance() <= 2)).count()
    assert 0 < made.count() < slow
    assert expressions.verify("__import__('os').system('x')") and expressions.verify("D <=") and expressions.verify("sp_circle(3, 4, 5)") and expressions.verify("D <= 2") is None
    same = conditions.neighbours(groups, conditions.same_polygon([[(-0.5, -9), (0.5, -9), (0.5, 9), (-0.5, 9)]]))
    assert same.count() == 49 and cube.bin_centre(F.lit(3), 0) is not None


def test_streamed_cube_equals_the_static_one(spark, tmp_path):
    from quadrat.streaming.cube import windowed_cube

    rows = [("2024-01-01 10:00:00", "g", "a", 1.0), ("2024-01-01 12:00:00", "g", "a", 2.0), ("2024-01-03 00:00:00", "h", "b", 5.0), ("2024-01-09 00:00:00", "h", "b", 7.0)]
    df = spark.createDataFrame(rows, "ts string, g string, l string, n double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    make = lambda d: windowed_cube(d, "ts", [F.col("g")], [F.col("l")], F.col("n"))
    query = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r["window"]["start"])[:10], r["grp"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", "g", 3.0), ("2024-01-03", "h", 5.0)}
    assert make(df).count() == 3
