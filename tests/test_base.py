"""Cube, conditions, indices, trees, clusters and randomisations on hand-made data."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.functions import stats
from quadrat.operators import cluster, conditions, indices, phylo, randomise

ROWS = [("0:0", "a:x", 2.0), ("0:0", "a:y", 1.0), ("1:0", "a:y", 3.0), ("1:0", "b:z", 1.0), ("5:5", "b:z", 4.0)]


@pytest.fixture(scope="module")
def occ(spark):
    return spark.createDataFrame(ROWS, "grp string, label string, n double").cache()


def test_binning_rounds_before_floor(spark):
    row = spark.range(1).select(cube.bin_index(F.lit(0.3), 0.1).alias("i"), cube.bin_centre(F.lit(-0.1), 5).alias("c")).first()
    assert row["i"] == 3 and row["c"] == -2.5


def test_cube_operations(occ):
    assert cube.merge(occ, occ).agg(F.sum("n")).first()[0] == 22
    assert {(r["grp"], r["label"]): r["n"] for r in cube.drop_axis(occ, "label", 1).collect()} == {("0:0", "a"): 3, ("1:0", "a"): 3, ("1:0", "b"): 1, ("5:5", "b"): 4}
    assert cube.transpose(cube.transpose(occ)).exceptAll(occ).count() == 0
    assert {r[0] for r in cube.exclude(occ, "label", max_variety=2).select("label").distinct().collect()} == {"a:x"}
    names = occ.where("label in ('a:y', 'b:z')").select("label")
    assert {r[0] for r in cube.range_union(occ, names).collect()} == {"0:0", "1:0", "5:5"}
    assert {r[0] for r in cube.range_intersection(occ, names).collect()} == {"1:0"}


def test_bounded_conditions_equal_a_full_scan(spark):
    groups = spark.createDataFrame([(f"{x}:{y}", x, y, 1, 0.0) for x in range(-4, 5) for y in range(-4, 5)], "grp string, x long, y long, richness int, redundancy double").cache()
    for c in (conditions.circle(2.5), conditions.annulus(1, 3), conditions.rectangle(4, 2), conditions.ellipse(3, 1, 0.5), conditions.block(3)):
        slow = conditions.neighbours(groups, conditions.Condition(c.test))
        assert conditions.neighbours(groups, c).exceptAll(slow).count() == 0 == slow.exceptAll(conditions.neighbours(groups, c)).count()


def test_indices(occ):
    nbrs = conditions.two_sets(cube.groups(occ), conditions.self_only(), conditions.circle(1))
    rows = {r["proc"]: r for r in indices.calculate(occ, nbrs, ["calc_abc_counts", "calc_jaccard", "calc_endemism_whole", "calc_simpson_shannon"]).collect()}
    r = rows["0:0"]
    assert (r["ABC_A"], r["ABC_B"], r["ABC_C"]) == (1, 1, 1) and r["JACCARD"] == pytest.approx(2 / 3)
    assert r["ENDW_WE"] == pytest.approx(1 + 1 + 0.5)
    assert rows["5:5"]["JACCARD"] is None
    p = [2 / 7, 4 / 7, 1 / 7]
    assert r["SHANNON_H"] == pytest.approx(-sum(x * math.log(x) for x in p))


def test_endemism_sums_to_the_number_of_labels(occ):
    nbrs = conditions.two_sets(cube.groups(occ), conditions.self_only())
    assert indices.calculate(occ, nbrs, ["calc_endemism_whole"]).agg(F.sum("ENDW_WE")).first()[0] == pytest.approx(3)


def test_phylogeny(spark, occ):
    nodes = spark.createDataFrame([("root", None, 0.0), ("a", "root", 1.0), ("b", "root", 2.0), ("a:x", "a", 3.0), ("a:y", "a", 4.0), ("b:z", "b", 5.0), ("b:w", "b", 9.0)], "node string, parent string, length double")
    nbrs = conditions.two_sets(cube.groups(occ), conditions.self_only(), conditions.circle(1))
    r = {x["proc"]: x for x in phylo.calculate(occ, nbrs, nodes, 2, ["calc_pd", "calc_phylo_abc", "calc_pe"]).collect()}
    assert r["0:0"]["PD"] == 15 and r["0:0"]["PHYLO_A"] == 5 and r["0:0"]["PHYLO_B"] == 3 and r["0:0"]["PHYLO_C"] == 7
    assert r["5:5"]["PE_WE"] == pytest.approx(5 / 2 + 2 / 2)
    d = {(x["a"], x["b"]): x["distance"] for x in phylo.patristic(phylo.closure(nodes, 2)).collect()}
    assert d["a:x", "a:y"] == 7 and d["a:x", "b:z"] == 11


def test_statistics(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 8, 16)] + [(2, 3.0)], "k int, v double")
    r = {x["k"]: x for x in df.groupBy("k").agg(stats.sd(F.col("v")).alias("sd"), stats.percentile(F.col("v"), 50).alias("p"), stats.skewness(F.col("v")).alias("g")).collect()}
    assert r[2]["sd"] == 0 and r[2]["g"] is None and r[1]["p"] == 4


def test_cluster(occ):
    tree = cluster.agglomerate(cluster.pair_matrix(occ, "SORENSON"))
    assert tree.where("parent is null").count() == 1
    assert tree.where("parent is null").first()["n_tips"] == 3
    assert {r["cluster"] for r in cluster.cut(tree, 3).collect()} == {"0:0", "1:0", "5:5"}


@pytest.mark.parametrize("model", [randomise.csr_by_group, randomise.curveball, randomise.independent_swaps, randomise.structured])
def test_randomisations_keep_ranges_and_totals(spark, model):
    rows = [(f"g{g}", f"l{s}", float(1 + (g * s) % 3)) for g in range(8) for s in range(9) if (g * 7 + s * 5) % 3]
    occ = spark.createDataFrame(rows, "grp string, label string, n double")
    made = model(occ, 2, seed=3).cache()
    assert made.agg(F.sum("n")).first()[0] == 2 * sum(r[2] for r in rows)
    want = {r[0]: r[1] for r in occ.groupBy("label").count().collect()}
    for it in (0, 1):
        one = made.where(F.col("iter") == it)
        assert {r[0]: r[1] for r in one.groupBy("label").count().collect()} == want
        assert one.groupBy("grp", "label").count().where("count > 1").count() == 0
    assert made.exceptAll(model(occ, 2, seed=3)).count() == 0


def test_comparison(spark):
    base = spark.createDataFrame([("p", 2.0)], "proc string, V double")
    drawn = spark.createDataFrame([(i, "p", v) for i, v in enumerate((1.0, 2.0, 3.0, 1.5))], "iter int, proc string, V double")
    r = randomise.compare(base, drawn, ["V"]).withColumn("rank", randomise.p_rank()).first()
    assert (r["C"], r["T"], r["Q"], r["rank"]) == (2, 1, 4, 0.75)
