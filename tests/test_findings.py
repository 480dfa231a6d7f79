"""Results that must not be made of pairs: counts, sums over trees, histograms, blocks of groups."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import clades, cluster, conditions, estimators, phylo, properties


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _groups(spark):
    return spark.createDataFrame([(f"{x}:{y}", x, y, 1 + (x + y) % 3, 0.0) for x in range(-3, 4) for y in range(-3, 3)], "grp string, x long, y long, richness int, redundancy double")


@pytest.mark.parametrize("name", ["left", "right", "turned", "all", "element", "richness", "among", "same", "nobody"])
def test_neighbours_are_counted_without_pairs(spark, name):
    groups = _groups(spark)
    made = {
        "left": conditions.left_of(), "right": conditions.right_of(), "turned": conditions.left_of(math.pi / 3), "all": conditions.select_all(), "element": conditions.select_element("1:1"),
        "richness": conditions.richness_greater_than(1), "among": conditions.among(groups.where("x > 1")), "same": conditions.same_key(groups.where("x <> 0").select("grp", (F.col("x") % 2).alias("key"))), "nobody": conditions.select_element("none"),
    }[name]
    got = conditions.counts(groups, made)
    want = conditions.neighbours(groups, made).groupBy("proc").agg(F.count("*").alias("n_nbrs"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    passing = conditions.richness_greater_than(2)
    got, want = conditions.counts(groups, made, passing), conditions.neighbours(groups, made, passing).groupBy("proc").agg(F.count("*").alias("n_nbrs"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    # Other cross joins than that with one row would make the pairs.
    assert all("ResolvedHint" in line or "Cross" not in line or "rightHint=(strategy=broadcast)" in line for line in _plan(got).splitlines())


@pytest.fixture(scope="module")
def small(spark):
    """A cube with neighbours, a tree of three levels whose tips it holds all but one, and the pairs of tips by brute force."""
    rows = [(f"{g}:0", lab, float(1 + (g * 3 + i) % 4)) for g in range(6) for i, lab in enumerate("abcdefg") if (g * 5 + i * 3) % 4]
    rows = [r for r in rows if r[0] != "5:0"] + [("9:0", "a", 2.0)]
    occ = spark.createDataFrame(rows, "grp string, label string, n double").cache()
    nodes = [("root", None, 0.5), ("p", "root", 1.0), ("q", "root", 2.0), ("s", "p", 0.25), ("a", "s", 3.0), ("b", "s", 1.5), ("c", "p", 2.0), ("d", "q", 1.0), ("e", "q", 0.0), ("f", "root", 4.0), ("g", "q", 2.5), ("z", "root", 9.0)]
    tree = spark.createDataFrame(nodes, "node string, parent string, length double").cache()
    nbrs = conditions.two_sets(cube.groups(occ), conditions.self_only(), conditions.circle(1))
    # Plans end at this table.
    return occ, spark.createDataFrame(nbrs.collect(), nbrs.schema), tree


def _brute(spark, small):
    """Of each centre the labels with samples and local ranges."""
    held = {}
    for r in small[1].join(small[0], "grp").collect():
        g, n = held.setdefault(r["proc"], {}).get(r["label"], (0, 0.0))
        held[r["proc"]][r["label"]] = (g + 1, n + r["n"])
    return held


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_distances_of_labels_without_pairs(spark, small, kind):
    occ, nbrs, tree = small
    d = {(r["a"], r["b"]): r["d"] for r in clades.tip_distances(tree, 3, occ).collect()}
    made = clades.pair_distances(occ, nbrs, tree, 3, kind)
    got = {(r["proc"], r["measure"]): r for r in made.collect()}
    assert "Join" in _plan(made) and made.columns == ["proc", "measure", "mean", "variance", "rmsd", "n", "min", "max"]
    want = {}
    for proc, labels in _brute(spark, small).items():
        w = {k: {1: 1.0, 2: float(g), 3: n}[kind] for k, (g, n) in labels.items()}
        every = [(d[x, y], w[x] * w[y]) for x in w for y in w if x != y]
        near = [(min(d[x, y] for y in w if y != x), w[x]) for x in w] if len(w) > 1 else []
        for name, rows in (("PMPD", every), ("PNTD", near)):
            if rows:
                n = sum(k for _, k in rows)
                mean, square = sum(v * k for v, k in rows) / n, sum(v * v * k for v, k in rows) / n
                want[proc, name] = (mean, square - mean**2, math.sqrt(square), n, min(v for v, _ in rows), max(v for v, _ in rows))
    assert got.keys() == want.keys() and len(want) == 10
    for k, row in want.items():
        assert tuple(got[k])[2:] == pytest.approx(row, abs=1e-9)


@pytest.mark.parametrize("binary", [False, True])
def test_taxonomic_distinctness_without_pairs(spark, small, binary):
    occ, nbrs, tree = small
    up = {(r["a"], r["b"]): r["up"] for r in clades.tip_distances(tree, 3, occ).collect()}
    own = {r["node"]: r["length"] for r in tree.collect()}
    got = {r["proc"]: r for r in clades.taxonomic_distinctness(occ, nbrs, tree, 3, binary).collect()}
    for proc, labels in _brute(spark, small).items():
        w = {k: 1.0 if binary else n for k, (_, n) in labels.items()}
        rows = [((up[x, y] - own[y]) * w[x] * w[y], w[x] * w[y]) for x in w for y in w if x != y]
        if rows:
            top, below = sum(x for x, _ in rows), sum(k for _, k in rows)
            assert tuple(got[proc])[1:] == pytest.approx((top / below, below, top, sum(x * x for x, _ in rows) / below - (top / below) ** 2))
    assert len(got) == 5


def test_estimators_take_histograms(spark):
    """A centre each with an estimate of its own, with Chao's, and with none; two kinds of counts."""
    rows = {"own": (1, 1, 1, 2, 2, 5, 12), "chao": (2, 2, 5, 30), "none": (1, 1)}
    flat = spark.createDataFrame([(p, float(v), float(sum(x))) for p, x in rows.items() for v in x], "proc string, v double, t double")
    short = flat.groupBy("proc", "v").agg(F.count("*").alias("k"))
    for f in (estimators.chao, estimators.coverage, lambda c: estimators.hurlbert(c, (2, 5))):
        key = lambda r: tuple(r[:2])
        for one, two in zip(sorted(f(flat).collect(), key=key), sorted(f(short).collect(), key=key), strict=True):
            assert tuple(one) == pytest.approx(tuple(two), nan_ok=True)
    r = {x["proc"]: x for x in estimators.coverage(short).collect()}
    assert [r[p]["used_chao"] for p in ("own", "chao", "none")] == [0, 1, 0] and r["none"]["variance"] is None and r["own"]["estimate"] > 7
    assert r["chao"]["estimate"] == {x["proc"]: x["estimate"] for x in estimators.chao(short).collect()}["chao"]
    # One aggregation: what is summed over labels isn't joined.
    assert "Join" not in _plan(estimators.coverage(short)) + _plan(estimators.hurlbert(short))


@pytest.mark.parametrize("most", [64, 0])
def test_pairs_of_groups_are_compared_in_blocks(spark, monkeypatch, most):
    """Labels beyond a word, against sets; both ways of counting."""
    rows = [(f"g{g}", f"l{i:03}", 1.0) for g in range(9) for i in range(150) if (g * 7 + i * 3) % (g + 3) < 2]
    occ = spark.createDataFrame(rows, "grp string, label string, n double").cache()
    monkeypatch.setattr(cluster, "MOST_WORDS", most)
    sets = {}
    for g, i, _ in rows:
        sets.setdefault(g, set()).add(i)
    want = {(a, b): (len(sets[a]), len(sets[b]), float(len(sets[a] & sets[b]))) for a in sets for b in sets if a < b}
    made = cluster.pair_counts(occ)
    assert {tuple(r)[:2]: tuple(r)[2:] for r in made.collect()} == want
    near = spark.createDataFrame([("g1", "g0"), ("g0", "g1"), ("g3", "g3"), ("g2", "g8")], "proc string, grp string")
    assert {tuple(r)[:2] for r in cluster.pair_counts(occ, near).collect()} == {("g0", "g1"), ("g2", "g8")}
    best = min(want, key=lambda k: (round(1 - 2 * want[k][2] / sum(want[k][:2]), 8), k))
    assert tuple(cluster.most_similar(cluster.pair_matrix(occ)).first())[:2] == best
    # Shared labels aren't counted apart and joined to the pairs.
    assert most == 0 or "LeftOuter" not in _plan(made)


def _dealt(df) -> list[str]:
    """What the rows of centres are shuffled by."""
    return re.findall(r"Exchange hashpartitioning\((proc[^)]*?)#", df._jdf.queryExecution().executedPlan().toString())


def test_values_of_a_label_matrix_without_pairs(spark, small):
    occ, nbrs, _ = small
    matrix = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5), ("d", "g", 4.0), ("b", "b", 8.0), ("a", "zz", 16.0)], "a string, b string, value double")
    known = {(r["a"], r["b"]): r["value"] for r in matrix.collect()}
    made = properties.matrix_values(occ, nbrs, matrix)
    assert len(_dealt(made)) == 1
    want = {(p, *k, v) for p, labels in _brute(spark, small).items() for k, v in known.items() if set(k) <= labels.keys()}
    assert {tuple(r) for r in made.collect()} == want
    qe = {r["proc"]: (r["qe"], r["tn"]) for r in properties.matrix_entropy(occ, nbrs, matrix).collect()}
    for p, labels in _brute(spark, small).items():
        k = len(labels.keys() & {"a", "b", "c", "d", "g", "zz"})
        assert qe[p] == pytest.approx((2 * sum(v for q, *_, v in want if q == p) / k**2, k**2))


def test_nodes_of_a_centre_are_dealt_once(spark, small):
    occ, nbrs, tree = small
    made = phylo.calculate(occ, nbrs, tree, 3, ["calc_pd", "calc_pe"])
    assert len(_dealt(made)) == 1
    paths = {}
    for r in phylo.closure(tree, 3).collect():
        paths.setdefault(r["tip"], []).append(r["node"])
    length = {r["node"]: r["length"] for r in tree.collect()}
    held = {}
    for r in occ.collect():
        for n in paths[r["label"]]:
            held.setdefault(n, set()).add(r["grp"])
    near = {}
    for r in nbrs.collect():
        near.setdefault(r["proc"], set()).add(r["grp"])
    got = {r["proc"]: r for r in made.collect()}
    for p, groups in near.items():
        local = {n: len(g & groups) for n, g in held.items() if g & groups}
        pe = sum(length[n] * k / len(held[n]) for n, k in local.items())
        assert (got[p]["PD"], got[p]["PD_P"]) == pytest.approx((sum(map(length.get, local)), sum(map(length.get, local)) / sum(length.values())), abs=1e-7)
        assert (got[p]["PE_WE"], got[p]["PE_WE_P"]) == pytest.approx((pe, pe / sum(map(length.get, held))), abs=1e-7)


def test_kept_trees_have_few_partitions(spark):
    kept = phylo.keep_closures(spark.createDataFrame([("root", None, 0.0), ("a", "root", 1.0)], "node string, parent string, length double").repartition(40))
    assert phylo.closure(kept, 2).rdd.getNumPartitions() <= phylo.PARTS
    phylo.drop_closures(kept)


def test_losses_of_clades_without_a_self_join(spark, small):
    """p and s lie above a and b only, so what goes with s is the score of p; the root has another label below it."""
    tree = small[2]
    rows = [("x", "root", 3, "a", 20.0), ("x", "p", 2, "a", 9.0), ("x", "s", 2, "a", 6.0), ("x", "a", 1, "a", 3.0), ("x", "b", 1, "b", 1.5), ("x", "f", 1, "f", 4.0), ("y", "s", 1, "b", 2.0), ("y", "b", 1, "b", 1.5)]
    made = spark.createDataFrame([(*r, r[4] / 20, r[4] / 40) for r in rows], "proc string, node string, tips long, first string, score double, contr double, contr_p double")
    lost = clades.losses(made, tree, 3)
    got = {(r["proc"], r["node"]): (r["score"], r["ancestral"]) for r in lost.collect()}
    assert got == {("x", "root"): (20, 0), ("x", "p"): (9, 0), ("x", "s"): (9, 3), ("x", "a"): (3, 0), ("x", "b"): (1.5, 0), ("x", "f"): (4, 0), ("y", "s"): (2, 0), ("y", "b"): (2, 0.5)}
    assert _plan(lost).count("LogicalRDD") - _plan(clades.depths(tree, 3)).count("LogicalRDD") <= 1
