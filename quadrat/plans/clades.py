"""Registered node lists and clade calculations.

Those about shared ancestors and clades run over a part of the cube, in which
some cells hold one brand only, so that ancestors differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import clades, conditions, indices, lists, phylo
from quadrat.plans.index_sql import NODES
from quadrat.plans.registry import ABC, NBRS, OCC, TREE, base_cube, register, shared

_PR = f"{NBRS}{TREE}{NODES}"
_KIND = "(split_part(label, ':', 1) = 'Brand#11' OR (split_part(label, ':', 1) = 'Brand#22' AND CAST(split_part(grp, ':', 2) AS BIGINT) % 2 = 0))"
#: The cube's part, each cell its own centre; ancestry of all nodes; tips below nodes, shared ancestors.
_PART = f"""{OCC}{TREE}, part_ AS (SELECT grp AS proc, label, n FROM occ WHERE {_KIND}),
  every AS (SELECT node, max(len) AS len, max(is_tip) AS is_tip FROM paths GROUP BY 1),
  up AS (SELECT node, node AS anc, 0 AS steps FROM every UNION ALL SELECT tip, node, CASE WHEN node = 'root' THEN 2 ELSE 1 END FROM paths WHERE node <> tip
    UNION ALL SELECT node, 'root', 1 FROM every WHERE is_tip = 0 AND node <> 'root'),
  deep AS (SELECT node, max(steps) AS depth, sum(e.len) AS dist FROM up JOIN (SELECT node AS anc, len FROM every) e USING (anc) GROUP BY 1),
  cnt AS (SELECT proc, node, count(*) AS tips FROM part_ JOIN paths ON label = tip GROUP BY 1, 2), tot AS (SELECT proc, count(*) AS total, max(dist) AS far FROM part_ JOIN deep ON label = node GROUP BY 1),
  lca AS (SELECT proc, node, depth, dist, far FROM (SELECT *, row_number() OVER (PARTITION BY proc ORDER BY depth DESC) AS i FROM cnt JOIN tot USING (proc) JOIN deep USING (node) WHERE tips = total) WHERE i = 1)"""


def _part(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    occ, _, nodes = shared(spark, sf_dir)
    brand, even = F.split("label", ":")[0], F.split("grp", ":")[1].cast("long") % 2 == 0
    part = occ.where((brand == "Brand#11") | ((brand == "Brand#22") & even))
    return part, conditions.two_sets(cube.groups(part), conditions.self_only()), nodes


def _rows(spark, sf_dir) -> DataFrame:
    return phylo.rows_of(*base_cube(spark, sf_dir), shared(spark, sf_dir)[2], 2).withColumn("w", F.col("len") * (F.col("k1") + F.col("k2")) / F.col("r"))


def _node_list(name: str, sql: str, make) -> None:
    register(name, f"{_PR} SELECT proc, node, {sql}")(lambda spark, sf_dir: make(_rows(spark, sf_dir)))


_r = lambda c, n: F.round(c, 8).alias(n)
_node_list("calc_pd_node_list", "round(len, 8) AS PD_INCLUDED_NODE_LIST FROM pr", lambda p: p.select("proc", "node", _r("len", "PD_INCLUDED_NODE_LIST")))
_node_list("calc_pd_terminal_node_list", "round(len, 8) AS PD_INCLUDED_TERMINAL_NODE_LIST FROM pr WHERE is_tip = 1", lambda p: p.where("is_tip = 1").select("proc", "node", _r("len", "PD_INCLUDED_TERMINAL_NODE_LIST")))
_node_list(
    "calc_pe_lists", "round(w, 8) AS PE_WTLIST, r AS PE_RANGELIST, CAST(k1 + k2 AS BIGINT) AS PE_LOCAL_RANGELIST FROM pr",
    lambda p: p.select("proc", "node", _r("w", "PE_WTLIST"), F.col("r").alias("PE_RANGELIST"), (F.col("k1") + F.col("k2")).alias("PE_LOCAL_RANGELIST")),
)
_node_list(
    "calc_pe_central_lists", "round(w, 8) AS PEC_WTLIST, r AS PEC_RANGELIST, CAST(k1 + k2 AS BIGINT) AS PEC_LOCAL_RANGELIST FROM pr WHERE k1 > 0",
    lambda p: p.where("k1 > 0").select("proc", "node", _r("w", "PEC_WTLIST"), F.col("r").alias("PEC_RANGELIST"), (F.col("k1") + F.col("k2")).alias("PEC_LOCAL_RANGELIST")),
)
_node_list("calc_pd_endemism_wts", "round(len, 8) AS PD_ENDEMISM_WTS FROM pr WHERE k1 + k2 = r", lambda p: p.where("k1 + k2 = r").select("proc", "node", _r("len", "PD_ENDEMISM_WTS")))
_node_list("calc_phylo_abundance_branches", "round(n * len, 6) AS PHYLO_ABUNDANCE_BRANCH_HASH FROM pr", lambda p: p.select("proc", "node", F.round(F.col("n") * F.col("len"), 6).alias("PHYLO_ABUNDANCE_BRANCH_HASH")))

# ---- labels on and off a tree that lacks the brands of ten

_LACKS = "label NOT LIKE 'Brand#1%'"
register("calc_labels_on_tree", f"{ABC} SELECT proc, label AS PHYLO_LABELS_ON_TREE FROM abc WHERE {_LACKS}")(
    lambda spark, sf_dir: _on_tree(spark, sf_dir, "left_semi", "PHYLO_LABELS_ON_TREE")
)
register("calc_labels_on_trimmed_tree", f"{ABC} SELECT proc, label AS PHYLO_LABELS_ON_TRIMMED_TREE FROM abc WHERE {_LACKS}")(
    lambda spark, sf_dir: _on_tree(spark, sf_dir, "left_semi", "PHYLO_LABELS_ON_TRIMMED_TREE", True)
)


def _tips(spark, sf_dir, trim: bool = False) -> DataFrame:
    occ, _, nodes = shared(spark, sf_dir)
    tips = phylo.closure(nodes, 2).where("steps = 0").select(F.col("tip").alias("label")).where("label not like 'Brand#1%'")
    return tips.join(occ.select("label").distinct(), "label", "left_semi") if trim else tips


def _on_tree(spark, sf_dir, how: str, name: str, trim: bool = False) -> DataFrame:
    return lists.label_rows(*base_cube(spark, sf_dir)).join(_tips(spark, sf_dir, trim), "label", how).select("proc", F.col("label").alias(name))


def _off_tree(spark, sf_dir, name: str, trim: bool) -> DataFrame:
    rows = lists.label_rows(*base_cube(spark, sf_dir))
    off = rows.join(_tips(spark, sf_dir, trim).withColumn("on", F.lit(True)), "label", "left").groupBy("proc").agg(
        F.sort_array(F.collect_list(F.when(F.col("on").isNull(), F.col("label")))).alias(name), F.count("*").alias("k"), F.count_if(F.col("on").isNull()).alias(f"{name}_N"))
    return off.select("proc", name, f"{name}_N", F.round(F.col(f"{name}_N") / F.col("k"), 8).alias(f"{name}_P"))


for _name, _index, _trim in (("calc_labels_not_on_tree", "PHYLO_LABELS_NOT_ON_TREE", False), ("calc_labels_not_on_trimmed_tree", "PHYLO_LABELS_NOT_ON_TRIMMED_TREE", True)):
    register(_name, f"{ABC} SELECT proc, list_sort(coalesce(list(label) FILTER (NOT ({_LACKS})), [])) AS {_index}, count(*) FILTER (NOT ({_LACKS})) AS {_index}_N, round(count(*) FILTER (NOT ({_LACKS})) / CAST(count(*) AS DOUBLE), 8) AS {_index}_P FROM abc GROUP BY 1")(
        lambda spark, sf_dir, index=_index, trim=_trim: _off_tree(spark, sf_dir, index, trim)
    )


# ---- shared ancestors and clades


@register(
    "calc_last_shared_ancestor_props",
    f"""{_PART}, d AS (SELECT lca.*, len, is_tip, CASE WHEN depth = 0 THEN 0 ELSE dist END AS top FROM lca JOIN every USING (node)), e AS (SELECT *, CASE WHEN is_tip = 1 THEN 0 ELSE far - top END AS tip FROM d)
  SELECT proc, depth AS LAST_SHARED_ANCESTOR_DEPTH, round(len, 8) AS LAST_SHARED_ANCESTOR_LENGTH, round(top, 8) AS LAST_SHARED_ANCESTOR_DIST_TO_ROOT, round(tip, 8) AS LAST_SHARED_ANCESTOR_DIST_TO_TIP, round(coalesce(top / nullif(top + tip, 0), 0), 8) AS LAST_SHARED_ANCESTOR_POS_REL FROM e""",
)
def calc_last_shared_ancestor_props(spark, sf_dir):
    rows = clades.shared_ancestor(*_part(spark, sf_dir), 2)
    names = {"length": "LENGTH", "dist_root": "DIST_TO_ROOT", "dist_tip": "DIST_TO_TIP", "pos_rel": "POS_REL"}
    return rows.select("proc", F.col("depth").alias("LAST_SHARED_ANCESTOR_DEPTH"), *[_r(c, f"LAST_SHARED_ANCESTOR_{n}") for c, n in names.items()])


@register(
    "calc_pd_local",
    f"""{_PART}, pd AS (SELECT proc, sum(len) AS pd FROM cnt JOIN every USING (node) GROUP BY 1), whole AS (SELECT sum(len) AS t FROM every),
  l AS (SELECT proc, pd - CASE WHEN is_tip = 1 THEN 0 ELSE dist END AS x FROM pd JOIN lca USING (proc) JOIN every USING (node)) SELECT proc, round(x, 8) AS PD_LOCAL, round(x / t, 8) AS PD_LOCAL_P FROM l, whole""",
)
def calc_pd_local(spark, sf_dir):
    occ, nbrs, nodes = _part(spark, sf_dir)
    pd = clades.sampled(occ, nbrs, nodes, 2).join(nodes.select("node", "length"), "node").groupBy("proc").agg(F.sum("length").alias("pd"))
    last = clades.shared_ancestor(occ, nbrs, nodes, 2).join(clades.depths(nodes, 2).select("node", F.col("dist_root").alias("above")), "node")
    whole = nodes.agg(F.sum("length").alias("t"))
    local = F.col("pd") - F.when(F.col("is_tip"), 0.0).otherwise(F.col("above"))
    return pd.join(last.select("proc", "is_tip", "above"), "proc").crossJoin(F.broadcast(whole)).select("proc", _r(local, "PD_LOCAL"), _r(local / F.col("t"), "PD_LOCAL_P"))


_WEIGHTS = {
    "PD": "wt AS (SELECT proc, node, len AS w FROM cnt JOIN every USING (node))",
    "PE": "rr AS (SELECT node, count(DISTINCT proc) AS r FROM part_ JOIN paths ON label = tip GROUP BY 1), wt AS (SELECT proc, node, len / r AS w FROM cnt JOIN every USING (node) JOIN rr USING (node))",
}
_CLADES = """, inside AS (SELECT cnt.proc, cnt.node, tips FROM cnt JOIN tot USING (proc) JOIN lca ON lca.proc = cnt.proc WHERE tips < total OR cnt.node = lca.node),
  sc AS (SELECT proc, anc AS node, sum(w) AS score FROM wt JOIN up USING (node) GROUP BY 1, 2), pp AS (SELECT proc, sum(w) AS p FROM wt GROUP BY 1), whole AS (SELECT sum(len) AS t FROM every),
  con AS (SELECT proc, node, tips, score, floor(1e11 * score / p) / 1e11 AS contr, floor(1e11 * score / t) / 1e11 AS contr_p FROM inside JOIN sc USING (proc, node) JOIN pp USING (proc), whole),
  los AS (SELECT c.proc, c.node, c.score AS own, h.score, h.contr, h.contr_p, row_number() OVER (PARTITION BY c.proc, c.node ORDER BY steps DESC) AS i FROM con c JOIN up USING (node) JOIN con h ON h.proc = c.proc AND h.node = anc AND h.tips = c.tips)"""


def _weights(occ, nbrs, nodes, kind: str) -> DataFrame:
    rows = phylo.rows_of(occ, nbrs, nodes, 2)
    w = F.col("len") if kind == "PD" else F.col("len") * (F.col("k1") + F.col("k2")) / F.col("r")
    return rows.select("proc", "node", w.alias("w"), "tree")


def _contributed(spark, sf_dir, kind: str) -> tuple[DataFrame, DataFrame]:
    occ, nbrs, nodes = _part(spark, sf_dir)
    w = _weights(occ, nbrs, nodes, kind)
    length = nodes.agg(F.sum("length").alias("t"))
    out = clades.contributions(w.drop("tree"), nodes, 2, occ, nbrs, F.lit(1.0))
    return out.crossJoin(F.broadcast(length)).withColumn("contr_p", F.floor(1e11 * F.col("score") / F.col("t")) / 1e11).drop("t"), nodes


def _register_clades(kind: str) -> None:
    base = f"{_PART}, {_WEIGHTS[kind]}{_CLADES}"

    @register(f"calc_{kind.lower()}_clade_contributions", f"{base} SELECT proc, node, round(score, 8) AS {kind}_CLADE_SCORE, round(contr, 8) AS {kind}_CLADE_CONTR, round(contr_p, 8) AS {kind}_CLADE_CONTR_P FROM con")
    def _contributions(spark, sf_dir):
        return _contributed(spark, sf_dir, kind)[0].select("proc", "node", _r("score", f"{kind}_CLADE_SCORE"), _r("contr", f"{kind}_CLADE_CONTR"), _r("contr_p", f"{kind}_CLADE_CONTR_P"))

    @register(f"calc_{kind.lower()}_clade_loss", f"{base} SELECT proc, node, round(score, 8) AS {kind}_CLADE_LOSS_SCORE, round(contr, 8) AS {kind}_CLADE_LOSS_CONTR, round(contr_p, 8) AS {kind}_CLADE_LOSS_CONTR_P FROM los WHERE i = 1")
    def _loss(spark, sf_dir):
        rows = clades.losses(*_contributed(spark, sf_dir, kind), 2)
        return rows.select("proc", "node", _r("score", f"{kind}_CLADE_LOSS_SCORE"), _r("contr", f"{kind}_CLADE_LOSS_CONTR"), _r("contr_p", f"{kind}_CLADE_LOSS_CONTR_P"))

    @register(f"calc_{kind.lower()}_clade_loss_ancestral", f"{base} SELECT proc, node, round(score - own, 8) AS {kind}_CLADE_LOSS_ANC, round(coalesce((score - own) / nullif(score, 0), 0), 8) AS {kind}_CLADE_LOSS_ANC_P FROM los WHERE i = 1")
    def _ancestral(spark, sf_dir):
        rows = clades.losses(*_contributed(spark, sf_dir, kind), 2)
        return rows.select("proc", "node", _r("ancestral", f"{kind}_CLADE_LOSS_ANC"), _r("ancestral_p", f"{kind}_CLADE_LOSS_ANC_P"))


for _kind in ("PD", "PE"):
    _register_clades(_kind)


# ---- evolutionary distinctness

_AED = f"""{ABC}{TREE}, amt AS (SELECT label, sum(n) AS n FROM occ GROUP BY 1), bel AS (SELECT node, count(DISTINCT tip) AS tips, sum(n) AS amount FROM kept JOIN amt ON label = tip GROUP BY 1),
  brands AS (SELECT node, tips FROM bel WHERE node LIKE 'Brand#%' AND node NOT LIKE '%:%'),
  sco AS (SELECT tip AS label, sum(CASE WHEN kept.node = tip THEN len WHEN kept.node = 'root' THEN 0 ELSE len / bel.tips END) AS es, sum(len / bel.tips) AS ed, sum(len / amount) AS aed FROM kept JOIN bel ON bel.node = kept.node GROUP BY 1)"""


def _aed(spark, sf_dir) -> DataFrame:
    occ, nbrs, nodes = shared(spark, sf_dir)
    return indices.local(occ, nbrs).join(phylo.sent(nodes, clades.distinctness(occ, nodes, 2)), "label")


@register("calc_phylo_aed", f"{_AED} SELECT proc, label, round(es, 8) AS PHYLO_ES_LIST, round(ed, 8) AS PHYLO_ED_LIST, round(aed, 8) AS PHYLO_AED_LIST FROM abc JOIN sco USING (label)")
def calc_phylo_aed(spark, sf_dir):
    return _aed(spark, sf_dir).select("proc", "label", _r("es", "PHYLO_ES_LIST"), _r("ed", "PHYLO_ED_LIST"), _r("aed", "PHYLO_AED_LIST"))


@register("calc_phylo_aed_t", f"{_AED} SELECT proc, round(sum((n1 + n2) * aed), 8) AS PHYLO_AED_T FROM abc JOIN sco USING (label) GROUP BY 1")
def calc_phylo_aed_t(spark, sf_dir):
    return _aed(spark, sf_dir).groupBy("proc").agg(F.round(F.sum(F.col("ns") * F.col("aed")), 8).alias("PHYLO_AED_T"))


@register("calc_phylo_aed_t_wtlists", f"{_AED} SELECT proc, label, round((n1 + n2) * aed, 8) AS PHYLO_AED_T_WTLIST, round((n1 + n2) * aed / sum((n1 + n2) * aed) OVER (PARTITION BY proc), 8) AS PHYLO_AED_T_WTLIST_P FROM abc JOIN sco USING (label)")
def calc_phylo_aed_t_wtlists(spark, sf_dir):
    rows = _aed(spark, sf_dir).withColumn("w", F.col("ns") * F.col("aed"))
    return rows.withColumn("t", F.sum("w").over(Window.partitionBy("proc"))).select("proc", "label", _r("w", "PHYLO_AED_T_WTLIST"), _r(F.col("w") / F.col("t"), "PHYLO_AED_T_WTLIST_P"))


@register("calc_phylo_corrected_weighted_rarity", f"{_AED}, pdn AS (SELECT DISTINCT proc, node, len FROM abc JOIN kept ON label = tip), pds AS (SELECT proc, sum(len) AS pd FROM pdn GROUP BY 1) SELECT proc, round(sum((n1 + n2) * aed) / max(pd), 8) AS PHYLO_RARITY_CWR FROM abc JOIN sco USING (label) JOIN pds USING (proc) GROUP BY 1")
def calc_phylo_corrected_weighted_rarity(spark, sf_dir):
    total = _aed(spark, sf_dir).groupBy("proc").agg(F.sum(F.col("ns") * F.col("aed")).alias("t"))
    pd = _rows(spark, sf_dir).groupBy("proc").agg(F.sum("len").alias("pd"))
    return total.join(pd, "proc").select("proc", _r(F.col("t") / F.col("pd"), "PHYLO_RARITY_CWR"))


# ---- distances between tips

_DIST = """, t AS (SELECT DISTINCT tip, len FROM kept WHERE node = tip), br AS (SELECT DISTINCT node, len FROM kept WHERE node <> tip AND node <> 'root'),
  hi AS (SELECT split_part(tip, ':', 1) AS node, max(len) AS m FROM t GROUP BY 1),
  ds AS (SELECT x.tip AS a, y.tip AS b, x.len + y.len + CASE WHEN split_part(x.tip, ':', 1) = split_part(y.tip, ':', 1) THEN 0 ELSE bx.len + by_.len END AS d, y.len AS own,
    CASE WHEN bx.node = by_.node THEN bx.len + hi.m ELSE (SELECT max(br.len + h.m) FROM br JOIN hi h USING (node)) END AS high
    FROM t x JOIN t y ON x.tip <> y.tip JOIN br bx ON bx.node = split_part(x.tip, ':', 1) JOIN br by_ ON by_.node = split_part(y.tip, ':', 1) JOIN hi ON hi.node = bx.node)"""
for _kind, _w in ((1, "1e0"), (2, "CAST(g1 + g2 AS DOUBLE)"), (3, "n1 + n2")):
    _stats = ", ".join(f"round(sum({{0}} * d) / sum({{0}}), 6) AS {{1}}{_kind}_MEAN, round(greatest(sum({{0}} * d * d) / sum({{0}}) - pow(sum({{0}} * d) / sum({{0}}), 2), 0), 6) AS {{1}}{_kind}_VARIANCE, round(sqrt(sum({{0}} * d * d) / sum({{0}})), 6) AS {{1}}{_kind}_RMSD, sum({{0}}) AS {{1}}{_kind}_N, round(min(d), 6) AS {{1}}{_kind}_MIN, round(max(d), 6) AS {{1}}{_kind}_MAX" for _ in "x")

    @register(
        f"calc_phylo_mpd_mntd{_kind}",
        f"""{ABC}{TREE}{_DIST}, l AS (SELECT proc, label, {_w} AS w FROM abc), pp AS (SELECT x.proc, a, x.w AS wa, x.w * y.w AS w, d FROM l x JOIN ds ON x.label = a JOIN l y ON y.label = b AND y.proc = x.proc),
  p1 AS (SELECT proc, {_stats.format("w", "PMPD")} FROM pp GROUP BY 1), nn AS (SELECT proc, a, max(wa) AS w, min(d) AS d FROM pp GROUP BY 1, 2), p2 AS (SELECT proc, {_stats.format("w", "PNTD")} FROM nn GROUP BY 1) SELECT * FROM p1 JOIN p2 USING (proc)""",
    )
    def _mpd(spark, sf_dir, kind=_kind):
        occ, nbrs, nodes = shared(spark, sf_dir)
        rows = clades.pair_distances(occ, nbrs, nodes, 2, kind)
        names = {"mean": "MEAN", "variance": "VARIANCE", "rmsd": "RMSD", "n": "N", "min": "MIN", "max": "MAX"}
        pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
        return rows.groupBy("proc").agg(*[F.round(pick(m, c), 6).alias(f"{m}{kind}_{n}") for m in ("PMPD", "PNTD") for c, n in names.items()])


for _binary, _pre, _w in ((False, "TD", "n1 + n2"), (True, "TDB", "1e0")):

    @register(
        "calc_taxonomic_distinctness" + "_binary" * _binary,
        f"""{ABC}{TREE}{_DIST}, l AS (SELECT proc, label, {_w} AS w FROM abc), pp AS (SELECT x.proc, x.w * y.w AS w, (high - own) * x.w * y.w AS v FROM l x JOIN ds ON x.label = a JOIN l y ON y.label = b AND y.proc = x.proc)
  SELECT proc, round(sum(v) / sum(w), 6) AS {_pre}_DISTINCTNESS, sum(w) AS {_pre}_DENOMINATOR, round(sum(v), 3) AS {_pre}_NUMERATOR, round(sum(v * v) / sum(w) - pow(sum(v) / sum(w), 2), 3) AS {_pre}_VARIATION FROM pp GROUP BY 1""",
    )
    def _td(spark, sf_dir, binary=_binary, pre=_pre):
        occ, nbrs, nodes = shared(spark, sf_dir)
        rows = clades.taxonomic_distinctness(occ, nbrs, nodes, 2, binary)
        return rows.select("proc", F.round("distinctness", 6).alias(f"{pre}_DISTINCTNESS"), F.col("denominator").alias(f"{pre}_DENOMINATOR"), F.round("numerator", 3).alias(f"{pre}_NUMERATOR"), F.round("variation", 3).alias(f"{pre}_VARIATION"))


_ELBOW = "SELECT v FROM (SELECT *, abs(i * (max(v) OVER () - min(v) OVER ()) - (count(*) OVER () - 1) * (v - min(v) OVER ())) AS far FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM ({0}) q) z) y ORDER BY round(far, 9) DESC, i LIMIT 1"


@register(
    "calc_rwibald",
    f"""{_PR}, b AS (SELECT node, 1e0 / r AS inv, (len - CASE WHEN len <> 0 THEN 1 ELSE 0 END) / r AS diff FROM nodes JOIN nrange USING (node)),
  lim AS (SELECT ({_ELBOW.format("SELECT inv AS v FROM b")}) AS rare_, ({_ELBOW.format("SELECT diff AS v FROM b WHERE diff >= 0")}) AS hi, ({_ELBOW.format("SELECT diff AS v FROM b WHERE diff <= 0")}) AS lo)
  SELECT proc, node, CASE WHEN inv < rare_ THEN 0 WHEN diff <= lo THEN 1 WHEN diff >= hi THEN 3 ELSE 2 END AS RWIBALD_CODES, round(diff, 8) AS RWIBALD_DIFFS, CASE WHEN inv >= rare_ THEN round(diff, 8) END AS RWIBALD_RR_DIFFS FROM pn JOIN b USING (node), lim""",
)
def calc_rwibald(spark, sf_dir):
    occ, nbrs, nodes = shared(spark, sf_dir)
    codes = clades.branch_codes(occ, nodes, 2)
    held = _rows(spark, sf_dir).select("proc", "node")
    return held.join(phylo.sent(nodes, codes), "node").select("proc", "node", F.col("code").alias("RWIBALD_CODES"), _r("diff", "RWIBALD_DIFFS"), _r("rare", "RWIBALD_RR_DIFFS"))


# ---- expectations over random tips

_SIZES = (2, 3, 5, 10, 50)
_BOTH = f"""{OCC}{TREE}, every AS (SELECT node, max(len) AS len, count(*) AS t FROM paths GROUP BY 1), ss AS (SELECT CAST(count(DISTINCT tip) AS DOUBLE) AS s FROM paths)"""


@register("get_nri_expected_mean", f"{_BOTH} SELECT round(2 / (s * (s - 1)) * sum(len * t * (s - t)), 6) AS mean FROM every, ss GROUP BY s")
def get_nri_expected_mean(spark, sf_dir):
    return clades.expected_mpd(shared(spark, sf_dir)[2], 2, (2,)).select(F.round("mean", 6).alias("mean"))


@register(
    "get_nri_expected_sd",
    f"""{_BOTH}, tp AS (SELECT tip, max(len) FILTER (node = tip) AS len, max(len) FILTER (node <> tip AND node <> 'root') AS up, split_part(tip, ':', 1) AS b FROM paths GROUP BY 1),
  dd AS (SELECT x.tip AS a, y.tip AS c, x.len + y.len + CASE WHEN x.b = y.b THEN 0 ELSE x.up + y.up END AS d FROM tp x JOIN tp y ON x.tip < y.tip),
  one AS (SELECT tip, sum(d) AS t, sum(d * d) AS q FROM (SELECT a AS tip, d FROM dd UNION ALL SELECT c, d FROM dd) GROUP BY 1), su AS (SELECT sum(t) / 2 AS s1, sum(q) / 2 AS s2, sum(t * t - q) AS s3 FROM one),
  ks AS (SELECT CAST(unnest({list(_SIZES)}) AS DOUBLE) AS r)
  SELECT CAST(r AS INT) AS r, round(CASE WHEN r = s THEN 0 ELSE sqrt(greatest(0, 4 / (r * r * (r - 1) * (r - 1)) * (r * (r - 1) / (s * (s - 1)) * s2 + r * (r - 1) * (r - 2) / (s * (s - 1) * (s - 2)) * s3
    + r * (r - 1) * (r - 2) * (r - 3) / (s * (s - 1) * (s - 2) * (s - 3)) * (s1 * s1 - s2 - s3)) - pow(2 * s1 / (s * (s - 1)), 2))) END, 5) AS sd FROM su, ss, ks WHERE r <= s""",
)
def get_nri_expected_sd(spark, sf_dir):
    return clades.expected_mpd(shared(spark, sf_dir)[2], 2, _SIZES).select("r", F.round("sd", 5).alias("sd"))


@register("get_nti_expected_mean", f"{_BOTH}, eqs2 AS (SELECT node, CASE WHEN node = 'root' THEN 0e0 ELSE 1e0 END AS len, t FROM every), ks AS (SELECT CAST(unnest({list(_SIZES)}) AS DOUBLE) AS r) SELECT CAST(r AS INT) AS r, round(2 / r * sum(len * t * CASE WHEN s - t >= r - 1 THEN exp(lgamma(s - t + 1) - lgamma(r) - lgamma(s - t - r + 2) - lgamma(s + 1) + lgamma(r + 1) + lgamma(s - r + 1)) ELSE 0 END), 6) AS mean FROM eqs2, ss, ks WHERE r <= s GROUP BY r")
def get_nti_expected_mean(spark, sf_dir):
    """Over the tree with equal branches, whose tips are equally far from the root."""
    nodes = phylo.equalised(shared(spark, sf_dir)[2], 1.0)
    return clades.expected_mntd(nodes, 2, _SIZES).select("r", F.round("mean", 6).alias("mean"))
