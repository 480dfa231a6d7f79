"""SQL of the index calculations, written from their definitions and apart from the Spark formulas.

Rows of ``abc``: a label of a centre with local groups (g1, g2), samples (n1,
n2) and presence (in1, in2) in either set, range r, abundance a, groups of the
sets (e1, e2) and all labels of the cube (total).
"""

from __future__ import annotations

from quadrat.plans.registry import ABC

_M = """, m AS (SELECT proc, CAST(count(*) AS DOUBLE) AS s, CAST(sum(in1) AS DOUBLE) AS s1, CAST(sum(in2) AS DOUBLE) AS s2, CAST(sum(in1 * in2) AS DOUBLE) AS both_,
    sum(n1 + n2) AS t, sum(n1) AS t1, sum(n2) AS t2, max(e1) + max(e2) AS e, CAST(max(e1) AS DOUBLE) AS e1, CAST(max(e2) AS DOUBLE) AS e2, max(total) AS total FROM abc GROUP BY 1)"""
_FROM_M = " FROM m"
_FROM_ABC = " FROM abc GROUP BY proc"
_VALID = "both_ > 0 OR (s1 > both_ AND s2 > both_)"


def _sd(x: str) -> str:
    return f"CASE WHEN count({x}) = 1 THEN 0 ELSE stddev_samp({x}) END"


_G, _G1, _G2 = "CAST(g1 + g2 AS DOUBLE)", "CASE WHEN g1 > 0 THEN CAST(g1 AS DOUBLE) END", "CASE WHEN g2 > 0 THEN CAST(g2 AS DOUBLE) END"
_N, _N1, _N2 = "n1 + n2", "CASE WHEN g1 > 0 THEN n1 END", "CASE WHEN g2 > 0 THEN n2 END"
_W = "CAST(g1 + g2 AS DOUBLE) / r"

#: (what each index is, where from).
DEFINITIONS: dict[str, tuple[dict[str, str], str]] = {
    "calc_richness": ({"RICHNESS_ALL": "s", "RICHNESS_SET1": "s1", "RICHNESS_SET2": "s2"}, _FROM_M),
    "calc_redundancy": ({"REDUNDANCY_ALL": "1 - s / nullif(t, 0)", "REDUNDANCY_SET1": "1 - s1 / nullif(t1, 0)", "REDUNDANCY_SET2": "1 - s2 / nullif(t2, 0)"}, _FROM_M),
    "calc_local_range_stats": (
        {"ABC2_MEAN_ALL": f"avg({_G})", "ABC2_SD_ALL": _sd(_G), "ABC2_MEAN_SET1": f"avg({_G1})", "ABC2_SD_SET1": _sd(_G1), "ABC2_MEAN_SET2": f"avg({_G2})", "ABC2_SD_SET2": _sd(_G2)},
        _FROM_ABC,
    ),
    "calc_local_sample_count_stats": (
        {
            "ABC3_MEAN_ALL": f"avg({_N})", "ABC3_SD_ALL": _sd(_N), "ABC3_MEAN_SET1": f"avg({_N1})", "ABC3_SD_SET1": _sd(_N1), "ABC3_MEAN_SET2": f"avg({_N2})", "ABC3_SD_SET2": _sd(_N2),
            "ABC3_SUM_ALL": "sum(n1) + sum(n2)", "ABC3_SUM_SET1": "sum(n1)", "ABC3_SUM_SET2": "sum(n2)",
        },
        _FROM_ABC,
    ),
    "calc_abc_counts": ({"ABC_A": "both_", "ABC_B": "s1 - both_", "ABC_C": "s2 - both_", "ABC_ABC": "s1 + s2 - both_"}, _FROM_M),
    "calc_d": ({"ABC_D": "total - s"}, _FROM_M),
    "calc_elements_used": ({"EL_COUNT_SET1": "count(*) FILTER (s = 1)", "EL_COUNT_SET2": "count(*) FILTER (s = 2)", "EL_COUNT_ALL": "count(*)"}, " FROM nbrs GROUP BY proc"),
    "calc_kulczynski2": ({"KULCZYNSKI2": f"CASE WHEN {_VALID} THEN 1 - (both_ / nullif(s1, 0) + both_ / nullif(s2, 0)) / 2 END"}, _FROM_M),
    "calc_sorenson": ({"SORENSON": f"CASE WHEN {_VALID} THEN (s1 + s2 - 2 * both_) / nullif(s1 + s2, 0) END"}, _FROM_M),
    "calc_jaccard": ({"JACCARD": f"CASE WHEN {_VALID} THEN (s - both_) / nullif(s, 0) END"}, _FROM_M),
    "calc_nestedness_resultant": ({"NEST_RESULTANT": "CASE WHEN s1 = 0 OR s2 = 0 THEN NULL WHEN both_ = 0 THEN 0 ELSE abs(s1 - s2) / (s1 + s2) * both_ / least(s1, s2) END"}, _FROM_M),
    "calc_bray_curtis": ({"BRAY_CURTIS": "sum(abs(n1 - n2)) / nullif(sum(n1 + n2), 0)", "BC_A": "sum(n1)", "BC_B": "sum(n2)", "BC_W": "(sum(n1 + n2) - sum(abs(n1 - n2))) / 2"}, _FROM_ABC),
    "calc_bray_curtis_norm_by_gp_counts": (
        {
            "BRAY_CURTIS_NORM": "sum(abs(n1 / e1 - n2 / nullif(e2, 0))) / nullif(sum(n1 / e1 + n2 / nullif(e2, 0)), 0)", "BCN_A": "sum(n1 / e1)", "BCN_B": "sum(n2 / nullif(e2, 0))",
            "BCN_W": "(sum(n1 / e1 + n2 / nullif(e2, 0)) - sum(abs(n1 / e1 - n2 / nullif(e2, 0)))) / 2",
        },
        _FROM_ABC,
    ),
    "calc_beta_diversity": ({"BETA_2": "s / nullif(greatest(s1, s2), 0) - 1"}, _FROM_M),
    "calc_s2": ({"S2": "1 - both_ / nullif(least(s1, s2), 0)"}, _FROM_M),
    "calc_simpson_shannon": (
        {"SIMPSON_D": "1 - sum(p * p)", "SHANNON_H": "-sum(p * ln(p))", "SHANNON_HMAX": "ln(count(*))", "SHANNON_E": "-sum(p * ln(p)) / nullif(ln(count(*)), 0)"},
        " FROM (SELECT proc, (n1 + n2) / sum(n1 + n2) OVER (PARTITION BY proc) AS p FROM abc) GROUP BY proc",
    ),
    "calc_tx_rao_qe": ({"TX_RAO_QE": "1 - sum(p * p)", "TX_RAO_TN": "count(*) * count(*)"}, " FROM (SELECT proc, (n1 + n2) / sum(n1 + n2) OVER (PARTITION BY proc) AS p FROM abc) GROUP BY proc"),
    "calc_rw_turnover": (
        {"RW_TURNOVER": "CASE WHEN x + y > 0 AND x + z > 0 THEN (y + z) / (x + y + z) END", "RW_TURNOVER_A": "x", "RW_TURNOVER_B": "y", "RW_TURNOVER_C": "z"},
        f" FROM (SELECT proc, coalesce(sum({_W}) FILTER (g1 > 0 AND g2 > 0), 0) AS x, coalesce(sum({_W}) FILTER (g2 = 0), 0) AS y, coalesce(sum({_W}) FILTER (g1 = 0), 0) AS z FROM abc GROUP BY 1)",
    ),
    "calc_endemism_central": ({"ENDC_WE": f"sum({_W})", "ENDC_CWE": f"avg({_W})", "ENDC_RICHNESS": "count(*)", "ENDC_SINGLE": "sum(1e0 / r)"}, " FROM abc WHERE g1 > 0 GROUP BY proc"),
    "calc_endemism_central_normalised": ({"ENDC_WE_NORM": f"sum({_W}) / max(e1 + e2)", "ENDC_CWE_NORM": f"avg({_W}) / max(e1 + e2)"}, " FROM abc WHERE g1 > 0 GROUP BY proc"),
    "calc_endemism_whole": ({"ENDW_WE": f"sum({_W})", "ENDW_CWE": f"avg({_W})", "ENDW_RICHNESS": "count(*)", "ENDW_SINGLE": "sum(1e0 / r)"}, _FROM_ABC),
    "calc_endemism_whole_normalised": ({"ENDW_WE_NORM": f"sum({_W}) / max(e1 + e2)", "ENDW_CWE_NORM": f"avg({_W}) / max(e1 + e2)"}, _FROM_ABC),
    "calc_endemism_absolute": (
        {
            "END_ABS_ALL": "count(*) FILTER (g1 + g2 = r)", "END_ABS1": "count(*) FILTER (g1 = r)", "END_ABS2": "count(*) FILTER (g2 = r)", "END_ABS_ALL_P": "count(*) FILTER (g1 + g2 = r) / CAST(count(*) AS DOUBLE)",
            "END_ABS1_P": "count(*) FILTER (g1 = r) / nullif(CAST(sum(in1) AS DOUBLE), 0)", "END_ABS2_P": "count(*) FILTER (g2 = r) / nullif(CAST(sum(in2) AS DOUBLE), 0)",
        },
        _FROM_ABC,
    ),
    "calc_rarity_central": ({"RAREC_WE": "sum((n1 + n2) / a)", "RAREC_CWE": "avg((n1 + n2) / a)", "RAREC_RICHNESS": "count(*)"}, " FROM abc WHERE g1 > 0 GROUP BY proc"),
    "calc_rarity_whole": ({"RAREW_WE": "sum((n1 + n2) / a)", "RAREW_CWE": "avg((n1 + n2) / a)", "RAREW_RICHNESS": "count(*)"}, _FROM_ABC),
}


def index_sql(name: str) -> str:
    what, source = DEFINITIONS[name]
    return f"{ABC}{_M} SELECT proc, {', '.join(f'round(CAST({e} AS DOUBLE), 8) AS {i}' for i, e in what.items())}{source}"


#: Per centre: nodes with local ranges k1, k2, samples n, length, range r and whether tips, of the tree trimmed to the cube.
NODE_DEFINITIONS: dict[str, dict[str, str]] = {
    "calc_pd": {"PD": "sum(len)", "PD_P": "sum(len) / max(whole)"},
    "calc_pd_terminal_node_count": {"PD_INCLUDED_TERMINAL_NODE_COUNT": "count(*) FILTER (is_tip = 1)"},
    "calc_count_labels_on_tree": {"PHYLO_LABELS_ON_TREE_COUNT": "count(*) FILTER (is_tip = 1)"},
    "calc_pe": {"PE_WE": "sum(w)", "PE_WE_P": "sum(w) / max(trimmed)"},
    "calc_pe_single": {"PE_WE_SINGLE": "sum(len / r)", "PE_WE_SINGLE_P": "sum(len / r) / max(trimmed)"},
    "calc_pe_central": {"PEC_WE": "sum(w) FILTER (k1 > 0)", "PEC_WE_P": "sum(w) FILTER (k1 > 0) / max(trimmed)"},
    "calc_pe_central_cwe": {"PEC_CWE": "sum(w) FILTER (k1 > 0) / nullif(sum(len) FILTER (k1 > 0), 0)", "PEC_CWE_PD": "sum(len) FILTER (k1 > 0)"},
    "calc_pd_endemism": {"PD_ENDEMISM": "coalesce(sum(len) FILTER (k1 + k2 = r), 0)", "PD_ENDEMISM_P": "coalesce(sum(len) FILTER (k1 + k2 = r), 0) / max(trimmed)"},
    "calc_phylo_corrected_weighted_endemism": {"PE_CWE": "sum(w) / nullif(sum(len), 0)"},
    "calc_phylo_abundance": {"PHYLO_ABUNDANCE": "sum(n * len)"},
    "calc_phylo_abc": {"PHYLO_A": "coalesce(sum(len) FILTER (k1 > 0 AND k2 > 0), 0)", "PHYLO_B": "coalesce(sum(len) FILTER (k2 = 0), 0)", "PHYLO_C": "coalesce(sum(len) FILTER (k1 = 0), 0)", "PHYLO_ABC": "sum(len)"},
    "calc_phylo_sorenson": {"PHYLO_SORENSON": "1 - 2 * pa / nullif(pa + sum(len), 0)"},
    "calc_phylo_jaccard": {"PHYLO_JACCARD": "1 - pa / nullif(sum(len), 0)"},
    "calc_phylo_s2": {"PHYLO_S2": "1 - pa / nullif(least(sum(len) FILTER (k1 > 0), coalesce(sum(len) FILTER (k2 > 0), 0)), 0)"},
    "calc_phylo_rw_turnover": {
        "PHYLO_RW_TURNOVER": "1 - coalesce(sum(w) FILTER (k1 > 0 AND k2 > 0), 0) / nullif(sum(w), 0)", "PHYLO_RW_TURNOVER_A": "coalesce(sum(w) FILTER (k1 > 0 AND k2 > 0), 0)",
        "PHYLO_RW_TURNOVER_B": "coalesce(sum(w) FILTER (k2 = 0), 0)", "PHYLO_RW_TURNOVER_C": "coalesce(sum(w) FILTER (k1 = 0), 0)",
    },
    "calc_phylo_rpd1": {
        "PHYLO_RPD1": "sum(len) / max(whole) / (count(*) FILTER (is_tip = 1) / max(whole_tips))", "PHYLO_RPD_NULL1": "count(*) FILTER (is_tip = 1) / max(whole_tips)",
        "PHYLO_RPD_DIFF1": "sum(len) - max(whole) * count(*) FILTER (is_tip = 1) / max(whole_tips)",
    },
    "calc_phylo_rpd2": {
        "PHYLO_RPD2": "sum(len) / max(whole) / (count(*) FILTER (len > 0) / max(whole_long))", "PHYLO_RPD_NULL2": "count(*) FILTER (len > 0) / max(whole_long)",
        "PHYLO_RPD_DIFF2": "sum(len) - max(whole) * count(*) FILTER (len > 0) / max(whole_long)",
    },
    "calc_phylo_rpe2": {
        "PHYLO_RPE2": "sum(w) / max(trimmed) / (sum((k1 + k2) / r) FILTER (len > 0) / max(trimmed_long))", "PHYLO_RPE_NULL2": "sum((k1 + k2) / r) FILTER (len > 0) / max(trimmed_long)",
        "PHYLO_RPE_DIFF2": "sum(w) - max(trimmed) * sum((k1 + k2) / r) FILTER (len > 0) / max(trimmed_long)",
    },
    "calc_phylo_rpe_central": {
        "PHYLO_RPEC": "sum(w) FILTER (k1 > 0) / max(trimmed) / (sum((k1 + k2) / r) FILTER (len > 0 AND k1 > 0) / max(trimmed_long))", "PHYLO_RPE_NULLC": "sum((k1 + k2) / r) FILTER (len > 0 AND k1 > 0) / max(trimmed_long)",
        "PHYLO_RPE_DIFFC": "sum(w) FILTER (k1 > 0) - max(trimmed) * sum((k1 + k2) / r) FILTER (len > 0 AND k1 > 0) / max(trimmed_long)",
    },
    "calc_phylo_rpe1": {
        "PHYLO_RPE1": "sum(w) / max(trimmed) / (sum((k1 + k2) / r) FILTER (is_tip = 1) / max(trimmed_tips))", "PHYLO_RPE_NULL1": "sum((k1 + k2) / r) FILTER (is_tip = 1) / max(trimmed_tips)",
        "PHYLO_RPE_DIFF1": "sum(w) - max(trimmed) * sum((k1 + k2) / r) FILTER (is_tip = 1) / max(trimmed_tips)",
    },
}

#: Nodes of each centre, and totals of the whole and of the trimmed tree.
NODES = """, byg AS (SELECT DISTINCT proc, node, grp, s FROM nbrs JOIN occ USING (grp) JOIN kept ON label = tip),
  amount AS (SELECT proc, node, sum(n) AS n FROM nbrs JOIN occ USING (grp) JOIN kept ON label = tip GROUP BY 1, 2),
  every AS (SELECT node, max(len) AS len, max(is_tip) AS is_tip FROM paths GROUP BY 1),
  pn AS (SELECT proc, node, CAST(count(*) FILTER (s = 1) AS DOUBLE) AS k1, CAST(count(*) FILTER (s = 2) AS DOUBLE) AS k2 FROM byg GROUP BY 1, 2),
  pr AS (SELECT pn.*, amount.n, len, is_tip, r, len * (k1 + k2) / r AS w,
    (SELECT sum(len) FROM every) AS whole, (SELECT CAST(sum(is_tip) AS DOUBLE) FROM every) AS whole_tips, (SELECT CAST(count(*) AS DOUBLE) FROM every WHERE len > 0) AS whole_long,
    (SELECT sum(len) FROM nodes) AS trimmed, (SELECT CAST(sum(is_tip) AS DOUBLE) FROM nodes) AS trimmed_tips, (SELECT CAST(count(*) AS DOUBLE) FROM nodes WHERE len > 0) AS trimmed_long
    FROM pn JOIN amount USING (proc, node) JOIN nodes USING (node) JOIN nrange USING (node))"""


def node_sql(name: str) -> str:
    from quadrat.plans.registry import NBRS, TREE

    shared = "coalesce(sum(len) FILTER (k1 > 0 AND k2 > 0), 0)"
    what = ", ".join(f"round(CAST({e.replace('pa ', shared + ' ')} AS DOUBLE), 8) AS {i}" for i, e in NODE_DEFINITIONS[name].items())
    return f"{NBRS}{TREE}{NODES} SELECT proc, {what} FROM pr GROUP BY proc"
