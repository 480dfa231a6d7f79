"""Index calculations over two neighbour sets.

``abc`` is the shared sub-plan: for each centre and label the number of groups
and samples in each set.  A calculation is a set of formulas over its
aggregates; formulas are SQL that divides by NULLIF, so invalid results are
null.  One aggregation serves any number of calculations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat import cube


def _by_set(held: DataFrame) -> DataFrame:
    one, two = F.col("set") == 1, F.col("set") == 2
    return held.groupBy("proc", "label").agg(
        F.count_if(one).alias("g1"), F.count_if(two).alias("g2"),
        F.sum(F.when(one, F.col("n")).otherwise(0.0)).alias("n1"), F.sum(F.when(two, F.col("n")).otherwise(0.0)).alias("n2"),
    )


def local(occ: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(proc, label, g1, g2, n1, n2, g, ns): local groups and samples by set and of both.

    All rows of a centre lie in one partition, so that what is summed by proc
    and anything else, or runs in windows of a proc, is not shuffled again.
    """
    return _by_set(nbrs.join(occ, "grp").repartition("proc")).withColumns({"g": F.col("g1") + F.col("g2"), "ns": F.col("n1") + F.col("n2")})


def abc(occ: DataFrame, nbrs: DataFrame) -> DataFrame:
    """(proc, label, g1, g2, n1, n2, in1, in2, r, a, gn1, gn2): local groups and samples by set, presence, range, abundance."""
    local = _by_set(nbrs.join(occ, "grp"))
    known = cube.labels(occ).select("label", F.col("range").alias("r"), F.col("abundance").alias("a"))
    flags = local.join(known, "label").withColumns({"in1": (F.col("g1") > 0).cast("int"), "in2": (F.col("g2") > 0).cast("int")})
    return flags


#: Aggregates over the labels of a centre.  g, n: local groups and samples in both sets.
AGGREGATES = {
    "A": "sum(in1 * in2)", "B": "sum(in1 * (1 - in2))", "C": "sum(in2 * (1 - in1))", "ABC": "count(*)",
    "N1": "sum(n1)", "N2": "sum(n2)", "N": "sum(n1 + n2)", "W": "sum(least(n1, n2))",
    "WN": "sum(least(n1 / nullif(e1, 0), n2 / nullif(e2, 0)))",
    "NN": "sum((n1 + n2) * (n1 + n2))", "NLN": "sum((n1 + n2) * ln(n1 + n2))",
    "GM": "avg(1e0 * (g1 + g2))", "GM1": "avg(case when in1 = 1 then 1e0 * g1 end)", "GM2": "avg(case when in2 = 1 then 1e0 * g2 end)",
    "GS": "stddev_samp(1e0 * (g1 + g2))", "GS1": "stddev_samp(case when in1 = 1 then 1e0 * g1 end)", "GS2": "stddev_samp(case when in2 = 1 then 1e0 * g2 end)",
    "NM": "avg(n1 + n2)", "NM1": "avg(case when in1 = 1 then n1 end)", "NM2": "avg(case when in2 = 1 then n2 end)",
    "NS": "stddev_samp(n1 + n2)", "NS1": "stddev_samp(case when in1 = 1 then n1 end)", "NS2": "stddev_samp(case when in2 = 1 then n2 end)",
    "WE": "sum(1e0 * (g1 + g2) / r)", "WE1": "sum(in1 * 1e0 * (g1 + g2) / r)", "SG": "sum(1e0 / r)", "SG1": "sum(in1 * 1e0 / r)",
    "RW": "sum((n1 + n2) / a)", "RW1": "sum(in1 * (n1 + n2) / a)",
    "EA": "sum(case when r <= g1 + g2 then 1 else 0 end)", "EA1": "sum(case when in1 = 1 and r <= g1 then 1 else 0 end)", "EA2": "sum(case when in2 = 1 and r <= g2 then 1 else 0 end)",
    "TA": "sum(in1 * in2 * 1e0 * (g1 + g2) / r)", "TB": "sum(in1 * (1 - in2) * 1e0 * g1 / r)", "TC": "sum(in2 * (1 - in1) * 1e0 * g2 / r)",
    "F1": "sum(case when n1 + n2 = 1 then 1 else 0 end)", "F2": "sum(case when n1 + n2 = 2 then 1 else 0 end)",
    "Q1": "sum(case when g1 + g2 = 1 then 1 else 0 end)", "Q2": "sum(case when g1 + g2 = 2 then 1 else 0 end)",
    "E1": "max(e1)", "E2": "max(e2)", "L": "max(total)",
}

_VALID = "A > 0 or (B > 0 and C > 0)"


def _fixed(sd: str, n: str) -> str:
    """The sample SD, 0 for a single value."""
    return f"coalesce({sd}, case when {n} = 1 then 0e0 end)"


#: Formulas of each calculation.
CALCULATIONS: dict[str, dict[str, str]] = {
    "calc_richness": {"RICHNESS_ALL": "ABC", "RICHNESS_SET1": "A + B", "RICHNESS_SET2": "A + C"},
    "calc_redundancy": {"REDUNDANCY_ALL": "1 - ABC / nullif(N, 0)", "REDUNDANCY_SET1": "1 - (A + B) / nullif(N1, 0)", "REDUNDANCY_SET2": "1 - (A + C) / nullif(N2, 0)"},
    "calc_local_range_stats": {"ABC2_MEAN_ALL": "GM", "ABC2_SD_ALL": _fixed("GS", "ABC"), "ABC2_MEAN_SET1": "GM1", "ABC2_SD_SET1": _fixed("GS1", "A + B"), "ABC2_MEAN_SET2": "GM2", "ABC2_SD_SET2": _fixed("GS2", "A + C")},
    "calc_local_sample_count_stats": {"ABC3_MEAN_ALL": "NM", "ABC3_SD_ALL": _fixed("NS", "ABC"), "ABC3_MEAN_SET1": "NM1", "ABC3_SD_SET1": _fixed("NS1", "A + B"), "ABC3_MEAN_SET2": "NM2", "ABC3_SD_SET2": _fixed("NS2", "A + C"), "ABC3_SUM_ALL": "N", "ABC3_SUM_SET1": "N1", "ABC3_SUM_SET2": "N2"},
    "calc_abc_counts": {"ABC_A": "A", "ABC_B": "B", "ABC_C": "C", "ABC_ABC": "ABC"},
    "calc_d": {"ABC_D": "L - ABC"},
    "calc_elements_used": {"EL_COUNT_SET1": "E1", "EL_COUNT_SET2": "E2", "EL_COUNT_ALL": "E1 + E2"},
    "calc_nonempty_elements_used": {"EL_COUNT_NONEMPTY_SET1": "E1", "EL_COUNT_NONEMPTY_SET2": "E2", "EL_COUNT_NONEMPTY_ALL": "E1 + E2"},
    "calc_kulczynski2": {"KULCZYNSKI2": f"case when {_VALID} then 1 - 0.5e0 * (1e0 * A / nullif(A + B, 0) + 1e0 * A / nullif(A + C, 0)) end"},
    "calc_sorenson": {"SORENSON": f"case when {_VALID} then 1 - 2e0 * A / nullif(A + ABC, 0) end"},
    "calc_jaccard": {"JACCARD": f"case when {_VALID} then 1 - 1e0 * A / nullif(ABC, 0) end"},
    "calc_nestedness_resultant": {"NEST_RESULTANT": "case when A = 0 and B > 0 and C > 0 then 0e0 when A + B > 0 and A + C > 0 then 1e0 * abs(B - C) / nullif(A + ABC, 0) * A / nullif(A + least(B, C), 0) end"},
    "calc_bray_curtis": {"BRAY_CURTIS": "1 - 2e0 * W / nullif(N1 + N2, 0)", "BC_A": "N1", "BC_B": "N2", "BC_W": "W"},
    "calc_bray_curtis_norm_by_gp_counts": {"BRAY_CURTIS_NORM": "1 - 2e0 * WN / nullif(N1 / nullif(E1, 0) + N2 / nullif(E2, 0), 0)", "BCN_A": "N1 / nullif(E1, 0)", "BCN_B": "N2 / nullif(E2, 0)", "BCN_W": "WN"},
    "calc_beta_diversity": {"BETA_2": "1e0 * ABC / nullif(greatest(A + B, A + C), 0) - 1"},
    "calc_s2": {"S2": "1 - 1e0 * A / nullif(A + least(B, C), 0)"},
    "calc_simpson_shannon": {"SIMPSON_D": "1 - NN / nullif(N * N, 0)", "SHANNON_H": "ln(N) - NLN / nullif(N, 0)", "SHANNON_HMAX": "ln(1e0 * ABC)", "SHANNON_E": "(ln(N) - NLN / nullif(N, 0)) / nullif(ln(1e0 * ABC), 0)"},
    "calc_tx_rao_qe": {"TX_RAO_QE": "1 - NN / nullif(N * N, 0)", "TX_RAO_TN": "ABC * ABC"},
    "calc_rw_turnover": {"RW_TURNOVER": "case when (TA > 0 or TB > 0) and (TA > 0 or TC > 0) then 1 - TA / nullif(TA + TB + TC, 0) end", "RW_TURNOVER_A": "TA", "RW_TURNOVER_B": "TB", "RW_TURNOVER_C": "TC"},
    "calc_endemism_central": {"ENDC_WE": "WE1", "ENDC_CWE": "WE1 / nullif(A + B, 0)", "ENDC_RICHNESS": "A + B", "ENDC_SINGLE": "SG1"},
    "calc_endemism_central_normalised": {"ENDC_WE_NORM": "WE1 / nullif(E1 + E2, 0)", "ENDC_CWE_NORM": "WE1 / nullif(A + B, 0) / nullif(E1 + E2, 0)"},
    "calc_endemism_whole": {"ENDW_WE": "WE", "ENDW_CWE": "WE / nullif(ABC, 0)", "ENDW_RICHNESS": "ABC", "ENDW_SINGLE": "SG"},
    "calc_endemism_whole_normalised": {"ENDW_WE_NORM": "WE / nullif(E1 + E2, 0)", "ENDW_CWE_NORM": "WE / nullif(ABC, 0) / nullif(E1 + E2, 0)"},
    "calc_endemism_absolute": {"END_ABS_ALL": "EA", "END_ABS1": "EA1", "END_ABS2": "EA2", "END_ABS_ALL_P": "1e0 * EA / nullif(ABC, 0)", "END_ABS1_P": "1e0 * EA1 / nullif(A + B, 0)", "END_ABS2_P": "1e0 * EA2 / nullif(A + C, 0)"},
    "calc_rarity_central": {"RAREC_WE": "RW1", "RAREC_CWE": "RW1 / nullif(A + B, 0)", "RAREC_RICHNESS": "A + B"},
    "calc_rarity_whole": {"RAREW_WE": "RW", "RAREW_CWE": "RW / nullif(ABC, 0)", "RAREW_RICHNESS": "ABC"},
    "calc_chao1": {"CHAO1_F1_COUNT": "F1", "CHAO1_F2_COUNT": "F2", "CHAO1_UNDETECTED": "case when F2 > 0 then (N - 1) / nullif(N, 0) * F1 * F1 / (2e0 * F2) else (N - 1) / nullif(N, 0) * F1 * (F1 - 1) / 2e0 end", "CHAO1_ESTIMATE": "ABC + case when F2 > 0 then (N - 1) / nullif(N, 0) * F1 * F1 / (2e0 * F2) else (N - 1) / nullif(N, 0) * F1 * (F1 - 1) / 2e0 end"},
    "calc_chao2": {"CHAO2_Q1_COUNT": "Q1", "CHAO2_Q2_COUNT": "Q2", "CHAO2_ESTIMATE": "ABC + case when Q2 > 0 then (E1 + E2 - 1) / nullif(1e0 * (E1 + E2), 0) * Q1 * Q1 / (2e0 * Q2) else (E1 + E2 - 1) / nullif(1e0 * (E1 + E2), 0) * Q1 * (Q1 - 1) / 2e0 end"},
}


def calculate(occ: DataFrame, nbrs: DataFrame, names: Sequence[str], digits: int = 8) -> DataFrame:
    """(proc, indices...): the named calculations of each centre."""
    used = nbrs.groupBy("proc").agg(F.count_if(F.col("set") == 1).alias("e1"), F.count_if(F.col("set") == 2).alias("e2"))
    total = occ.agg(F.count_distinct("label").alias("total"))
    # One row a centre, and one row: Catalyst broadcasts them while they are small.
    rows = abc(occ, nbrs).join(used, "proc").crossJoin(F.broadcast(total))
    summed = rows.groupBy("proc").agg(*[F.expr(e).alias(a) for a, e in AGGREGATES.items()])
    columns = {i: e for n in names for i, e in CALCULATIONS[n].items()}
    return summed.select("proc", *[F.round(F.expr(e).cast("double"), digits).alias(i) for i, e in columns.items()])
