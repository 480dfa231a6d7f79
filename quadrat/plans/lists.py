"""Registered list results: a row for each key of a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import conditions, lists
from quadrat.plans.registry import ABC, NBRS, base_cube, register, shared


def _add(name: str, sql: str, make: Callable[[DataFrame, DataFrame], DataFrame], names: dict[str, str]) -> None:
    """Registers make(occ, nbrs) with its columns renamed; doubles are rounded in both."""

    def run(spark, sf_dir):
        rows = make(*base_cube(spark, sf_dir))
        rounded = lambda c: F.round(c, 8) if dict(rows.dtypes)[c] == "double" else F.col(c)
        return rows.select(*[rounded(c).alias(names.get(c, c)) for c in rows.columns])

    register(name, sql)(run)


_SETS = {
    "calc_abc": (1, "LABEL_HASH", "CASE WHEN g1 > 0 THEN 1e0 END, CASE WHEN g2 > 0 THEN 1e0 END, 1e0"),
    "calc_abc2": (2, "LABEL_HASH", "CASE WHEN g1 > 0 THEN CAST(g1 AS DOUBLE) END, CASE WHEN g2 > 0 THEN CAST(g2 AS DOUBLE) END, CAST(g1 + g2 AS DOUBLE)"),
    "calc_abc3": (3, "LABEL_HASH", "CASE WHEN g1 > 0 THEN n1 END, CASE WHEN g2 > 0 THEN n2 END, n1 + n2"),
    "calc_local_range_lists": (2, "ABC2_LABELS", "CASE WHEN g1 > 0 THEN CAST(g1 AS DOUBLE) END, CASE WHEN g2 > 0 THEN CAST(g2 AS DOUBLE) END, CAST(g1 + g2 AS DOUBLE)"),
    "calc_local_sample_count_lists": (3, "ABC3_LABELS", "CASE WHEN g1 > 0 THEN n1 END, CASE WHEN g2 > 0 THEN n2 END, n1 + n2"),
}
for _name, (_kind, _prefix, _columns) in _SETS.items():
    _one, _two, _all = _columns.split(", ")
    _add(
        _name, f"{ABC} SELECT proc, label, round({_one}, 8) AS {_prefix}_SET1, round({_two}, 8) AS {_prefix}_SET2, round({_all}, 8) AS {_prefix}_ALL FROM abc",
        lambda occ, nbrs, kind=_kind: lists.label_sets(occ, nbrs, kind), {"set1": f"{_prefix}_SET1", "set2": f"{_prefix}_SET2", "both": f"{_prefix}_ALL"},
    )

for _name, _of, _central, _prefix, _weight, _total in (
    ("calc_endemism_central_lists", "range", True, "ENDC", "(g1 + g2) / CAST(r AS DOUBLE)", "r"),
    ("calc_endemism_whole_lists", "range", False, "ENDW", "(g1 + g2) / CAST(r AS DOUBLE)", "r"),
    ("calc_rarity_central_lists", "abundance", True, "RAREC", "(n1 + n2) / a", "a"),
    ("calc_rarity_whole_lists", "abundance", False, "RAREW", "(n1 + n2) / a", "a"),
):
    _add(
        _name, f"{ABC} SELECT proc, label, round({_weight}, 8) AS {_prefix}_WTLIST, CAST({_total} AS DOUBLE) AS {_prefix}_RANGELIST FROM abc{' WHERE g1 > 0' if _central else ''}",
        lambda occ, nbrs, of=_of, central=_central: lists.weights(occ, nbrs, of, central), {"weight": f"{_prefix}_WTLIST", "total": f"{_prefix}_RANGELIST"},
    )

_add(
    "calc_endemism_absolute_lists",
    f"{ABC} SELECT proc, label, CASE WHEN g1 = r THEN g1 END AS END_ABS1_LIST, CASE WHEN g2 = r THEN g2 END AS END_ABS2_LIST, g1 + g2 AS END_ABS_ALL_LIST FROM abc WHERE g1 + g2 = r",
    lists.absolute_endemics, {"set1": "END_ABS1_LIST", "set2": "END_ABS2_LIST", "both": "END_ABS_ALL_LIST"},
)

_RANK = "list_extract(list_sort(list({0}) FILTER ({1})), CAST(floor(0.5 + (count(*) FILTER ({1}) - 1) * q / 100) AS BIGINT) + 1)"
_add(
    "calc_local_sample_count_quantiles",
    f"{ABC} SELECT proc, CAST(q AS INT) AS q, {_RANK.format('n1 + n2', 'true')} AS ABC3_QUANTILES_ALL, {_RANK.format('n1', 'g1 > 0')} AS ABC3_QUANTILES_SET1, {_RANK.format('n2', 'g2 > 0')} AS ABC3_QUANTILES_SET2 FROM abc, range(0, 101, 5) t(q) GROUP BY proc, q",
    lists.count_quantiles, {"both": "ABC3_QUANTILES_ALL", "set1": "ABC3_QUANTILES_SET1", "set2": "ABC3_QUANTILES_SET2"},
)
_add(
    "calc_label_count_quantile_position",
    f"""{NBRS}, others AS (SELECT proc, grp FROM nbrs WHERE proc <> grp), wanted AS (SELECT DISTINCT proc, label FROM nbrs JOIN occ USING (grp)),
  each AS (SELECT wanted.proc, wanted.label, coalesce(o.n, 0) AS there, coalesce(c.n, 0) AS own, others.grp FROM wanted LEFT JOIN others USING (proc)
    LEFT JOIN occ o ON o.grp = others.grp AND o.label = wanted.label LEFT JOIN occ c ON c.grp = wanted.proc AND c.label = wanted.label)
  SELECT proc, label, round(100e0 * count(*) FILTER (there < own AND grp IS NOT NULL) / nullif(count(grp), 0), 8) AS LABEL_COUNT_RANK_PCT FROM each GROUP BY 1, 2""",
    lists.rank_among_neighbours, {"pct": "LABEL_COUNT_RANK_PCT"},
)
_LISTED = "list_sort(coalesce(list(grp) FILTER (s = 1), [])) AS {0}_SET1, list_sort(coalesce(list(grp) FILTER (s = 2), [])) AS {0}_SET2, list_sort(list(grp)) AS {0}_ALL"
_add("calc_element_lists_used_as_arrays", f"{NBRS} SELECT proc, {_LISTED.format('EL_ARRAY')} FROM nbrs GROUP BY 1", lambda occ, nbrs: lists.elements(nbrs), {"set1": "EL_ARRAY_SET1", "set2": "EL_ARRAY_SET2", "both": "EL_ARRAY_ALL"})
_add(
    "calc_element_lists_used", f"{NBRS} SELECT proc, grp, CASE WHEN s = 1 THEN 1 END AS EL_LIST_SET1, CASE WHEN s = 2 THEN 1 END AS EL_LIST_SET2, 1 AS EL_LIST_ALL FROM nbrs",
    lambda occ, nbrs: nbrs.select("proc", "grp", *[F.when(F.col("set") == s, 1).alias(f"EL_LIST_SET{s}") for s in (1, 2)], F.lit(1).alias("EL_LIST_ALL")), {},
)
_add("calc_tx_rao_qe_labels", f"{ABC} SELECT proc, label, round((n1 + n2) / sum(n1 + n2) OVER (PARTITION BY proc), 8) AS TX_RAO_TLABELS FROM abc", lists.proportions, {"p": "TX_RAO_TLABELS"})
for _name, _central, _prefix in (("calc_endemism_central_hier_part", True, "ENDC_HPART"), ("calc_endemism_whole_hier_part", False, "ENDW_HPART")):
    _add(
        _name,
        f"""{ABC}, w AS (SELECT proc, label, (g1 + g2) / CAST(r AS DOUBLE) AS w FROM abc{' WHERE g1 > 0' if _central else ''}),
  both_ AS (SELECT proc, 0 AS level, split_part(label, ':', 1) AS part, w FROM w UNION ALL SELECT proc, 1, label, w FROM w),
  t AS (SELECT proc, sum(w) AS we, CAST(count(*) AS DOUBLE) AS k FROM w GROUP BY 1)
  SELECT proc, level, part, round(sum(w) / max(we), 8) AS {_prefix}, count(*) AS {_prefix}_C, round(count(*) / max(k), 8) AS {_prefix}_E, round(sum(w) / max(we) - count(*) / max(k), 8) AS {_prefix}_OME FROM both_ JOIN t USING (proc) GROUP BY 1, 2, 3""",
        lambda occ, nbrs, central=_central: lists.hierarchy_parts(occ, nbrs, central), {"share": _prefix, "count": f"{_prefix}_C", "expected": f"{_prefix}_E", "surplus": f"{_prefix}_OME"},
    )
_add(
    "calc_hierarchical_label_ratios",
    f"""{ABC}, h AS (SELECT proc, count(*) FILTER (g1 > 0 AND g2 > 0) AS a, count(*) FILTER (g2 = 0) AS b, count(*) FILTER (g1 = 0) AS c, coalesce(sum(n1 + n2) FILTER (g1 > 0 AND g2 > 0), 0) AS asum FROM abc GROUP BY 1)
  SELECT proc, CAST(level AS INT) AS level, a AS HIER_A, b AS HIER_B, c AS HIER_C, asum AS HIER_ASUM, CASE WHEN level > 0 AND a > 0 THEN 1e0 END AS HIER_ARAT, CASE WHEN level > 0 AND b > 0 THEN 1e0 END AS HIER_BRAT,
    CASE WHEN level > 0 AND c > 0 THEN 1e0 END AS HIER_CRAT, CASE WHEN level > 0 THEN CASE WHEN asum > 0 THEN 0e0 ELSE 1e0 END END AS HIER_ASUMRAT FROM h, range(0, 2) t(level)""",
    lambda occ, nbrs: lists.label_ratios(occ, nbrs, 2),
    {"a": "HIER_A", "b": "HIER_B", "c": "HIER_C", "asum": "HIER_ASUM", "arat": "HIER_ARAT", "brat": "HIER_BRAT", "crat": "HIER_CRAT", "asumrat": "HIER_ASUMRAT"},
)


@register(
    "calc_nonempty_elements_used",
    f"""{NBRS}, cells AS (SELECT grp, x, y, true AS filled FROM gps UNION ALL SELECT DISTINCT x || ':' || 99, x, 99, false FROM gps),
  near AS (SELECT c.grp AS proc, b.filled, CASE WHEN c.grp = b.grp THEN 1 ELSE 2 END AS s FROM cells c JOIN cells b ON abs(c.x - b.x) + abs(c.y - b.y) <= 1)
  SELECT proc, count(*) FILTER (s = 1 AND filled) AS EL_COUNT_NONEMPTY_SET1, count(*) FILTER (s = 2 AND filled) AS EL_COUNT_NONEMPTY_SET2, count(*) FILTER (filled) AS EL_COUNT_NONEMPTY_ALL FROM near GROUP BY 1""",
)
def calc_nonempty_elements_used(spark, sf_dir):
    """Over the cube and an empty group of each column, in row 99."""
    occ = shared(spark, sf_dir)[0]
    groups = cube.groups(occ)
    empty = groups.select("x").distinct().select(F.concat_ws(":", "x", F.lit("99")).alias("grp"), "x", F.lit(99).cast("long").alias("y"), F.lit(0).cast("long").alias("richness"), F.lit(0.0).alias("samples"), F.lit(None).cast("double").alias("redundancy"))
    nbrs = conditions.two_sets(groups.unionByName(empty), conditions.self_only(), conditions.circle(1))
    return lists.used_elements(nbrs, occ).select("proc", *[F.col(c).alias(f"EL_COUNT_NONEMPTY_{a}") for c, a in (("set1", "SET1"), ("set2", "SET2"), ("both", "ALL"))])
