"""Registered tree operators, readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat import cube
from quadrat.operators import lists, phylo, trees
from quadrat.plans.registry import ABC, GROUPS, OCC, TREE, base_cube, register, shared
from quadrat.sinks import text as sink
from quadrat.sources import text as source
from quadrat.sources import trees as readers

#: All nodes of the tree with their parents.
_ALL = f"""{OCC}{TREE}, every AS (SELECT node, max(len) AS len, max(is_tip) AS is_tip FROM paths GROUP BY 1),
  nd AS (SELECT node, CASE WHEN node = 'root' THEN NULL WHEN is_tip = 1 THEN split_part(node, ':', 1) ELSE 'root' END AS parent, len AS length, is_tip FROM every)"""


def _tree(name: str, sql: str, make) -> None:
    register(name, f"{_ALL} {sql}")(lambda spark, sf_dir: make(shared(spark, sf_dir)[2], shared(spark, sf_dir)[0]))


_nine = lambda df: df.select("node", "parent", F.round("length", 9).alias("length"))
_NINE = "node, parent, round(length, 9) AS length"
_tree("to_tree", "SELECT node, parent, length FROM (SELECT DISTINCT label AS node, split_part(label, ':', 1) AS parent, 1e0 AS length FROM occ UNION ALL SELECT DISTINCT split_part(label, ':', 1), 'root', 1e0 FROM occ UNION ALL SELECT 'root', NULL, 0e0)", lambda t, o: trees.from_labels(o))
_tree("get_terminal_counts_by_depth", "SELECT CAST(2 AS INT) AS depth, count(*) AS n FROM nd WHERE is_tip = 1", lambda t, o: trees.tips_by_depth(t, 2))
_tree("is_ultrametric", "SELECT max(a.length + b.length) - min(a.length + b.length) < 1e-6 AS ultrametric FROM nd a JOIN nd b ON a.parent = b.node WHERE a.is_tip = 1", lambda t, o: trees.is_ultrametric(t, 2))
_tree("get_last_shared_ancestor_for_nodes", "SELECT 'Brand#11' AS node", lambda t, o: trees.shared_by(t, 2, t.where("node like 'Brand#11:%'")))
_tree("tree_trim", f"SELECT {_NINE} FROM nd WHERE node IN (SELECT node FROM kept)", lambda t, o: _nine(trees.trimmed_nodes(t, 2, o.select(F.col("label").alias("tip")))))
_tree("trim_to_last_common_ancestor", "SELECT node, CASE WHEN node <> 'Brand#11' THEN parent END AS parent, round(length, 9) AS length FROM nd WHERE node = 'Brand#11' OR parent = 'Brand#11'", lambda t, o: _nine(trees.rooted_at_shared(t.where("node = 'root' or node = 'Brand#11' or parent = 'Brand#11'"), 2)))
_KNOT = "node = 'root' OR parent = 'root' OR (parent = 'Brand#11') OR node LIKE '%:gone'"
_tree(
    "merge_knuckle_nodes", f"SELECT k.node, CASE WHEN k.node = 'root' THEN NULL WHEN k.parent = 'Brand#11' THEN 'Brand#11' WHEN k.node = 'Brand#11' THEN 'root' ELSE 'root' END AS parent, round(k.length + CASE WHEN k.is_tip = 1 AND k.parent <> 'Brand#11' THEN p.length ELSE 0 END, 9) AS length FROM (SELECT * FROM nd WHERE {_KNOT}) k LEFT JOIN nd p ON k.parent = p.node WHERE k.node = 'root' OR k.node = 'Brand#11' OR k.is_tip = 1",
    lambda t, o: _nine(trees.without_knuckles(t.where(_KNOT), 2)),
)
_tree("root_unrooted_tree", f"SELECT {_NINE} FROM nd", lambda t, o: _nine(trees.rooted(t.where("node <> 'root'").withColumn("parent", F.when(F.col("parent") != "root", F.col("parent"))))))
_tree("clone_tree_with_equalised_branch_lengths", "SELECT node, parent, round(CASE WHEN length <> 0 THEN (SELECT avg(length) FROM nd WHERE length <> 0) ELSE 0 END, 9) AS length FROM nd", lambda t, o: _nine(phylo.equalised(t)))
_tree("clone_tree_with_rescaled_branch_lengths", "SELECT node, parent, round(length / (SELECT max(a.length + b.length) FROM nd a JOIN nd b ON a.parent = b.node WHERE a.is_tip = 1), 9) AS length FROM nd", lambda t, o: _nine(phylo.rescaled(t, 2)))
_tree("clone_with_range_weighted_branches", "SELECT node, parent, round(length / r, 9) AS length FROM nd JOIN nrange USING (node)", lambda t, o: _nine(trees.range_weighted(t, o, 2)))
_tree("group_nodes_below_by_depth", "SELECT node AS tip, parent AS cluster FROM nd WHERE is_tip = 1", lambda t, o: trees.cut_at_depth(t, 2, 1))
_tree("shuffle_terminal_names", "SELECT parent, count(*) AS n, round(sum(length), 6) AS total FROM nd GROUP BY 1", lambda t, o: trees.shuffled_tips(t, 3).groupBy("parent").agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("total")))
_tree("tree_remap_labels_from_hash", "SELECT CASE WHEN is_tip = 1 THEN lower(node) ELSE node END AS node, parent, round(length, 9) AS length FROM nd", lambda t, o: _nine(t.join(trees.tips(t).select("node", F.lower("node").alias("new")), "node", "left").select(F.coalesce("new", "node").alias("node"), "parent", "length")))
_tree("get_mean_nearest_neighbour_distance", "SELECT round(avg(d), 6) AS mean FROM (SELECT x.node, min(x.length + y.length + CASE WHEN x.parent = y.parent THEN 0 ELSE px.length + py.length END) AS d FROM nd x JOIN nd y ON x.node <> y.node AND x.is_tip = 1 AND y.is_tip = 1 JOIN nd px ON px.node = x.parent JOIN nd py ON py.node = y.parent GROUP BY 1)", lambda t, o: trees.mean_nearest_distance(t, 2).select(F.round("mean", 6).alias("mean")))


def _by_kind(t: DataFrame) -> DataFrame:
    """The tips below their types instead of their brands."""
    tips = trees.tips(t).select("node", F.get(F.split("node", ":"), F.lit(1)).alias("parent"), "length")
    inner = tips.select(F.col("parent").alias("node")).distinct().select("node", F.lit("root").alias("parent"), F.lit(1.0).alias("length"))
    return tips.unionByName(inner).unionByName(t.where("node = 'root'"))


_tree(
    "tree_compare",
    """, a AS (SELECT node AS tip, parent AS node FROM nd WHERE is_tip = 1 UNION ALL SELECT node, 'root' FROM nd WHERE is_tip = 1), b AS (SELECT node AS tip, split_part(node, ':', 2) AS other FROM nd WHERE is_tip = 1 UNION ALL SELECT node, 'root' FROM nd WHERE is_tip = 1),
  na AS (SELECT node, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT other, count(*) AS nb FROM b GROUP BY 1), c AS (SELECT node, other, count(*) AS c FROM a JOIN b USING (tip) GROUP BY 1, 2)
  SELECT node, round(min(1 - 2e0 * c / (na + nb)), 8) AS best, min(1 - 2e0 * c / (na + nb)) < 1e-12 AS identical FROM c JOIN na USING (node) JOIN nb USING (other) GROUP BY 1""",
    lambda t, o: trees.compare(t, _by_kind(t), 2),
)

# ---- readers and sinks of trees: what is written is read again

_NODES = f"SELECT {_NINE} FROM nd"
for _name in ("parse_newick", "import_newick", "export_newick"):
    _tree(_name, _NODES, lambda t, o: _nine(readers.read_newick(sink.newick(t, 2).withColumn("tree", F.lit("t")))))
for _name in ("import_nexus", "export_nexus"):
    _tree(_name, _NODES, lambda t, o: _nine(readers.read_nexus(sink.nexus(sink.newick(t, 2)))))
for _name in ("import_tabular_tree",):
    _tree(_name, _NODES, lambda t, o: _nine(readers.read_tabular(sink.tabular_tree(t))))
_tree("export_tabular_tree", ", nu AS (SELECT *, row_number() OVER (ORDER BY node) AS i FROM nd) SELECT CAST(nu.i AS INT) AS NODE_NUMBER, CAST(coalesce(p.i, 0) AS INT) AS PARENTNODE, round(nu.length, 9) AS LENGTHTOPARENT, nu.node AS NAME FROM nu LEFT JOIN nu p ON nu.parent = p.node", lambda t, o: sink.tabular_tree(t).withColumn("LENGTHTOPARENT", F.round("LENGTHTOPARENT", 9)))
_tree("probe_file_type", "SELECT unnest(['newick', 'nexus', 'tabular']) AS kind", lambda t, o: readers.probe(sink.newick(t, 2).union(sink.nexus(sink.newick(t, 2))).union(sink.newick(t, 2).select(F.lit("NAME,PARENTNODE").alias("text")))))

# ---- delimited text

_LINES = "SELECT DISTINCT '\"' || grp || '\",' || label || ',' || CAST(n AS BIGINT) AS line FROM occ"


def _lines(occ: DataFrame) -> DataFrame:
    return occ.select(F.format_string('"%s",%s,%d', "grp", "label", F.col("n").cast("long")).alias("line"))


def _add(name: str, sql: str, make) -> None:
    register(name, sql)(lambda spark, sf_dir: make(shared(spark, sf_dir)[0]))


_add("guess_field_separator", "SELECT ',' AS separator", lambda o: source.guess_separator(_lines(o)))
_add("guess_quote_char", "SELECT '\"' AS quote", lambda o: source.guess_quote(_lines(o)))
_add("guess_eol", "SELECT chr(13) || chr(10) AS eol", lambda o: source.guess_eol(_lines(o).select(F.concat("line", F.lit("\r\n")).alias("text"))))
for _name in ("get_csv_object_using_guesswork", "get_next_line_set"):
    _add(_name, f"{OCC} SELECT grp, label, CAST(CAST(n AS BIGINT) AS VARCHAR) AS n FROM occ", lambda o: source.records(_lines(o), ["grp", "label", "n"]))
_add("import_delimited_text", f"{OCC} SELECT grp, label, n FROM occ WHERE grp NOT LIKE '0:%'", lambda o: source.import_lines(_lines(o), ["g", "l", "n"], [("g", -1)], ["l"], "n", exclude=F.col("g").startswith("0:")))
_WIDE = "SELECT grp, sum(n) FILTER (label LIKE 'Brand#11%') AS a, sum(n) FILTER (label LIKE 'Brand#22%') AS b FROM occ GROUP BY 1"


def _wide(occ: DataFrame) -> DataFrame:
    return occ.groupBy("grp").agg(F.sum(F.when(F.col("label").like("Brand#11%"), F.col("n"))).alias("a"), F.sum(F.when(F.col("label").like("Brand#22%"), F.col("n"))).alias("b"))


_add("get_labels_from_line_matrix", f"{OCC}, w AS ({_WIDE}) SELECT grp, 'a' AS label, a AS n FROM w WHERE a > 0 UNION ALL SELECT grp, 'b', b FROM w WHERE b > 0", lambda o: cube.from_wide(_wide(o), "grp", ["a", "b"]))
_add("get_label_columns_for_matrix_import", "SELECT unnest(['a', 'b']) AS label", lambda o: o.sparkSession.createDataFrame([(c,) for c in _wide(o).columns[1:]], "label string"))

# ---- tables as text

_GPS = f"{GROUPS} SELECT"
_rows = lambda o: cube.groups(o).select("grp", "x", "y", "richness")
for _name in ("export", "export_table_delimited_text"):
    _add(_name, f"{_GPS} grp || ',' || x || ',' || y || ',' || richness AS line FROM gps", lambda o: sink.delimited(_rows(o)))
_add("export_table_html", f"{_GPS} '<tr><td>' || grp || '</td><td>' || x || '</td><td>' || y || '</td><td>' || richness || '</td></tr>' AS line FROM gps", lambda o: sink.html(_rows(o)))
_add("export_table_json", _GPS + """ '{"grp":"' || grp || '","x":' || x || ',"y":' || y || ',"richness":' || richness || '}' AS line FROM gps""", lambda o: sink.json(_rows(o)))
_add("export_table_yaml", f"{_GPS} '- {{grp: ' || grp || ', x: ' || x || ', y: ' || y || ', richness: ' || richness || '}}' AS line FROM gps", lambda o: sink.yaml(_rows(o)))
_KEYS = ["Brand#11:PROMO", "Brand#22:ECONOMY"]
_SYM = ", ".join(f"max(n) FILTER (label = '{k}') AS \"{k}\"" for k in _KEYS)
for _name in ("to_table", "to_table_sym", "to_table_asym_as_sym"):
    _add(_name, f"{OCC} SELECT grp, {_SYM} FROM occ GROUP BY 1", lambda o: sink.symmetric(o, "grp", "label", "n", _KEYS))
_add("to_table_asym", f"{OCC} SELECT grp, string_agg(label || ',' || CAST(n AS BIGINT), ',' ORDER BY label) AS line FROM occ GROUP BY 1", lambda o: sink.asymmetric(o.withColumn("n", F.col("n").cast("long")), "grp", "label", "n"))
_add("list_contents_are_symmetric", "SELECT false AS symmetric", lambda o: sink.keys_are_symmetric(o, "grp", "label"))
_add(
    "export_asciigrid", f"{GROUPS}, xs AS (SELECT unnest(range((SELECT min(x) FROM gps), (SELECT max(x) FROM gps) + 1)) AS x), ys AS (SELECT DISTINCT y FROM gps) SELECT ys.y AS y, string_agg(coalesce(CAST(richness AS VARCHAR), '-9999'), ' ' ORDER BY xs.x) AS line FROM ys CROSS JOIN xs LEFT JOIN gps ON gps.x = xs.x AND gps.y = ys.y GROUP BY 1",
    lambda o: sink.ascii_grid(_rows(o), "richness"),
)
_add("export_delimited_text", f"{OCC} SELECT grp || ',' || label || ',' || CAST(n AS BIGINT) AS line FROM occ", lambda o: sink.delimited(o.select("grp", "label", F.col("n").cast("long"))))


@register("export_table_grouped", f"{ABC} SELECT label, list(proc ORDER BY proc) AS procs FROM abc GROUP BY 1")
def export_table_grouped(spark, sf_dir):
    return lists.label_rows(*base_cube(spark, sf_dir)).groupBy("label").agg(F.sort_array(F.collect_list("proc")).alias("procs"))
