"""Tables, matrices and trees as lines of text.  A sink makes a column `line`; writing it is df.write.text()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def delimited(rows: DataFrame, separator: str = ",", quote: str = '"') -> DataFrame:
    """A line for each row; values that hold the separator or a quote are quoted."""
    q = F.lit(quote)

    def cell(c: str) -> Column:
        v = _text(c)
        wrapped = F.concat(q, F.replace(v, q, F.lit(quote * 2)), q)
        return F.when(F.contains(v, F.lit(separator)) | F.contains(v, q), wrapped).otherwise(v)

    return rows.select(F.concat_ws(separator, *map(cell, rows.columns)).alias("line"))


def html(rows: DataFrame) -> DataFrame:
    """A table row for each row, its cells escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(_text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in rows.columns], F.lit("</tr>")).alias("line"))


def json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def yaml(rows: DataFrame) -> DataFrame:
    """A list item for each row."""
    return rows.select(F.concat(F.lit("- {"), F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), _text(c)) for c in rows.columns]), F.lit("}")).alias("line"))


def symmetric(rows: DataFrame, element: str, key: str, value: str, keys: Sequence[str]) -> DataFrame:
    """A row for each element with a column for each key: lists that all have the same keys."""
    return rows.groupBy(element).agg(*[F.max(F.when(F.col(key) == k, F.col(value))).alias(k) for k in keys])


def asymmetric(rows: DataFrame, element: str, key: str, value: str) -> DataFrame:
    """A row for each element with its keys and values side by side."""
    pairs = F.sort_array(F.collect_list(F.struct(key, value)))
    return rows.groupBy(element).agg(F.concat_ws(",", F.flatten(F.transform(pairs, lambda p: F.array(p[key].cast("string"), p[value].cast("string"))))).alias("line"))


def keys_are_symmetric(rows: DataFrame, element: str, key: str) -> DataFrame:
    """(symmetric): whether all elements have the same keys."""
    per = rows.groupBy(element).agg(F.count_distinct(key).alias("k"))
    return per.agg(F.min("k").alias("least")).crossJoin(rows.agg(F.count_distinct(key).alias("every"))).select((F.col("least") == F.col("every")).alias("symmetric"))


def ascii_grid(cells: DataFrame, value: str, missing: str = "-9999") -> DataFrame:
    """(y, line) of cells(x, y, value), from the top row down; cells without a value are `missing`."""
    span = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    rows = cells.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("x", F.col(value).cast("string")))).alias("m"))
    at = F.transform(F.sequence("x0", "x1"), lambda x: F.coalesce(F.element_at("m", x), F.lit(missing)))
    return rows.crossJoin(F.broadcast(span)).select("y", F.array_join(at, " ").alias("line")).orderBy(F.col("y").desc())


def newick(nodes: DataFrame, depth: int) -> DataFrame:
    """(text): nodes(node, parent, length) as one Newick string; children are folded into their parents depth by depth, in the order of their names."""
    up = nodes.select(F.col("node").alias("u"), F.col("parent").alias("p"))
    deep = nodes.select("node", "parent", "length", F.lit(0).alias("d"), F.col("parent").alias("at"))
    for _ in range(depth):
        deep = deep.join(up, deep["at"] == up["u"], "left").select("node", "parent", "length", (F.col("d") + F.col("at").isNotNull().cast("int")).alias("d"), F.col("p").alias("at"))
    name = F.concat(F.lit("'"), F.replace("node", F.lit("'"), F.lit("''")), F.lit("':"), F.col("length").cast("string"))
    level = deep.where(F.col("d") == depth).select("node", "parent", name.alias("text"))
    for d in range(depth - 1, -1, -1):
        inner = level.groupBy(F.col("parent").alias("node")).agg(F.concat(F.lit("("), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), ","), F.lit(")")).alias("below"))
        here = deep.where(F.col("d") == d)
        level = here.join(inner, "node", "left").select("node", "parent", F.concat(F.coalesce("below", F.lit("")), name).alias("text"))
    return level.select(F.concat("text", F.lit(";")).alias("text"))


def nexus(newick_text: DataFrame, name: str = "tree") -> DataFrame:
    """(text): a Nexus file with one tree."""
    return newick_text.select(F.concat(F.lit(f"#NEXUS\nbegin trees;\ntree {name} = "), "text", F.lit("\nend;\n")).alias("text"))


def tabular_tree(nodes: DataFrame) -> DataFrame:
    """NODE_NUMBER, PARENTNODE (0 for none), LENGTHTOPARENT and NAME of each node; numbers follow the names, over a tree's nodes."""
    from pyspark.sql import Window

    numbered = nodes.withColumn("NODE_NUMBER", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")))
    parents = numbered.select(F.col("node").alias("parent"), F.col("NODE_NUMBER").alias("PARENTNODE"))
    return numbered.join(parents, "parent", "left").select("NODE_NUMBER", F.coalesce("PARENTNODE", F.lit(0)).alias("PARENTNODE"), F.col("length").alias("LENGTHTOPARENT"), F.col("node").alias("NAME"))
