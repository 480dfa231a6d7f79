"""Tree readers: Newick, Nexus, tabular and parent lists to nodes(node, parent, length)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node string, parent string, length double"
_TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+")


def newick_nodes(text: str, translate: dict[str, str] | None = None) -> list[tuple[str, str | None, float]]:
    """Nodes of one Newick string, read in one pass with a stack; unnamed inner nodes become 0___, 1___, ...; comments in brackets are skipped."""
    names, lengths, parents = [""], [0.0], [-1]
    here, after_colon = 0, False
    for match in _TOKEN.finditer(text):
        t = match.group()
        if t[0] == "[":
            continue
        if t == "(" or t == ",":
            if t == ",":
                here = parents[here]
            names.append("")
            lengths.append(0.0)
            parents.append(here)
            here = len(names) - 1
        elif t == ")":
            here = parents[here]
        elif t == ":":
            after_colon = True
            continue
        elif t == ";":
            break
        elif after_colon:
            lengths[here] = float(t)
        else:
            name = t[1:-1].replace("''", "'") if t[0] == "'" else t
            names[here] = (translate or {}).get(name, name)
        after_colon = False
    count = 0
    for i, n in enumerate(names):
        if not n:
            names[i] = f"{count}___"
            count += 1
    return [(n, names[p] if p >= 0 else None, length) for n, p, length in zip(names, parents, lengths, strict=True)]


def nexus_trees(text: str) -> list[tuple[str, dict[str, str], str]]:
    """(name, translation, Newick) of each tree of a Nexus file."""
    block = re.search(r"begin\s+trees\s*;(.*?)end(?:block)?\s*;", text, re.I | re.S)
    body = block.group(1) if block else ""
    table = re.search(r"translate(.*?);", body, re.I | re.S)
    pairs = [p.split(None, 1) for p in table.group(1).split(",") if p.strip()] if table else []
    names = {a.strip(): b.strip().strip("'") for a, b in pairs}
    return [(m.group(1).strip("'"), names, m.group(2) + ";") for m in re.finditer(r"\btree\s+\*?\s*(\S+)\s*=\s*(.*?);", body, re.I | re.S)]


def read_newick(trees: DataFrame) -> DataFrame:
    """(tree, node, parent, length) of trees(tree, text); each string is parsed in one task, many in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["tree"], batch["text"], strict=True):
                yield pd.DataFrame([(name, *n) for n in newick_nodes(text)], columns=["tree", "node", "parent", "length"])

    return trees.select("tree", "text").mapInPandas(run, f"tree string, {NODES}")


def read_nexus(files: DataFrame) -> DataFrame:
    """(tree, node, parent, length) of the trees in Nexus files(text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                for name, names, newick in nexus_trees(text):
                    yield pd.DataFrame([(name, *n) for n in newick_nodes(newick, names)], columns=["tree", "node", "parent", "length"])

    return files.select("text").mapInPandas(run, f"tree string, {NODES}")


def read_tabular(rows: DataFrame) -> DataFrame:
    """nodes of rows(NODE_NUMBER, PARENTNODE, LENGTHTOPARENT, NAME): parent 0 is none; a node without a name is called by its number."""
    named = rows.select(F.col("NODE_NUMBER").cast("long").alias("i"), F.col("PARENTNODE").cast("long").alias("p"), F.col("LENGTHTOPARENT").cast("double").alias("length"), F.coalesce(F.nullif(F.col("NAME"), F.lit("")), F.concat(F.col("NODE_NUMBER").cast("string"), F.lit("___"))).alias("node"))
    parents = named.select(F.col("i").alias("p"), F.col("node").alias("parent"))
    return named.join(parents, "p", "left").select("node", "parent", F.coalesce("length", F.lit(0.0)).alias("length"))


def probe(text: DataFrame) -> DataFrame:
    """(kind) of text(text): nexus, newick, or tabular."""
    kind = F.when(F.lower("text").rlike(r"^\s*#nexus"), "nexus").when(F.col("text").rlike(r"^\s*\("), "newick").otherwise("tabular")
    return text.select(kind.alias("kind"))
