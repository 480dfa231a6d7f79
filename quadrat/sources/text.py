"""Delimited text: guessing its form, and reading records into a cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat import cube

SEPARATORS = (",", "\t", ";", "|", " ", ":")
QUOTES = ('"', "'")


def _count(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def guess_separator(lines: DataFrame) -> DataFrame:
    """(separator): of SEPARATORS the one that every line(line) holds equally often, and most often; else the one found most often."""
    counts = [F.struct((F.min(_count(F.col("line"), s)) == F.max(_count(F.col("line"), s))).alias("even"), F.min(_count(F.col("line"), s)).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("separator")) for i, s in enumerate(SEPARATORS)]
    best = F.array_max(F.filter(F.array(*counts), lambda c: c["n"] > 0))
    return lines.agg(best["separator"].alias("separator"))


def guess_quote(lines: DataFrame) -> DataFrame:
    """(quote): the quote character found most often, a double one if there is none."""
    counts = [F.struct(F.sum(_count(F.col("line"), q)).alias("n"), F.lit(-i).alias("i"), F.lit(q).alias("quote")) for i, q in enumerate(QUOTES)]
    return lines.agg(F.array_max(F.array(*counts))["quote"].alias("quote"))


def guess_eol(texts: DataFrame) -> DataFrame:
    """(eol): how lines end in text(text): '\\r\\n', '\\n' or '\\r', whichever is found most often."""
    both = F.sum(F.expr(r"length(text) - length(replace(text, '\r\n', '\n'))"))
    lf, cr = F.sum(F.expr(r"length(text) - length(replace(text, '\n', ''))")), F.sum(F.expr(r"length(text) - length(replace(text, '\r', ''))"))
    return texts.agg(F.when(both * 2 >= lf, F.lit("\r\n")).when(lf >= cr, F.lit("\n")).otherwise(F.lit("\r")).alias("eol"))


def records(lines: DataFrame, names: Sequence[str], separator: str = ",", quote: str = '"') -> DataFrame:
    """Columns of quoted delimited lines, as strings; what can't be parsed is null."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return lines.select(F.from_csv("line", schema, {"sep": separator, "quote": quote, "escape": quote}).alias("r")).select("r.*")


def import_lines(lines: DataFrame, names: Sequence[str], groups: Sequence[tuple[str, float]], labels: Sequence[str], count: str | None = None, separator: str = ",", quote: str = '"', remap: DataFrame | None = None, exclude: Column | None = None) -> DataFrame:
    """Cube of delimited lines by column roles: groups are (column, cell size; below 0 for text), labels and counts are columns.

    remap(old, new) renames labels; rows that `exclude` holds for are left out.
    """
    rows = records(lines, names, separator, quote)
    if exclude is not None:
        rows = rows.where(~exclude)
    axes = [F.col(c) if size < 0 else F.col(c).cast("double") if size == 0 else cube.bin_index(F.col(c).cast("double"), size) for c, size in groups]
    occ = cube.from_records(rows, axes, [F.col(c) for c in labels], F.col(count) if count else None)
    return cube.rename(occ, "label", remap) if remap is not None else occ
