"""Line dedup by winnowing.

A text is a sequence of line hashes.  Of each window of two lines the one with
the smaller hash is selected, and every line of many words is; any run of two
or more lines that two texts share then holds a selected line in both.  A
selected line is joined with the first place that has it beside the same
neighbour; from there the match is extended both ways, and the later run goes.
Runs are of two lines at least, so windows are of two: with wider ones, short
runs would have no guaranteed fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import SPACE, let, table

#: A line of so many words is a run of its own.
LONG_WORDS = 30


def _lines(text: Column, long_words: int) -> Column:
    """i, h and long of each line with words: its number, hash without the white space around it, and whether it has long_words words."""
    many = lambda b: (F.octet_length(b) >= 2 * long_words - 1) & (F.size(F.split(b, SPACE)) >= long_words)
    line = lambda s, i: let(F.btrim(s, F.lit(" \t\n\x0b\x0c\r")), lambda b: F.when(b != "", F.struct(i.alias("i"), F.xxhash64(b).alias("h"), many(b).alias("long"))))
    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: x.isNotNull())


def repeated_lines(rows: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(rid, gone): numbers of the lines that go from each text of rows(rid, ord, text).

    ord orders texts; of a repeated run the first in (ord, line) stays.  Lines
    without words are skipped over: they neither make nor break a run.
    """
    seqs = rows.select("rid", "ord", _lines(F.col("text"), long_words).alias("l"))
    seqs = table(seqs.where("size(l) > 0").select("rid", "ord", F.col("l.i").alias("i"), F.col("l.h").alias("h"), F.col("l.long").alias("long")))
    # Fingerprints: of neighbours the one with the smaller hash, keyed with the other; long lines by themselves.
    n = F.size("h")
    h, at = (lambda k: F.get("h", k.cast("int"))), F.sequence(F.lit(0), n - 1)
    pairs = F.transform(
        F.filter(at, lambda k: k < n - 1),
        lambda k: F.struct(
            F.xxhash64(F.least(h(k), h(k + 1)), F.greatest(h(k), h(k + 1)), h(k) <= h(k + 1)).alias("key"),
            F.when(h(k) <= h(k + 1), k).otherwise(k + 1).alias("at"),
            F.lit(2).alias("least"),
        ),
    )
    alone = F.transform(F.filter(at, lambda k: F.get("long", k.cast("int"))), lambda k: F.struct(F.xxhash64(h(k)).alias("key"), k.alias("at"), F.lit(1).alias("least")))
    prints = seqs.select("rid", "ord", F.explode(F.concat(pairs, alone)).alias("p")).select("rid", "ord", "p.*")
    # A key's first place, by partial aggregation, so a line that a third of the texts hold is one row a task.
    first = prints.groupBy("key").agg(F.min(F.struct("ord", "rid", "at")).alias("f"), F.count("*").alias("c")).where("c > 1").select("key", "f")
    found = prints.join(first, "key").where("struct(ord, rid, at) <> f").select("rid", "at", "least", F.col("f.rid").alias("first_rid"), F.col("f.at").alias("first_at"))
    # Extension: both line sequences meet, and equal lines to the left and right of each join are followed to where they end.
    marks = found.groupBy("rid", "first_rid").agg(F.sort_array(F.collect_set(F.struct((F.col("at") - F.col("first_at")).alias("shift"), "at", "least"))).alias("m"))
    a = seqs.select("rid", F.col("h").alias("a"), "i")
    b = seqs.select(F.col("rid").alias("first_rid"), F.col("h").alias("b"))
    pairs = marks.join(a, "rid").join(b, "first_rid")
    ids = pairs.schema["rid"].dataType.simpleString()

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [i[_covered(x, y, m)] for i, x, y, m in zip(batch["i"], batch["a"], batch["b"], batch["m"], strict=True)]
            yield pd.DataFrame({"rid": batch["rid"], "gone": gone})

    out = pairs.select("rid", "i", "a", "b", "m").mapInPandas(extend, f"rid {ids}, gone array<int>")
    return out.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _covered(a: np.ndarray, b: np.ndarray, marks: list[dict]) -> np.ndarray:
    """Whether each line of a lies in a run that it shares with b, of as many lines as its mark asks for at least.

    marks(shift, at, least) are sorted: line `at` of a equals line at - shift of
    b.  A run is followed once, in growing steps, whichever of its marks is met.
    """
    step = np.zeros(len(a) + 1, np.int64)
    done, old = -1, None
    for m in marks:
        shift, at, least = m["shift"], m["at"], m["least"]
        if shift != old:
            done, old, lo = -1, shift, 0
        if at >= done:
            back = _equal_steps(a[at - 1 :: -1] if at else a[:0], b[at - shift - 1 :: -1] if at > shift else b[:0])
            ahead = _equal_steps(a[at:], b[at - shift :])
            lo, done = at - back, at + ahead
        if done - lo >= least:
            step[lo] += 1
            step[done] -= 1
    return np.cumsum(step[:-1]) > 0


def _equal_steps(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements of two arrays agree from their beginning on."""
    n, at, size = min(len(x), len(y)), 0, 16
    while at < n:
        end = min(n, at + size)
        differ = x[at:end] != y[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, size = end, size * 4
    return n


def dedup_lines(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """Each row of docs as struct ``row`` with the text without later repeated runs of lines, n_lines and n_gone.

    A run is two or more lines in a row, or one line of long_words or more, of
    which an equal one stands earlier: in a text before (by doc_id, nulls last,
    then by the text's hash), or further up in the same text.  Lines are compared without the white
    space around them, and lines without words don't count.  The first run
    stays.  A null text stays null; rows that repeat doc_id and text are one
    document; an empty table gives no rows; columns keep their names in ``row``;
    texts of any number of lines, and lines of any length, are handled whole.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("t"), "text")
    rid = F.struct("d", "t")
    seqs = rows.where("text is not null").select(rid.alias("rid"), F.struct("d", "t").alias("ord"), "text")
    gone = repeated_lines(seqs, long_words).select("rid.d", "rid.t", "gone")
    rows = rows.join(gone, ["d", "t"], "left")
    lines = F.split("text", "\n")
    # array_except looks numbers up in a set, so the work grows with the lines.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = let(lines, lambda s: F.array_join(F.transform(left, lambda i: F.get(s, i)), "\n"))
    return rows.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_gone"))
