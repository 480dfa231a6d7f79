"""Quality rules as weak supervision.

Each rule votes that a text is good or bad, or abstains.  Rules are taken to err
independently given a text's true quality; expectation-maximisation over all
texts estimates each rule's accuracy and the share of good texts, and the
posterior probability of being good replaces "all rules must pass".

Votes are counted by pattern first.  With R rules there are 3^R patterns at
most, whatever the number of texts, and they are sufficient for the estimate,
so only that bounded table reaches the driver and only its posteriors are
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import release_memory

_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"

#: (name, measure, good if the measure is in, bad if it is outside of); between the two the rule abstains.
RULES = (
    ("length", "n_words", (100, 1e9), (50, 1e9)),
    ("word_length", "word_mean", (3.0, 9.0), (2.0, 13.0)),
    ("symbols", "symbol_share", (0.0, 0.02), (0.0, 0.1)),
    ("double_lines", "dup_line_share", (0.0, 0.05), (0.0, 0.3)),
    ("repeats", "repeat_share", (0.0, 0.1), (0.0, 0.4)),
    ("capitals", "upper_share", (0.0, 0.15), (0.0, 0.4)),
    ("digits", "digit_share", (0.0, 0.1), (0.0, 0.25)),
    ("variety", "variety", (0.25, 1.01), (0.1, 1.01)),
)

#: The most good texts that a rule may be taken to blame.
MOST_BLAME = 0.005

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string"


def measures(text: bytes) -> tuple[dict[str, int], dict[str, float]]:
    """Counts of a text, and the measures that rules look at."""
    words = text.split()
    n = len(words)
    dup, lines = 0, 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
            lines += 1
        elif line and not line.isspace():
            seen.add(line)
            lines += 1
    # Words that stand in 3-word windows found twice or more.
    repeat, number = 0, {}
    if n >= 4:
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        d = len(number)
        pair = ids[:-1] * d + ids[1:]
        if d * d * d >= 1 << 62:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        code = pair[:-1] * d + ids[2:]
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= twice
            repeat = int(cover.sum())
    chars = len(text.translate(None, _CONTINUATION + _SPACES))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    upper = len(text) - len(text.translate(None, _UPPER))
    lower = len(text) - len(text.translate(None, _LOWER))
    digits = len(text) - len(text.translate(None, _DIGITS))
    counts = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
    return counts, {
        "n_words": n,
        "word_mean": chars / max(n, 1),
        "symbol_share": symbols / max(n, 1),
        "dup_line_share": dup / max(lines, 1),
        "repeat_share": repeat / max(n, 1),
        "upper_share": upper / max(upper + lower, 1),
        "digit_share": digits / max(chars, 1),
        "variety": 1.0 if n < 500 else len(number) / n,
    }


def vote(x: dict[str, float]) -> str:
    """A character for each rule: + good, - bad, 0 abstains."""
    out = []
    for _, name, good, bad in RULES:
        v = x[name]
        out.append("+" if good[0] <= v <= good[1] else "0" if bad[0] <= v <= bad[1] else "-")
    return "".join(out)


def _features(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        c, m = measures(t)
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        rows.append((*c.values(), failed, vote(m)))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])


def features(text: Column) -> Column:
    """Struct FEATURES of a text column; a null text counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _features(batch)
        release_memory()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, FEATURES)(F.coalesce(text, F.lit("")).cast("binary"))


def fit(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior probability of being good, by pattern of votes.

    A rule's accuracy is estimated for either class apart: how it votes on good
    texts and how on bad ones.  Estimates start where rules seldom blame a good
    text, which ties the hidden class to the rules' meaning; pseudo-counts of
    that start keep them off 0 and 1, so a rule that never votes stays there.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    # Texts by rules by outcome (good, abstain, bad).
    v = np.array([[["+0-".index(c) == k for k in range(3)] for c in key] for key in keys], float)
    n = np.array([patterns[k] for k in keys], float)
    start = {True: np.array([0.93, 0.065, 0.005]), False: np.array([0.7, 0.05, 0.25])}
    seen = {c: np.tile(start[c], (v.shape[1], 1)) for c in start}
    prior = 0.7
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + np.einsum("prk,rk->p", v, np.log(seen[True] / seen[False]))
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for c, share in ((True, good), (False, 1 - good)):
            votes = np.einsum("p,prk->rk", n * share, v) + 10 * start[c]
            seen[c] = votes / votes.sum(1, keepdims=True)
        # A rule blames few good texts; what it blames beyond that is bad.
        blame = np.minimum(seen[True][:, 2], MOST_BLAME)
        seen[True][:, :2] *= ((1 - blame) / seen[True][:, :2].sum(1))[:, None]
        seen[True][:, 2] = blame
        prior = float(np.clip((n @ good + 7) / (n.sum() + 10), 0.05, 0.98))
    return dict(zip(keys, map(float, good), strict=True))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Each row of docs as struct ``row`` with struct ``f`` (FEATURES), quality (posterior) and kept.

    kept needs both: the base rules hold, and the posterior is `least` or more.
    A null or empty text has no words and is not kept; repeated rows are judged
    alike; an empty table gives no rows; columns keep their names in ``row``.
    """
    spark = docs.sparkSession
    counted = docs.select(features(F.col("text"))["votes"].alias("votes")).groupBy("votes").count()
    table = fit({r["votes"]: r["count"] for r in counted.collect()})
    known = spark.createDataFrame([(k, v) for k, v in table.items()], "votes string, quality double")
    rows = docs.select(F.struct("*").alias("row"), features(F.col("text")).alias("f"))
    rows = rows.join(F.broadcast(known), rows["f.votes"] == known["votes"], "left").drop("votes")
    return rows.withColumn("kept", ~F.col("f.base_failed") & (F.coalesce("quality", F.lit(0.0)) >= least))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps."""
    return judge(docs, least).where("kept").select("row.*")
