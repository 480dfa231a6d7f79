"""Licence scans.

One Aho-Corasick pass over a text's normalised words finds notice phrases, and
one over its lower-cased bytes finds identifier tags; the expression after a
tag is put into postfix order by a shunting-yard parser (WITH binds before AND
before OR) and evaluated: how freely may the text be used, if OR lets the user
choose, AND binds to both, and WITH relaxes a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrat.llm.common import texts

#: Phrases that base counts are made of.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases.  Words are runs of letters and digits, so "CC BY-NC 4.0" reads "cc by nc 4 0".
NOTICES = {
    "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by", "bsd license": "bsd", "mozilla public license": "mpl",
    "all rights reserved": "proprietary", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "public domain": "public-domain", "unlicense": "public-domain",
}
TAG = "spdx-license-identifier:"
#: How freely a licence lets a text be used, 0 to 1, by the first part of its identifier that is known.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "public-domain": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5,
    "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "proprietary": 0.0,
}
_UNKNOWN = 0.2
_ORDER = {"with": 3, "and": 2, "or": 1}
_BREAKS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SPACED = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))


def family(name: str) -> str:
    """The label of an identifier: the longest known one that begins it, or itself in lower case."""
    name = name.lower().rstrip("+")
    return max((k for k in FREEDOM if name == k or name.startswith(k + "-")), key=len, default=name)


def postfix(expression: str) -> list[str]:
    """Shunting-yard order of an expression; parts that don't fit are left out, so any text has a result."""
    out: list[str] = []
    held: list[str] = []
    operand, open_ = False, 0
    for found in re.finditer(r"[()]|[A-Za-z0-9.+:-]+", expression):
        t = found.group()
        low = t.lower()
        if low in _ORDER:
            if not operand:
                break
            while held and held[-1] != "(" and _ORDER[held[-1]] >= _ORDER[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif t == "(":
            if operand:
                break
            held.append(t)
            open_ += 1
        elif t == ")":
            if not operand or not open_:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            open_ -= 1
        else:
            if operand:
                break
            out.append(t)
            operand = True
    if held and held[-1] in _ORDER and not operand:
        held.pop()
    while held:
        t = held.pop()
        if t != "(":
            out.append(t)
    return out


def evaluate(expression: str) -> tuple[float, set[str]]:
    """(freedom, labels) of an expression."""
    stack: list[tuple[float, str]] = []
    labels: set[str] = set()
    for t in postfix(expression):
        if t not in _ORDER:
            stack.append((FREEDOM.get(family(t), _UNKNOWN), t))
        elif len(stack) > 1:
            (y, b), (x, a) = stack.pop(), stack.pop()
            if t == "with":
                labels.add(family(a))
                stack.append(((1 + x) / 2, ""))
            else:
                labels.update(family(n) for n in (a, b) if n)
                stack.append((max(x, y) if t == "or" else min(x, y), ""))
    labels.update(family(n) for _, n in stack if n)
    return (stack[-1][0] if stack else 0.0), labels


@lru_cache(maxsize=1)
def _automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        phrases.add_word(f" {phrase} ", (phrase, label, len(phrase)))
    phrases.make_automaton()
    tags.add_word(TAG, TAG)
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    phrases, tags = _automata()
    low = text.lower()
    words = low.translate(_SPACED).split()
    joined = b" " + b" ".join(words) + b" "
    flat = joined.decode("latin-1")
    starts, base, labels = [], set(), set()
    for end, (phrase, label, size) in phrases.iter(flat):
        labels.add(label)
        if phrase in BASE:
            base.add(label)
            starts.append(end - size - 1)
    # The phrase's first word follows as many spaces as there are words before it; one pass counts them for all phrases.
    places = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), starts).tolist() if starts else []
    # "cc by nc" also holds "cc by", which then says less than the text.
    if labels & {"cc-by-nc", "cc-by-sa", "cc-by-nd"}:
        labels.discard("cc-by")
    scores = [FREEDOM[x] for x in labels]
    if b"spdx-license" in low:
        plain = low.decode("latin-1")
        ends = [end + 1 for end, _ in tags.iter(plain)]
        # An expression ends with its line, or where the next tag begins.
        for at, following in zip(ends, [*(e - len(TAG) for e in ends[1:]), len(plain)], strict=False):
            line = plain[at:following].split("\n", 1)[0]
            score, found = evaluate(line)
            if found:
                scores.append(score)
                labels |= found
    labels |= base
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0))


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_documents(docs: DataFrame) -> DataFrame:
    """SCAN of each row of docs.

    n_base counts the places of BASE phrases, first_word and last_word are
    their smallest and largest start (null where there is none), score is the
    freedom under the strictest licence stated, 0 where none is.  A null or
    empty text has no words and empty labels; repeated rows are scanned alike;
    an empty table gives no rows; texts of any length are scanned whole, in time
    that grows with their length; other columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCAN.split(", ")]
        for batch in batches:
            out = pd.DataFrame([(i, *scan(t)) for i, t in zip(batch["doc_id"], batch["text"], strict=True)], columns=names)
            yield out.astype({c: "Int64" for c in names[:5]} | {"score": "float64"})

    return texts(docs).mapInPandas(run, SCAN)
