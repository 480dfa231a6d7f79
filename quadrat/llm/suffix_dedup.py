"""Suffix-array dedup: removal of repeated byte strings.

Which strings of `least` bytes repeat is found by threshold-bounded interval
expansion on a Burrows-Wheeler transform: starting from the whole suffix array,
intervals of suffixes with a common prefix are extended backward by one
character, breadth first, so common-prefix lengths between neighbours in the
array are derived by increasing value; at length `least` the expansion stops,
and neighbours without a value yet have `least` characters or more in common.

A corpus is too large for one array, so texts are first cut into segments that
can repeat.  Of the k-byte strings in a window of `least` bytes the one with
the smallest hash is the window's anchor; equal windows have equal anchors at
equal places.  Anchors that occur once are dropped.  Windows of one anchor make
a segment; of equal segments all but the first are repeated as a whole, and an
anchor's different segments go into one array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import table

#: Length of a repeated string, and of an anchor.
LEAST = 100
ANCHOR = 32
#: Segments of an array, and of an anchor; windows of anchors beyond are compared one by one.
BUCKET_SEGMENTS = 4000
ANCHOR_SEGMENTS = 2000
#: Anchors that a task holds together.
TOGETHER = 100_000
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_TOP = np.uint64(((1 << 64) - 1) ^ ((1 << 20) - 1))
_LOW = np.uint64((1 << 20) - 1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_P, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _scramble(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, least: int = LEAST, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(hash, segment hash, place, first, last): anchors of the windows that start at first..last, and the bytes of these windows hashed."""
    n = len(text)
    parts = []
    b = np.frombuffer(text, np.uint8)
    p, q = _powers(CHUNK + 4 * LEAST)
    for at in range(0, max(0, n - least + 1), CHUNK):
        part = b[at : at + CHUNK + least - 1]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=sums[1:], dtype=np.uint64)
            h = _scramble((sums[k:] - sums[:-k]) * q[: len(part) - k + 1])
        # Position in the low bits: the leftmost of equal ones is taken.
        low = (h & _TOP) | np.arange(len(h), dtype=np.uint64)
        w = least - k + 1
        size = 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if w > size:
            low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
        place = (low & _LOW).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[starts[1:], len(place)] - 1
        anchor = place[starts]
        with np.errstate(over="ignore"):
            whole = (sums[ends + least] - sums[starts]) * q[starts] + (anchor - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (ends - starts).astype(np.uint64)
            parts.append((h[anchor], _scramble(whole), anchor + at, starts + at, ends + at))
    if not parts:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling, exact to `depth` symbols at least; beyond, by position."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, size = np.argsort(rank, kind="stable"), 1
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        rank[order] = new
        size *= 2
        if new[-1] == n - 1:
            break
    return order


def common_from(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each entry of a suffix array, whether it has `least` symbols or more in common with the one before."""
    n = len(order)
    bwt = symbols[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    # Boundaries 0..n; an unset inner one separates suffixes with much in common.
    value = np.full(n + 1, -1, np.int64)
    value[0] = value[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for length in range(least):
        size = hi - lo
        total = int(size.sum())
        ends = np.cumsum(size)
        at = np.arange(total) + np.repeat(lo - ends + size, size)
        group = np.repeat(np.arange(len(lo)), size)
        # The suffixes of an interval that extend by one character follow each other after the step back.
        to = back[at]
        turn = np.argsort(to, kind="stable")
        to, group, char = to[turn], group[turn], bwt[at[turn]]
        first = np.r_[True, (group[1:] != group[:-1]) | (char[1:] != char[:-1]) | (to[1:] != to[:-1] + 1)]
        starts = np.flatnonzero(first)
        lo, hi = to[starts], to[np.r_[starts[1:], total] - 1] + 1
        new = value[hi] < 0
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        value[hi] = length
    return value[:n] < 0


def repeated_starts(segments: list[bytes], order_keys: list[tuple[int, int]], least: int = LEAST) -> list[np.ndarray]:
    """For each segment the starts whose `least` bytes also start at an earlier key, keys being (document, start of the segment)."""
    sizes = np.array([len(s) for s in segments])
    joined = np.zeros(int(sizes.sum()) + len(segments), np.int16)
    at = np.cumsum(sizes + 1) - sizes - 1
    for a, s in zip(at, segments, strict=True):
        joined[a : a + len(s)] = np.frombuffer(s, np.uint8).astype(np.int16) + 1
    order = suffix_order(joined, least + 2)
    klass = np.cumsum(~common_from(joined, order, least))
    segment = np.repeat(np.arange(len(segments)), sizes + 1)
    offset = np.arange(len(joined)) - at[segment]
    valid = (offset + least <= sizes[segment])[order]
    order, klass = order[valid], klass[valid]
    seg, off = segment[order], offset[order]
    doc = np.array([k[0] for k in order_keys], np.int64)[seg]
    pos = np.array([k[1] for k in order_keys], np.int64)[seg] + off
    turn = np.lexsort((pos, doc, klass))
    seg, off, klass = seg[turn], off[turn], klass[turn]
    later = np.r_[False, klass[1:] == klass[:-1]] if len(klass) else np.empty(0, bool)
    out = [[] for _ in segments]
    seg, off = seg[later], off[later]
    for s, o in zip(seg.tolist(), off.tolist(), strict=True):
        out[s].append(o)
    return [np.array(sorted(o), np.int64) for o in out]


def _spans(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Half-open spans of `size` bytes from sorted starts, joined where they touch."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + size).tolist(), strict=True))


def _identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (did, doc_id, text), and the documents among them, (did, text): did is the doc_id if these are unique and not null, else a number in the order of (doc_id, nulls last, text hash)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    c = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if c[0] == c[1] == c[2]:
        rows = rows.withColumn("did", F.col("doc_id"))
        return rows, rows.select("did", "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # Sorted rows of distinct documents are numbered and stored, so the numbers stay.
    ids = table(rows.select("doc_id", "tie").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "tie").withColumn("did", F.monotonically_increasing_id()))
    rows = rows.join(ids.withColumnRenamed("doc_id", "d").withColumnRenamed("tie", "t"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("did", "doc_id", "text")
    return rows, rows.select("did", "text").dropDuplicates(["did"])


def repeated_spans(rows: DataFrame, least: int = LEAST, k: int = ANCHOR, bucket_segments: int = BUCKET_SEGMENTS, anchor_segments: int = ANCHOR_SEGMENTS) -> DataFrame:
    """(did, lo, hi): bytes of rows(did, text) that repeated strings cover; spans may overlap."""
    # Whole copies, whose bytes all go, are told by a hash; a text's first copy stands for them.
    copies = rows.where(F.length("text") >= least).select("did", F.md5("text").alias("m"), F.length("text").cast("long").alias("n"))
    first = copies.groupBy("m").agg(F.min("did").alias("one"), F.count("*").alias("c")).where("c > 1").select("m", "one")
    whole = copies.join(first, "m").where("did <> one").select("did", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            size = 0
            for did, text in zip(batch["did"], batch["text"], strict=True):
                # A later copy in this task adds nothing.
                key = hashlib.blake2b(text, digest_size=16).digest()
                if sent.get(key, 1 << 63) <= did:
                    continue
                if len(sent) > 200_000:
                    sent.clear()
                sent[key] = did
                h, m, place, lo, hi = anchors(text, least, k)
                out.append((h.view(np.int64), m.view(np.int64), np.full(len(h), did, np.int64), place << 16 | (place - lo) << 8 | (hi - lo)))
                size += len(h)
                if size > TOGETHER:
                    yield from frames(out)
                    out, size = [], 0
            if size:
                yield from frames(out)

    def frames(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        """Of equal segments that a task holds together the first is sent under its anchor; the others are repeats already and go their own way."""
        h, m, did, at = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((at, did, m, h))
        h, m, did, at = (x[order] for x in (h, m, did, at))
        again = np.r_[False, (h[1:] == h[:-1]) & (m[1:] == m[:-1])]
        for a in range(0, len(h), 100_000):
            b = slice(a, a + 100_000)
            yield pd.DataFrame({"h": np.where(again[b], did[b] ^ at[b] << 20, h[b]), "m": m[b], "did": did[b], "at": at[b], "again": again[b]})

    found = rows.where(F.length("text") >= least).mapInPandas(find, "h long, m long, did long, at long, again boolean")
    # One exchange: anchors that occur once go; of segments with equal anchor and bytes (128 bits of hash) the first stays.
    same = Window.partitionBy("h", "again")
    found = found.select(
        "h", "did", "at", "again", F.count("*").over(same).alias("c"), (F.min("m").over(same) != F.max("m").over(same)).alias("mixed"),
        F.row_number().over(Window.partitionBy("h", "again", "m").orderBy("did", "at")).alias("nth"),
    ).where("again or c > 1 and (mixed or nth > 1)")
    marks = table(found.select(F.when((F.col("nth") == 1) & ~F.col("again"), F.col("h")).alias("h"), "did", "at"))
    low = F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(F.lit(255))
    equal = marks.where("h is null").select("did", low.alias("lo"), (low + F.col("at").bitwiseAND(F.lit(255)) + least).alias("hi"))
    lists = marks.where("h is not null").groupBy("did").agg(F.collect_list(F.struct("h", "at")).alias("a"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First segments of anchors that have several."""
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                for did, text, marks in batch[["did", "text", "a"]].iloc[at : at + 200].itertuples(index=False):
                    for m in marks:
                        lo = (m["at"] >> 16) - (m["at"] >> 8 & 255)
                        rows.append((m["h"], text[lo : lo + (m["at"] & 255) + least], did, lo))
                yield pd.DataFrame(rows, columns=["h", "piece", "did", "lo"])

    one = rows.join(lists, "did").select("did", "text", "a").mapInPandas(cut, "h long, piece binary, did long, lo long")
    counted = marks.where("h is not null").groupBy("h").agg(F.count("*").alias("c"))
    total = counted.agg(F.sum("c")).first()[0] or 0
    buckets = max(1, -(-total // bucket_segments))
    mixed = one.join(counted, "h").withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    mixed = table(mixed)

    def expand(g: pd.DataFrame) -> pd.DataFrame:
        starts = repeated_starts(list(g["piece"]), list(zip(g["did"], g["lo"], strict=True)), least)
        out = [(did, lo + a, lo + b) for did, lo, s in zip(g["did"], g["lo"], starts, strict=True) for a, b in _spans(s, least)]
        return pd.DataFrame(out, columns=["did", "lo", "hi"])

    spans = "did long, lo long, hi long"
    parts = mixed.where(F.col("c") <= anchor_segments).groupBy("bucket").applyInPandas(expand, spans)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each window of a segment, as a hash of its bytes; of equal ones in a batch all but the first are repeats already."""
        for batch in batches:
            first: dict[bytes, tuple[int, int]] = {}
            again = []
            for did, lo, piece in zip(batch["did"], batch["lo"], batch["piece"], strict=True):
                for o in range(len(piece) - least + 1):
                    key = hashlib.blake2b(piece[o : o + least], digest_size=16).digest()
                    here = did, lo + o
                    old = first.get(key)
                    if old is None:
                        first[key] = here
                    else:
                        first[key] = min(old, here)
                        again.append(max(old, here))
            yield pd.DataFrame([(k, *v) for k, v in first.items()] + [(None, *v) for v in again], columns=["key", "did", "lo"])

    many = table(mixed.where(F.col("c") > anchor_segments).mapInPandas(windows, "key binary, did long, lo long"))
    sent = many.where("key is not null")
    low = sent.groupBy("key").agg(F.min(F.struct("did", "lo")).alias("one"), F.count("*").alias("c")).where("c > 1").select("key", "one")
    hot = sent.join(low, "key").where("struct(did, lo) <> one").select("did", "lo").union(many.where("key is null").select("did", "lo"))
    hot = hot.select("did", "lo", (F.col("lo") + least).alias("hi"))
    return whole.union(equal).union(parts).union(hot)


def dedup_bytes(docs: DataFrame, least: int = LEAST, k: int = ANCHOR, bucket_segments: int = BUCKET_SEGMENTS, anchor_segments: int = ANCHOR_SEGMENTS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) of each row of docs.

    A byte goes if a string of `least` bytes that covers it also starts
    earlier: in a document before (by doc_id, nulls last, then by the text's
    hash), or further up.  Strings are judged on the input and don't cross
    documents.  A null text is empty; rows that repeat doc_id and text are one
    document, with equal results; an empty table gives no rows; other columns
    are left out; texts of any length are read whole.
    """
    rows, documents = _identified(docs)
    spans = repeated_spans(documents, least, k, bucket_segments, anchor_segments)
    spans = spans.groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, marks in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                kept, at, n, end = [], 0, 0, -1
                for lo, hi in sorted((m["lo"], m["hi"]) for m in marks) if marks is not None else ():
                    if lo > end:
                        n += 1
                        kept.append(text[at:lo])
                    end = max(end, hi)
                    at = max(at, hi)
                kept.append(text[at:])
                left = b"".join(kept)
                row = (doc_id, len(text), len(text) - len(left), n, hashlib.sha256(left).hexdigest())
                out.append((*row, left) if with_text else row)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.join(spans, "did", "left").select("doc_id", "text", "spans").mapInPandas(run, schema)
