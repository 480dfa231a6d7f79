"""N-gram Jaccard join by PartEnum signatures.

Texts are sets of hashed word shingles.  Two sets of Jaccard similarity s or
more have sizes within a factor s, so they share one of the size bands, each
set being put into its own band and, if it can have larger partners, the next
one up.  In a band the two differ in at most k features.  The feature domain is
hashed into n1 parts of n2 cells; with n1 > k / (k2 + 1) there is a part in
which they differ in at most k2 features, so n2 - k2 of its cells hold the same
features in both.  A signature hashes a part, a choice of n2 - k2 of its cells
and the features in them: sufficiently similar sets share one.  Sets are known
by 64 bits of a hash of their features.

No candidate becomes a link before it is verified:

1. One exchange groups signatures.  Of each group, the least set is compared
   with the others: first the L1 distance of two small histograms of features,
   which bounds the difference from below, then the sets themselves.
2. Sets that are linked so far are components.  A group whose sets all lie in
   one component is done.  In the others each set outside of the largest
   component is compared with the one of another component whose histogram is
   nearest, which joins most of them.
3. In groups that still have several components all pairs of different ones are
   looked at, histograms first; of groups where many pairs pass, sets are cut
   into blocks and a kernel for each pair of blocks returns spanning links.

A task that meets a signature again and again compares the newcomers with the
first holder at once; those that are similar to it are linked, and hold the
signature back: it is only looked at again if its group has other components.
So a signature that a third of the texts share is a row or two a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import forget, release_memory, table, texts
from quadrat.llm.components import connected_components

#: Sets, and shingles of sets, in a block of a kernel.
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 1_000_000
#: Sets whose signatures a task remembers to have sent, so that copies send none; also the frequent signatures it remembers.
REMEMBERED = 200_000
#: Shingles that a task holds together, and those of the senders of frequent signatures that it remembers.
TOGETHER, SENDER_SHINGLES = 500_000, 2_000_000
#: How often a signature comes among them to be frequent.
OFTEN = 8
#: Sets of a group that are compared by histograms in one piece, and pairs a set that may pass before blocks take over.
GROUP_ROWS, PAIRS_A_SET = 20_000, 4
#: Rows of one set in a task of the join that verifies pairs.
SALT_ROWS = 1000
BINS = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(batch: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; lower case A-Z; of all its words where it has fewer."""
    words = [t.lower().split() for t in batch]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.empty(0, np.uint64) for _ in batch]
    # Each distinct word is hashed once.
    distinct = dict.fromkeys(flat)
    hashed = pd.util.hash_array(np.array([w.decode("latin-1") for w in distinct], object), categorize=False)
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    h = hashed[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))]
    with np.errstate(over="ignore"):
        run = np.zeros(len(h), np.uint64)
        for i in range(k):
            run[: len(h) - i] += mix64(h[i:] + np.uint64(i + 1) * _MIX)
        out, at = [], 0
        for ws in words:
            n = len(ws)
            if n >= k:
                out.append(np.unique(mix64(run[at : at + n - k + 1])))
            elif n:
                short = sum((mix64(h[at + i : at + i + 1] + np.uint64(i + 1) * _MIX) for i in range(n)), np.zeros(1, np.uint64))
                out.append(mix64(short + np.uint64(n)))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def histogram(s: np.ndarray) -> np.ndarray:
    """Features of a set by BINS classes, 255 at most: the L1 distance of two is at most the sets' difference."""
    return np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


class PartEnum:
    """Signatures of sets for a Jaccard similarity of num / 100 or more.

    need = k // (k2 + 1) + 1 parts are enough for one that k differences don't
    spoil.  There are `spare` times as many, and a set leaves out signatures of
    fewer than c features, which say little, for the largest c at which more
    than the spoilt parts keep all of theirs.  Of two similar sets the one with
    the larger c has an unspoilt part that it keeps whole; the signature that
    the two share there has the same features in both, so the other keeps it too.
    """

    def __init__(self, num: int, k2: int = 1, n2: int = 3, spare: float = 1.15):
        self.num, self.k2, self.n2, self.spare = num, k2, n2, spare
        # Largest set of each band: similar sets lie in one band or in neighbouring ones.
        self.tops = [1]
        while self.tops[-1] < 1 << 31:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // num))
        self.tops_array = np.array(self.tops)
        #: The choices of n2 - k2 cells.
        self.choices = np.array(list(combinations(range(n2), n2 - k2)))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.empty(0, np.uint64)
        band = int(np.searchsorted(self.tops_array, len(s)))
        larger = len(s) * 100 // self.num > self.tops[band]
        return np.concatenate([self._in_band(s, b) for b in (band, band + 1)[: 1 + larger]])

    def _in_band(self, s: np.ndarray, band: int) -> np.ndarray:
        k = 2 * self.tops[band] * (100 - self.num) // (100 + self.num)
        if k == 0:
            # Only equal sets are similar, and they are one.
            return np.empty(0, np.uint64)
        need = k // (self.k2 + 1) + 1
        n1 = math.ceil(need * self.spare)
        cells = n1 * self.n2
        with np.errstate(over="ignore"):
            # Sets come sorted, and a cell is a range of scrambled hashes, so a cell's features follow each other.
            cell = ((s >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
            size = np.bincount(cell, minlength=cells)
            total = np.zeros(len(s) + 1, np.uint64)
            np.cumsum(mix64(s + _MIX), out=total[1:])
            end = np.cumsum(size)
            content = (total[end] - total[end - size]).reshape(n1, self.n2)
            held = size.reshape(n1, self.n2)[:, self.choices].sum(2)
            content = content[:, self.choices].sum(2, dtype=np.uint64)
            c = np.sort(held.min(1))[n1 - need]
            part, choice = np.nonzero(held >= c)
            return mix64(content[part, choice] + mix64((part * 64 + choice).astype(np.uint64) * np.uint64(4096) + np.uint64(band + 1) * _MIX))


def similar(a: np.ndarray, b: np.ndarray, num: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= num * (len(a) + len(b) - both)


def _near(sizes: np.ndarray, bins: np.ndarray, r: int, among: np.ndarray, num: int) -> np.ndarray:
    """Which of the sets `among` may be similar to set r, by sizes and histograms."""
    most = (sizes[among] + sizes[r]) * (100 - num) // (100 + num)
    fits = 100 * np.minimum(sizes[among], sizes[r]) >= num * np.maximum(sizes[among], sizes[r])
    among, most = among[fits], most[fits]
    return among[np.abs(bins[among] - bins[r]).sum(1, dtype=np.int64) <= most]


def group_pairs(comps: np.ndarray, sizes: np.ndarray, bins: np.ndarray, num: int, most: int) -> list[tuple[int, int]] | None:
    """Pairs of a group's sets that lie in different components and may be similar; None beyond `most` of them."""
    out: list[tuple[int, int]] = []
    order = np.argsort(sizes, kind="stable")
    sizes, bins, comps = sizes[order], bins[order].astype(np.int16), comps[order]
    for r in range(1, len(order)):
        low = int(np.searchsorted(sizes, -(-sizes[r] * num // 100)))
        among = np.arange(low, r)
        among = _near(sizes, bins, r, among[comps[among] != comps[r]], num)
        out += [(int(order[i]), int(order[r])) for i in among]
        if len(out) > most:
            return None
    return out


def nearest_pairs(comps: np.ndarray, sizes: np.ndarray, bins: np.ndarray, num: int) -> list[tuple[int, int]]:
    """For each set outside of the group's largest component, the set of another component that may be similar and has the nearest histogram."""
    names, count = np.unique(comps, return_counts=True)
    bins = bins.astype(np.int16)
    out = []
    for r in np.flatnonzero(comps != names[count.argmax()]).tolist():
        among = _near(sizes, bins, r, np.flatnonzero(comps != comps[r]), num)
        if len(among):
            out.append((r, int(among[np.abs(bins[among] - bins[r]).sum(1, dtype=np.int64).argmin()])))
    return out


def spanning_links(ids: list[int], sets: list[np.ndarray], num: int, side: np.ndarray | None = None, comps: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that, with the components known, span those of the sets' similarity graph; with side, only links between its two values are looked for."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    sizes = np.array([len(sets[i]) for i in order])
    bins = np.stack([histogram(sets[i]) for i in order]).astype(np.int16)
    sides = None if side is None else side[order]
    up = list(range(len(order)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    if comps is not None:
        first: dict[int, int] = {}
        for r, i in enumerate(order):
            up[r] = first.setdefault(comps[i], r)
    out = []
    for r in range(1, len(order)):
        low = int(np.searchsorted(sizes, -(-sizes[r] * num // 100)))
        among = np.arange(low, r)
        if sides is not None:
            among = among[sides[low:r] != sides[r]]
        for c in _near(sizes, bins, r, among, num)[::-1].tolist():
            mine, other = root(r), root(c)
            if mine != other and similar(sets[order[c]], sets[order[r]], num):
                up[mine] = other
                out.append((ids[order[c]], ids[order[r]]))
    return out


class Sender:
    """What a task sends of its sets' signatures.

    A signature that comes OFTEN among the sets held together becomes known
    with its first holder.  A later holder that is similar to that one links to
    it and holds the signature back; all others send it.
    """

    def __init__(self, num: int):
        self.num = num
        self.clear()

    def clear(self) -> None:
        self.often, self.first = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.sets: dict[int, np.ndarray] = {}
        self.size = 0

    def split(self, sids: np.ndarray, sets: list[np.ndarray], sigs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(signature, owner, held back) of all sets, and links (sid, first holder)."""
        every = np.concatenate([np.empty(0, np.uint64), *sigs])
        owner = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
        held = np.zeros(len(every), bool)
        sig, begin, of, count = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
        known = np.isin(sig, self.often)
        new = ~known & (count >= OFTEN)
        if new.any():
            if len(self.often) + new.sum() > REMEMBERED or self.size > SENDER_SHINGLES:
                self.clear()
                known[:] = False
            first = owner[begin[new]]
            for i in np.unique(first):
                if int(sids[i]) not in self.sets:
                    self.sets[int(sids[i])] = sets[i]
                    self.size += len(sets[i])
            often, holder = np.concatenate([self.often, sig[new]]), np.concatenate([self.first, sids[first]])
            order = np.argsort(often)
            self.often, self.first = often[order], holder[order]
        links: list[tuple[int, int]] = []
        some = np.flatnonzero((known | new)[of])
        if len(some):
            holder = self.first[np.searchsorted(self.often, every[some])]
            other = holder != sids[owner[some]]
            some, holder = some[other], holder[other]
            if len(some):
                pairs, which = np.unique(np.stack([owner[some], holder]), axis=1, return_inverse=True)
                yes = np.array([similar(sets[i], self.sets[h], self.num) for i, h in pairs.T.tolist()])
                held[some] = yes[which.ravel()]
                links = [(int(sids[i]), h) for i, h in pairs.T[yes].tolist()]
        return every, owner, held, links


#: Rows of a first pass: a document, a signature sent, a link, a signature held back.
DOCUMENT, SENT, LINK, HELD = range(4)
_FOUND = "kind byte, key long, sid long, other long, doc_id long, tie long, n long, bins binary"


def _pass(docs: DataFrame, k: int, num: int) -> DataFrame:
    """_FOUND: documents with their set, its size and histogram; signatures as key; links to other; what is no signature has a key of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        made, seen, sender = PartEnum(num), set(), Sender(num)
        part, rows = TaskContext.get().partitionId(), 0

        def own_keys(n: int) -> np.ndarray:
            nonlocal rows
            rows += n
            with np.errstate(over="ignore"):
                return mix64(np.arange(rows - n, rows, dtype=np.uint64) + np.uint64(part << 40)).view(np.int64)

        def block(n: int, kind: int, /, **columns) -> pd.DataFrame:
            none = pd.arrays.IntegerArray(np.zeros(n, np.int64), np.ones(n, bool))
            whole = {"kind": np.full(n, kind, np.int8)} | dict.fromkeys(("key", "sid", "other", "doc_id", "tie", "n"), none) | {"bins": [None] * n}
            return pd.DataFrame(whole | columns)

        def signatures(sids: list[int], sets: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            of = np.array(sids, np.int64)
            sig, owner, held, links = sender.split(of, sets, [made.signatures(s) for s in sets])
            sig = sig.view(np.int64)
            key, sent = sig[~held], of[owner[~held]]
            for at in range(0, len(key), 200_000):
                yield block(len(key[at : at + 200_000]), SENT, key=key[at : at + 200_000], sid=sent[at : at + 200_000])
            if held.any():
                yield block(int(held.sum()), HELD, key=own_keys(int(held.sum())), sid=of[owner[held]], other=sig[held])
            if links:
                a, b = zip(*links, strict=True)
                yield block(len(links), LINK, key=own_keys(len(links)), sid=np.array(a, np.int64), other=np.array(b, np.int64))

        sids, sets, size = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 400):
                some = batch.iloc[at : at + 400]
                found = shingle_sets(list(some["text"]), k)
                ids = [set_id(s) if len(s) else None for s in found]
                yield block(
                    len(some), DOCUMENT, key=own_keys(len(some)), sid=pd.array(ids, "Int64"), doc_id=some["doc_id"].astype("Int64").array,
                    tie=some["tie"].to_numpy(), n=np.array([len(s) for s in found], np.int64), bins=[histogram(s).tobytes() for s in found],
                )
                for sid, s in zip(ids, found, strict=True):
                    if sid is None or sid in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    sids.append(sid)
                    sets.append(s)
                    size += len(s)
                if size > TOGETHER:
                    yield from signatures(sids, sets)
                    sids, sets, size = [], [], 0
        if sids:
            yield from signatures(sids, sets)
        release_memory()

    return texts(docs).withColumn("tie", F.xxhash64("text")).mapInPandas(run, _FOUND)


def _sets_of(docs: DataFrame, k: int, sids: DataFrame, owners: DataFrame) -> DataFrame:
    """(sid, shingles) of sids(sid); a set is made again from the text of the document with the least id, or, if it has none, from all texts without one."""
    needed = table(sids.distinct().join(owners, "sid").select("sid", "doc_id"))
    every = texts(docs)
    text = every.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")
    if needed.where("doc_id is null").limit(1).count():
        text = text.union(every.where("doc_id is null"))

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 400):
                sets = shingle_sets(list(batch["text"].iloc[at : at + 400]), k)
                yield pd.DataFrame({"sid": [set_id(s) for s in sets], "shingles": [s.tobytes() for s in sets]})
        release_memory()

    return text.mapInPandas(to_sets, "sid long, shingles binary").join(needed.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _may_be_similar(pairs: DataFrame, sketch: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) whose sizes and histograms allow it; sketch(sid, n, bins)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("ba", "bb"))
            n, m = batch["na"].to_numpy(), batch["nb"].to_numpy()
            yes = (100 * np.minimum(n, m) >= num * np.maximum(n, m)) & (np.abs(x - y).sum(1, dtype=np.int64) <= (n + m) * (100 - num) // (100 + num))
            yield batch.loc[yes, ["a", "b"]]

    one, two = (sketch.select(F.col("sid").alias(c), F.col("n").alias("n" + c), F.col("bins").alias("b" + c)) for c in "ab")
    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) that are similar.  A set with many partners is copied to one task for each SALT_ROWS of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yes = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num) for x, y in zip(batch["sa"], batch["sb"], strict=True)]
            yield batch.loc[np.array(yes, bool), ["a", "b"]]

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    one = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    two = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    return salted.join(one, ["a", "part"]).join(two, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def _open_pairs(members: DataFrame, num: int, pairs_a_set: float | None) -> DataFrame:
    """(a, b, dense) of members(key, sid, comp, n, bins, c): pairs of different components in a group that may be similar, or the key of a group with many; without pairs_a_set the nearest pairs alone."""
    schema = "a long, b long, dense long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, sent = None, set()
        for batch in batches:
            if not len(batch):
                continue
            left = batch if left is None else pd.concat([left, batch], ignore_index=True)
            key = left["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            yield from made(left.iloc[:cut], sent)
            left = left.iloc[cut:]
        if left is not None:
            yield from made(left, sent)

    def made(rows: pd.DataFrame, sent: set[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        many: list[int] = []
        key, sid, comp, n = (rows[c].to_numpy() for c in ("key", "sid", "comp", "n"))
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, BINS)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
            # A set that several tasks have sent is here several times.
            at = a + np.unique(sid[a:b], return_index=True)[1]
            pairs = nearest_pairs(comp[at], n[at], bins[at], num) if pairs_a_set is None else group_pairs(comp[at], n[at], bins[at], num, pairs_a_set * len(at))
            if pairs is None:
                many.append(key[a])
                continue
            # A pair that shares several signatures goes once.
            new = {(min(x, y), max(x, y)) for x, y in ((int(sid[at[i]]), int(sid[at[j]])) for i, j in pairs)} - sent
            out += new
            if len(sent) > REMEMBERED:
                sent.clear()
            sent |= new
        # Nulls among plain integers would make them floats.
        none = lambda n: pd.array([None] * n, "Int64")
        yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"]).assign(dense=none(len(out)))
        yield pd.DataFrame({"a": none(len(many)), "b": none(len(many)), "dense": np.array(many, np.int64)})

    small = members.where(F.col("c") <= GROUP_ROWS).select("key", "sid", "comp", "n", "bins")
    found = small.repartition("key").sortWithinPartitions("key").mapInPandas(run, schema)
    none = F.lit(None).cast("long")
    return found.union(members.where(F.col("c") > GROUP_ROWS).select("key").distinct().select(none, none, "key"))


def _dense_links(members: DataFrame, sets: DataFrame, num: int, block_rows: int) -> DataFrame:
    """(a, b) within groups of members(key, sid, comp, n), by a kernel for each pair of blocks of a group."""
    rows = members.dropDuplicates(["key", "sid"])
    blocks = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / F.lit(block_rows), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "sid", "comp", "mine", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2")).join(sets, "sid")

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(b, np.uint64) for b in g["shingles"]]
        two = g["b1"].iloc[0] != g["b2"].iloc[0]
        links = spanning_links(list(g["sid"]), found, num, g["mine"].to_numpy() if two else None, list(g["comp"]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return rows.groupBy("key", "b1", "b2").applyInPandas(kernel, "a long, b long")


def _open_groups(sent: DataFrame, held: DataFrame, comps: DataFrame, sketch: DataFrame) -> DataFrame:
    """(key, sid, comp, n, bins, c): the sets of groups of three or more that have several components; the pair of smaller ones is known.  Of groups of the same sets one is here."""
    of = lambda rows: rows.join(comps, "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    # A set that several tasks have sent counts once.
    ends = [F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("sets")]
    still = of(sent.select("key", "sid").distinct()).groupBy("key").agg(*ends).where("x <> y").drop("x", "y")
    # Signatures held back lie in their first holder's component.
    back = held.select(F.col("other").alias("key"), "sid").join(still.select("key"), "key").distinct()
    more = back.groupBy("key").agg(F.count("*").alias("more"))
    still = still.join(more, "key", "left").select("key", "sets", F.when(F.col("more").isNotNull(), F.col("key")).alias("own"), (F.col("c") + F.coalesce("more", F.lit(0))).alias("c")).where("c > 2")
    still = still.groupBy("sets", "own", "c").agg(F.min("key").alias("key")).select("key", "c")
    members = of(sent.select("key", "sid").union(back).join(still, "key").distinct()).join(sketch.select("sid", "n", "bins"), "sid")
    return members.select("key", "sid", "comp", "n", "bins", "c")


def similar_sets(docs: DataFrame, k: int, num: int, block_rows: int = BLOCK_ROWS, pairs_a_set: int = PAIRS_A_SET) -> tuple[DataFrame, DataFrame]:
    """(base, components): base(doc_id, tie, n_shingles, sid) has a row for each row of docs, components(sid, component) one for each set that is linked with another."""
    found = _pass(docs, k, num)
    # One exchange: a signature's least and largest set; signatures that one set alone has sent go.
    w = Window.partitionBy("key", "kind")
    found = found.withColumns({"low": F.min("sid").over(w), "high": F.max("sid").over(w), "c": F.count("*").over(w)})
    found = table(found.where((F.col("kind") != SENT) | (F.col("low") != F.col("high"))).drop("high"))
    base = found.where(F.col("kind") == DOCUMENT).select("doc_id", "tie", F.col("n").alias("n_shingles"), "sid", "bins")
    sketch = table(base.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("bins").alias("bins")))
    sent, held, met = (found.where(F.col("kind") == x) for x in (SENT, HELD, LINK))

    stars = sent.where("sid <> low").select(F.col("low").alias("a"), F.col("sid").alias("b")).distinct()
    stars = table(_may_be_similar(stars, sketch, num))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    links = _verified(stars, table(_sets_of(docs, k, ends(stars), sketch)), num).union(met.select("sid", "other"))
    comps = table(connected_components(links).select(F.col("node").alias("sid"), "component"))

    for limit in (None, pairs_a_set):
        members = table(_open_groups(sent, held, comps, sketch))
        opened = table(_open_pairs(members, num, limit).distinct())
        if not opened.limit(1).count():
            continue
        pairs, dense = opened.where("dense is null").select("a", "b"), opened.where("dense is not null").select(F.col("dense").alias("key"))
        crowd = members.join(dense, "key", "left_semi").select("key", "sid", "comp", "n")
        sets = table(_sets_of(docs, k, ends(pairs).union(crowd.select("sid")), sketch))
        more = _verified(pairs, sets, num)
        if limit is not None:
            more = more.union(_dense_links(crowd, sets, num, block_rows))
        comps = table(connected_components(comps.select(F.col("sid").alias("a"), F.col("component").alias("b")).union(more)).select(F.col("node").alias("sid"), "component"))
    return base.drop("bins"), comps


def _with_lead(docs: DataFrame, k: int, num: int, block_rows: int, pairs_a_set: int) -> DataFrame:
    """(doc_id, tie, n_shingles, lead) of each row: the least struct(doc_id, tie) that is not null among the rows of its component, where that has several."""
    base, comps = similar_sets(docs, k, num, block_rows, pairs_a_set)
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie"))
    one = base.where("sid is not null").groupBy("sid").agg(F.min(own).alias("lead"), F.count("*").alias("c"))
    one = one.join(comps, "sid", "left")
    # A component with a third of all sets is dealt over tasks by salt.
    salts = 32
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    low = one.where("component is not null").groupBy("component").agg(F.min("lead").alias("low")).withColumn("salt", every)
    linked = one.where("component is not null").withColumn("salt", salt("sid")).join(low, ["component", "salt"]).select("sid", F.col("low").alias("lead"))
    leads = linked.union(one.where("component is null and c > 1").select("sid", "lead")).withColumn("salt", every)
    return base.withColumn("salt", salt("doc_id")).join(leads, ["sid", "salt"], "left").select("doc_id", "tie", "n_shingles", "lead")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, block_rows: int = BLOCK_ROWS, pairs_a_set: int = PAIRS_A_SET) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Documents link when 100 * intersection >= num * union of their k-word
    shingle sets; component_id is the smallest doc_id that links reach.  A text
    without words (null, empty) has no shingles and no links; equal texts link;
    repeated rows stay; rows with a null doc_id get the least doc_id that is not
    null among their texts' links, or null; an empty table gives no rows; texts
    of any length are read whole; other columns, whatever their names, are left out.
    """
    return _with_lead(docs, k, num, block_rows, pairs_a_set).select("doc_id", "n_shingles", F.coalesce("lead.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, block_rows: int = BLOCK_ROWS, pairs_a_set: int = PAIRS_A_SET) -> DataFrame:
    """One row of docs from each group of near copies: that with the smallest doc_id, and of rows under one doc_id that with the least hash.

    Rows without words or without doc_id all stay; of rows that repeat doc_id
    and text one stays, while different texts under one doc_id are documents of
    their own.  An empty table gives no rows; columns keep their names and order.
    """
    groups = _with_lead(docs.where("doc_id is not null"), k, num, block_rows, pairs_a_set).where("n_shingles > 0")
    counted = table(groups.groupBy("doc_id", "tie").agg(F.count("*").alias("c"), F.max((F.col("lead").isNotNull() & (F.col("lead") != F.struct("doc_id", "tie"))).cast("int")).alias("goes")))
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"))
    left = rows.join(counted.where("goes = 1").select("doc_id", "tie"), ["doc_id", "tie"], "left_anti")
    again = counted.where("goes = 0 and c > 1").select("doc_id", "tie")
    if again.limit(1).count():
        once = left.join(again, ["doc_id", "tie"], "left_semi").dropDuplicates(["doc_id", "tie"])
        left = left.join(again, ["doc_id", "tie"], "left_anti").select("row").union(once.select("row"))
    return left.select("row.*")
