"""LM scoring with a causal self-attention model in numpy.

The model reads subword ids.  A token attends to the tokens of its own block of
STRIDE and of the block before, so context windows of 2 * STRIDE overlap by
half and every token is scored once, in batched masked attention.  The next
token's probability is that of its class's group and of its class in the group,
from the attention layer, times its share in the class, from counts over all
training documents.  A word's
probability is the product over its subwords, mixed with the word's own
frequency in all training texts; the weight is the one of PARTS under which
all training words are likeliest, each with a frequency that leaves itself out.

Word counts are gathered from all training documents by a shuffle and stored.
Then texts are split and spelt once and stored as numbers (NUMBERED), which
clusters, rounds and scores read.
The attention weights are fitted by Adam in ROUNDS rounds over a share of the
training documents each: every task goes on from the common weights with its
own texts, and the tasks' weights are averaged by the tokens they read, an
embedding by how often its token was read.  All training texts are learned from
whole, in PASSES passes, and token clusters come from all of them, at any size
of the input.  Averaging needs a common start, which is fitted before on about SAMPLE_WINDOWS windows of
SAMPLE_WORDS words.  Counts, scoring and base scores cover whole texts.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import release_memory, table

SAMPLE_WINDOWS, SAMPLE_WORDS = 4000, 64
#: A window of more bytes (it holds a word of that kind) is not drawn for the start; the rounds read it.
SAMPLE_BYTES = 4096
#: Rounds over shares of the training documents, and the rate that they begin and end with.
ROUNDS, RATES = 4, (0.005, 0.001)
#: Subwords that a task learns from together, how often, and blocks of a step.
TOGETHER, PASSES, STEP = 200_000, 1, 32
#: A step has as many more blocks after each WIDEN steps of a task, up to WIDER times as many.
WIDEN, WIDER = 50, 8
#: Weights of words' own frequencies to choose from.
PARTS = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7])
RUN = 64
#: Frequent words whose counts every worker holds, with the most bytes such a word may have; the others' counts are joined, with the same results.
FREQUENT = 300_000
FREQUENT_BYTES = 64
#: Words of more bytes are encoded in parts of so many.
WORD_BYTES = 256
#: Bytes of text that a task splits into words at a time.
PIECE = 8 << 20
STRIDE, WIDTH, HIDDEN = 16, 16, 16
SINGLES, CLUSTERS = 64, 320
#: Classes of a group; a class has the probability of its group times its own in the group.
GROUP = 32


@lru_cache(maxsize=2)
def subwords(path: str):
    """encode(bytes) -> ids of a rank file, and the number of ids; the two ids after it begin a text and end it."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    piece = enc._encode_single_piece

    def encode(word: bytes) -> list[int]:
        if len(word) <= WORD_BYTES:
            return piece(word)
        return [i for at in range(0, len(word), WORD_BYTES) for i in piece(word[at : at + WORD_BYTES])]

    return encode, max(ranks.values()) + 1


class Attention:
    """One layer of causal self-attention over token ids, with class outputs.

    With one head, queries and keys meet in the product of their matrices only,
    and so do values and what they add to; each product is one matrix here, q
    and v, and embeddings stand for keys and values.
    """

    def __init__(self, tokens: int, classes: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        c, d, h, s = int(classes.max()) + 1, WIDTH, HIDDEN, STRIDE
        w = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        self.classes = classes
        self.p = {
            "e": rng.normal(0, 0.3, (tokens, d)).astype(np.float32), "q": w(d, d), "v": w(d, d),
            "near": np.zeros((s, 2 * s), np.float32), "w1": w(d, h), "b1": np.zeros(h, np.float32), "w2": w(h, d) * 0.5,
            "u": w(d, c) * 0.5, "b": np.zeros(c, np.float32), "ug": w(d, -(-c // GROUP)) * 0.5, "bg": np.zeros(-(-c // GROUP), np.float32),
        }
        i, j = np.arange(s)[:, None], np.arange(2 * s)[None, :]
        self.mask = np.where(j <= i + s, 0, -1e9).astype(np.float32)

    @staticmethod
    def blocks(docs: list[np.ndarray], bos: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, outputs, first, owner): blocks of STRIDE tokens, padded with -1 outputs; first: no block comes before."""
        s = STRIDE
        sizes = np.array([len(d) for d in docs])
        count = -(-sizes // s)
        x = np.zeros(int(count.sum()) * s, np.int64)
        y = np.full(len(x), -1, np.int64)
        at = (np.cumsum(count) - count) * s
        for a, d in zip(at, docs, strict=True):
            x[a] = bos
            x[a + 1 : a + len(d)] = d[:-1]
            y[a : a + len(d)] = d
        first = np.zeros(int(count.sum()), bool)
        first[at // s] = True
        return x.reshape(-1, s), y.reshape(-1, s), first, np.repeat(np.arange(len(docs)), count)

    @staticmethod
    def _windows(wide: np.ndarray) -> np.ndarray:
        """Each block of rows with the one before it, as a view; the first STRIDE rows stand before the first."""
        return np.lib.stride_tricks.as_strided(wide, (len(wide) // STRIDE - 1, 2 * STRIDE, wide.shape[1]), (STRIDE * wide.strides[0], *wide.strides))

    def forward(self, x: np.ndarray, first: np.ndarray):
        """What the logits are made of, and all on the way."""
        p, s, d = self.p, STRIDE, WIDTH
        # Embeddings, and ones that sum the attention.
        wide = np.empty((x.size + s, d + 1), p["e"].dtype)
        wide[:s], wide[:, d] = 0, 1
        flat = p["e"].take(x.ravel(), 0)
        wide[s:, :d] = flat
        q, of = (flat @ (p["q"] * d**-0.5)).reshape(-1, s, d), self._windows(wide)
        keys, add, first = of[:, :, :d].transpose(0, 2, 1), p["near"] + self.mask, np.flatnonzero(first)

        def weights() -> np.ndarray:
            a = q @ keys
            a += add
            a[first, :, :s] = -1e9
            return a

        with np.errstate(over="ignore", invalid="ignore"):
            a = weights()
            np.exp(a, out=a)
            m = a @ of
            total = m[:, :, d:]
            fine = total.min(initial=1) > 1e-20 and total.max(initial=1) < 1e30
        if not fine:
            # Texts that repeat without end drive these beyond what exp holds.
            a = weights()
            a -= a.max(2, keepdims=True)
            np.exp(a, out=a)
            m = a @ of
            total = m[:, :, d:]
            if not np.isfinite(total).all():
                raise FloatingPointError("attention overflows")
        # The last column is one.
        total = total.copy()
        m /= total
        m = m.reshape(-1, d + 1)[:, :d]
        h = m @ p["v"]
        h += flat
        pre = h @ p["w1"]
        pre += p["b1"]
        np.maximum(pre, 0, out=pre)
        z = pre @ p["w2"]
        z += h
        return z, (flat, q, of, a, total, m, h, pre)

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the groups' logits, and of the classes', each group with GROUP of them; the last row is the bias."""
        p, pad = self.p, -self.p["u"].shape[1] % GROUP
        own = np.concatenate([p["u"], p["b"][None]])
        if pad:
            none = np.zeros((len(own), pad), own.dtype)
            none[-1] = -1e9
            own = np.concatenate([own, none], 1)
        return np.concatenate([p["ug"], p["bg"][None]]), own

    @staticmethod
    def _by_group(z: np.ndarray, c: np.ndarray, weights: tuple[np.ndarray, np.ndarray]):
        """Tokens of classes c in the order of their groups: that order, spans (group, begin, end) and classes, z with ones, and exponents and chosen logit of the groups and of the classes in the token's group."""
        order = np.argsort((c // GROUP).astype(np.uint16), kind="stable")
        c = c.take(order)
        group = c // GROUP
        z1 = np.empty((len(z), WIDTH + 1), z.dtype)
        z1[:, :WIDTH], z1[:, WIDTH] = z.take(order, 0), 1
        ends = np.cumsum(np.bincount(group, minlength=weights[0].shape[1])).tolist()
        spans = [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
        at_groups, own = z1 @ weights[0], np.empty((len(c), GROUP), z.dtype)
        for g, a, b in spans:
            np.matmul(z1[a:b], weights[1][:, g * GROUP : (g + 1) * GROUP], out=own[a:b])
        found = []
        for logits, nth in ((at_groups, group), (own, c % GROUP)):
            np.minimum(logits, 80, out=logits)
            # Where each token's own is.
            at = np.arange(0, logits.size, logits.shape[1]) + nth
            chosen = logits.ravel().take(at)
            np.exp(logits, out=logits)
            found.append((logits, at, chosen, np.maximum(logits @ np.ones(logits.shape[1], z.dtype), 1e-30)))
        return order, spans, z1, found

    def gradients(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, rows_only: bool = False) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and gradients; with rows_only, that of the embeddings has a row for each of g["ids"], the distinct ids of x."""
        p, s, d, g = self.p, STRIDE, WIDTH, {}
        y = y.ravel()
        c, n = self.classes.take(np.maximum(y, 0)), (y >= 0).sum()
        z, (flat, q, of, a, total, m, h, pre) = self.forward(x, first)
        weights = self._outputs()
        order, spans, z1, found = self._by_group(z, c, weights)
        share, loss = (y >= 0).take(order) / z.dtype.type(n), 0.0
        for logits, at, chosen, norm in found:
            loss += float(share @ (np.log(norm) - chosen))
            logits.ravel()[at] -= norm
            logits *= (share / norm)[:, None]
        (at_groups, *_), (own, *_) = found
        gg, gu, dzs = z1.T @ at_groups, np.zeros_like(weights[1]), np.empty((len(c), d), z.dtype)
        for i, lo, hi in spans:
            at = slice(i * GROUP, (i + 1) * GROUP)
            np.matmul(z1[lo:hi].T, own[lo:hi], out=gu[:, at])
            np.matmul(own[lo:hi], weights[1][:d, at].T, out=dzs[lo:hi])
        dzs += at_groups @ weights[0][:d].T
        dz = np.empty_like(dzs)
        dz[order] = dzs
        classes, ones = len(p["b"]), np.ones(len(c), z.dtype)
        g["u"], g["b"], g["ug"], g["bg"] = gu[:d, :classes], gu[d, :classes], gg[:d], gg[d]
        g["w2"] = pre.T @ dz
        dp = dz @ p["w2"].T
        dp *= pre > 0
        g["w1"], g["b1"] = h.T @ dp, ones @ dp
        dh = dp @ p["w1"].T
        dh += dz
        g["v"] = m.T @ dh
        # Of the weighted sums, and in the last column of the sums of weights.
        dm = np.empty((len(flat), d + 1), z.dtype)
        np.matmul(dh, p["v"].T, out=dm[:, :d])
        np.einsum("ij,ij->i", dm[:, :d], m, out=dm[:, d])
        np.negative(dm[:, d], out=dm[:, d])
        dm = dm.reshape(-1, s, d + 1)
        dm /= total
        ds = dm @ of.transpose(0, 2, 1)
        ds *= a
        g["near"] = (ones[: len(ds)] @ ds.reshape(len(ds), -1)).reshape(s, 2 * s)
        dq = (ds @ of[:, :, :d]).reshape(-1, d)
        dq *= d**-0.5
        g["q"] = flat.T @ dq
        t = ds.transpose(0, 2, 1) @ q
        t += a.transpose(0, 2, 1) @ dm[:, :, :d]
        de = dq @ p["q"].T
        de += dh
        blocks = de.reshape(-1, s, d)
        blocks += t[:, s:]
        # Weights of what is before a first block are zero.
        blocks[:-1] += t[1:, :s]
        flat_ids = x.ravel().astype(np.uint16 if len(p["e"]) <= 1 << 16 else np.int64)
        order = np.argsort(flat_ids, kind="stable")
        ids = flat_ids[order]
        begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["e"], ids = np.add.reduceat(de.take(order, 0), begin), ids[begin]
        if rows_only:
            g["ids"] = ids
        else:
            whole = np.zeros_like(p["e"])
            whole[ids] = g["e"]
            g["e"] = whole
        return loss, g

    def fit(self, docs: list[np.ndarray], bos: int, passes: int = 6, rate: float = 0.01, size: int = 256) -> list[float]:
        """Adam over the documents' blocks; the mean loss of each pass."""
        if not docs:
            return []
        x, y, first, _ = self.blocks(docs, bos)
        first_moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, losses = 0, []
        steps = max(1, passes * -(-len(x) // size))
        for n in range(passes):
            starts = np.random.default_rng(n).permutation(np.arange(0, len(x), size))
            total = 0.0
            for a in starts:
                f = first[a : a + size].copy()
                f[0] = True
                loss, g = self.gradients(x[a : a + size], y[a : a + size], f)
                total += loss / len(starts)
                t += 1
                r = rate * (1 - 0.9 * t / steps) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                for k, v in g.items():
                    first_moment[k] += 0.1 * (v - first_moment[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= r * first_moment[k] / (np.sqrt(second[k]) + 1e-8)
            losses.append(total)
        return losses

    def learn(self, docs: list[np.ndarray], bos: int, rate: float, passes: int, state: dict, size: int = STEP) -> np.ndarray:
        """Adam over the documents at one rate; the ids that were read.  state carries the moments on, and only embeddings that a step reads move.

        Steps are of `size` blocks at first and of up to WIDER times as many once state has seen more of them.
        """
        x, y, first, _ = self.blocks(docs, bos)
        dense = [k for k in self.p if k != "e"]
        if not state:
            whole = np.concatenate([self.p[k].ravel() for k in dense])
            cuts = np.cumsum([self.p[k].size for k in dense])[:-1]
            self.p |= {k: v.reshape(self.p[k].shape) for k, v in zip(dense, np.split(whole, cuts), strict=True)}
            moments = lambda v: (np.zeros_like(v), np.zeros_like(v))
            state |= {"t": 0, "whole": whole, "dense": moments(whole), "e": moments(self.p["e"])}
        for _ in range(passes):
            size_now = size * min(WIDER, 1 + state["t"] // WIDEN)
            for a in np.random.default_rng(state["t"]).permutation(np.arange(0, len(x), size_now)):
                f = first[a : a + size_now].copy()
                f[0] = True
                _, g = self.gradients(x[a : a + size_now], y[a : a + size_now], f, True)
                state["t"] += 1
                t = state["t"]
                r = rate * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                for value, v, one, two, at in ((state["whole"], np.concatenate([g[k].ravel() for k in dense]), *state["dense"], slice(None)), (self.p["e"], g["e"], *state["e"], g["ids"])):
                    m1, m2 = one[at], two[at]
                    m1 = m1 + 0.1 * (v - m1)
                    m2 = m2 + 0.001 * (v * v - m2)
                    one[at], two[at] = m1, m2
                    value[at] -= r * m1 / (np.sqrt(m2) + 1e-8)
        return x.ravel()

    def score(self, docs: list[np.ndarray], bos: int, share: np.ndarray) -> np.ndarray:
        """Natural log probability of each id, over all sequences; share: log of each token's share in its class."""
        x, y, first, _ = self.blocks(docs, bos)
        tokens = y.ravel()
        classes = self.classes.take(np.maximum(tokens, 0))
        out, weights = np.empty(len(tokens), np.float32), self._outputs()
        # So few blocks at a time that what is computed stays in the processor's cache.
        step = 128
        for a in range(0, len(x), step):
            # A window begins with the block before it, which is read but not scored.
            b = max(0, a - 1)
            z = self.forward(x[b : a + step], np.r_[True, first[b + 1 : a + step]])[0][(a - b) * STRIDE :]
            here = slice(a * STRIDE, a * STRIDE + len(z))
            order, _, _, found = self._by_group(z, classes[here], weights)
            out[here][order] = sum(chosen - np.log(norm) for _, _, chosen, norm in found)
        yes = tokens >= 0
        return (out[yes] + share[tokens[yes]]).astype(np.float64)


def mixed(spelt: np.ndarray, frequency: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log probability of each text (a row) under each of PARTS (a column).

    spelt: log of each word by its subwords; frequency: log of each word's own,
    -inf if it has none; words: words of each text, 1 at least.
    """
    high = np.maximum(spelt, frequency)
    spelt, own = np.exp(spelt - high), np.exp(frequency - high)
    begin = np.cumsum(words) - words
    # Each factor is PARTS' least at least, so RUN of them are multiplied before a logarithm is taken.
    runs = -(-words // RUN)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(begin, runs) + RUN * (np.arange(runs.sum()) - np.repeat(first, runs))
    whole, out = np.add.reduceat(high, begin), np.empty((len(words), len(PARTS)))
    for i, p in enumerate(PARTS):
        out[:, i] = np.add.reduceat(np.log(np.multiply.reduceat((1 - p) * spelt + p * own, cuts)), first) + whole
    return out


def log_share(counts: np.ndarray, total: int) -> np.ndarray:
    """Log of each count's share in all; -inf for none."""
    with np.errstate(divide="ignore"):
        return np.log(counts / max(total, 1))


def single_classes(counts: np.ndarray) -> np.ndarray:
    """A class each for the most frequent tokens; SINGLES for the rest."""
    single = np.argsort(-counts, kind="stable")[:SINGLES]
    classes = np.full(len(counts), SINGLES, np.int64)
    classes[single] = np.arange(len(single))
    return classes


def token_classes(counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A class for each token: one each for the most frequent, and clusters for the rest by what comes before them.

    before: how often each token (a row) follows each of single_classes (a column).
    """
    classes = single_classes(counts)
    single = np.flatnonzero(classes < SINGLES)
    classes[classes == SINGLES] = -1
    rest = np.flatnonzero(classes < 0)
    x = np.sqrt(before[rest] / np.maximum(before[rest].sum(1, keepdims=True), 1))
    seen = before[rest].sum(1)
    order = np.argsort(-seen, kind="stable")
    centres = x[order[: min(CLUSTERS, len(order))]].copy()
    weight = seen + 1e-3
    for _ in range(8):
        near = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), 1)
        for k in range(len(centres)):
            mine = near == k
            if mine.any():
                centres[k] = (x[mine] * weight[mine, None]).sum(0) / weight[mine].sum()
    classes[rest] = len(single) + near
    classes = np.unique(classes, return_inverse=True)[1]
    # Classes are numbered so that those of a group are alike in what comes before them.
    whole = np.zeros((classes.max() + 1, before.shape[1]))
    np.add.at(whole, classes, before)
    whole = np.sqrt(whole / np.maximum(whole.sum(1, keepdims=True), 1))

    def alike(some: np.ndarray) -> list[int]:
        """some in an order by halves, of whole groups each, along the direction in which they differ most."""
        half = -(-len(some) // GROUP) // 2 * GROUP
        if not half:
            return some.tolist()
        x = whole[some] - whole[some].mean(0)
        some = some[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        return alike(some[:half]) + alike(some[half:])

    return np.argsort(alike(np.arange(len(whole))))[classes]


def _held_out(docs: DataFrame) -> DataFrame:
    """doc_id, text in bytes and held_out: whether crc32 of the doc_id's text leaves 2 modulo 7; a null doc_id is training."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), out.alias("held_out"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches with a column text, in batches of about PIECE bytes of text, or of one row."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(upto // PIECE, prepend=0)), len(upto)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case (A-Z) words of all texts, and how many each text has; the separators are those of bytes.split()."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text.view(pa.string())))
    words, at = lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    # Empty ones come before, after and instead of separators.
    yes = pc.greater(pc.binary_length(words), 0)
    upto = np.r_[0, np.cumsum(yes.to_numpy(zero_copy_only=False))]
    return words.filter(yes).view(pa.binary()), np.diff(upto[at]).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over rows(text); tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            counts = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            held.clear()
            yield from counts.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches(10_000)

        for batch in pieces(batches):
            count = pc.value_counts(words_of(batch.column("text"))[0])
            held.append(pa.Table.from_arrays([count.field("values"), count.field("counts")], ["word", "c"]))
            n += len(count)
            if n > 400_000:
                yield from merged()
                n = 0
        if held:
            yield from merged()
        release_memory()

    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts(word, c) above the least count at which there are `most` of them at most, so the driver gets no more from any number of tasks."""
    least, n = 0, 0
    for r in counts.where("c >= 4096").groupBy(F.lit(4096).alias("c")).agg(F.count("*").alias("n")).union(counts.where("c < 4096").groupBy("c").agg(F.count("*").alias("n"))).orderBy(F.col("c").desc()).collect():
        n += r["n"]
        if n > most:
            least = r["c"]
            break
    if least == 4096:
        # So many frequent words: their own counts decide, in steps of a 64th.
        step = F.floor(F.log2("c") * 64)
        n = 0
        for r in counts.where("c >= 4096").groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.col("s").desc()).collect():
            n += r["n"]
            if n > most:
                return counts.where(step > r["s"])
    return counts.where(F.col("c") > least)


def training_windows(train: DataFrame, n_words: int) -> list[tuple[bytes, bool]]:
    """The sample, about SAMPLE_WINDOWS windows of n_words words in all: words of a window, and whether the text ends with it."""
    share = min(1.0, SAMPLE_WINDOWS * SAMPLE_WORDS / max(n_words, 1))
    # Few windows are drawn from a text in many rather than fewer from each, so most texts needn't be split.
    every = max(1, int(1 / share) // 8)
    share = min(1.0, share * every)
    train = train.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(every)) == 0)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept: list[tuple[float, bytes, bool]] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = text.lower().split()
                n = max(1, -(-len(words) // SAMPLE_WORDS))
                seed = hashlib.blake2b(b"%s " % str(doc_id).encode() + text, digest_size=8).digest()
                u = np.random.default_rng(int.from_bytes(seed, "little")).random(n)
                for i in np.flatnonzero(u < share):
                    window = b" ".join(words[i * SAMPLE_WORDS : (i + 1) * SAMPLE_WORDS])
                    if len(window) <= SAMPLE_BYTES:
                        kept.append((float(u[i]), window, bool(i == n - 1)))
            yield pd.DataFrame(kept, columns=["u", "words", "ends"])

    drawn = train.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(draw, "u double, words binary, ends boolean")
    return [(bytes(r["words"]), r["ends"]) for r in sorted(drawn.collect())]


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def summed(rows: DataFrame, task: Callable[[Iterator[pd.DataFrame]], dict[str, np.ndarray]], length: int) -> dict[str, np.ndarray]:
    """The sum of what task makes of each partition's rows; one row reaches the driver.

    task returns arrays by name: "i" the rows that it has of a table of `length`
    rows, names beginning with "i_" those rows, others whole arrays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = task(batches)
        if made:
            yield pd.DataFrame({"part": [packed(**made)]})
        del made
        release_memory()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in batch["part"]:
                a = np.load(io.BytesIO(part))
                for k in a.files:
                    if k.startswith("i_"):
                        if k not in total:
                            total[k] = np.zeros((length, *a[k].shape[1:]), a[k].dtype)
                        total[k][a["i"]] += a[k]
                    elif k != "i":
                        total[k] = total[k] + a[k] if k in total else a[k]
        if total:
            some = np.flatnonzero(total["i_n"].reshape(length, -1).any(1))
            yield pd.DataFrame({"part": [packed(i=some, **{k: v[some] if k.startswith("i_") else v for k, v in total.items()})]})

    parts = rows.mapInPandas(run, "part binary").repartition(8).mapInPandas(add, "part binary")
    found = parts.repartition(1).mapInPandas(add, "part binary").collect()
    return dict(np.load(io.BytesIO(found[0]["part"]))) if found else {}


def gathered(values: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values holds `sizes` values of each of some things; those of the things `of`, and how many of each."""
    own = sizes[of]
    upto = np.cumsum(own)
    return values[np.arange(upto[-1] if len(upto) else 0) + np.repeat((np.cumsum(sizes) - sizes)[of] - upto + own, own)], own


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value of so many of the values for each length."""
    ends = np.r_[0, np.cumsum(lengths)] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


#: Of a text: numbers of its words and the end, of the frequent ones in the list given, then of its own others; these, with their subwords and how many each has.
NUMBERED = "doc_id long, held_out boolean, round int, words binary, others binary, spelt binary, sizes binary"


def numbered(rows: DataFrame, given, path: str) -> DataFrame:
    """Each row of doc_id, text, held_out and round with its text as NUMBERED says; given: a broadcast of the frequent words and other things."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(given.value[0], pa.binary())
        encode, _ = subwords(path)
        end = len(known)
        for batch in pieces(batches):
            words, lengths = words_of(batch.column("text"))
            of = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            beyond = np.flatnonzero(of < 0)
            found = words.take(pa.array(beyond)).dictionary_encode()
            names, codes = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)[beyond]
            own, nth = np.unique(owner * max(len(names), 1) + codes, return_inverse=True)
            count = np.bincount(own // max(len(names), 1), minlength=len(lengths))
            of[beyond] = end + 1 + nth - (np.cumsum(count) - count)[owner]
            spelt = [encode(b" " + w) for w in names.to_pylist()]
            sizes = np.array([len(x) for x in spelt], np.int32)
            own = own % max(len(names), 1)
            ids, own_sizes = gathered(np.fromiter((i for x in spelt for i in x), np.int32), sizes, own)
            per_text = np.add.reduceat(np.r_[own_sizes, 0], np.cumsum(count) - count) * (count > 0) if len(count) else count
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), names.take(pa.array(own)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), batch.column("round"), binaries(np.insert(of, np.cumsum(lengths), end), lengths + 1),
                pc.binary_join(lists, pa.scalar(b" ", pa.binary())), binaries(ids, per_text), binaries(own_sizes, count),
            ], [c.split()[0] for c in NUMBERED.split(", ")])
        release_memory()

    return rows.mapInArrow(run, NUMBERED)


def unpacked(some: pd.DataFrame, of_known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of some rows as NUMBERED says: numbers of all words, with the others numbered through; each text's number of words; all subwords; how many each word has.

    of_known, ids: how many subwords each frequent word has, and the end; these.
    """
    join = lambda c: np.frombuffer(b"".join(some[c]), np.int32)
    of, lengths = join("words").astype(np.int64), some["words"].map(len).to_numpy(np.int64) // 4
    others = some["sizes"].map(len).to_numpy(np.int64) // 4
    beyond = of >= len(of_known)
    of[beyond] += np.repeat(np.cumsum(others) - others, lengths)[beyond]
    tokens, sizes = gathered(np.r_[ids, join("spelt")], np.r_[of_known, join("sizes")], of)
    return of, lengths, tokens, sizes


def spell(batches: Iterator[pd.DataFrame], of_known: np.ndarray, ids: np.ndarray, together: int = 0) -> Iterator[list[np.ndarray]]:
    """Subwords of whole texts with the end, of some texts at a time that have about `together` subwords."""
    together = (together or TOGETHER) * 4 // 2
    for batch in batches:
        upto = np.cumsum(batch["words"].map(len).to_numpy(np.int64))
        cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(upto // together, prepend=0)), len(upto)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            _, lengths, tokens, sizes = unpacked(batch.iloc[a:b], of_known, ids)
            begin = np.cumsum(lengths) - lengths
            yield np.split(tokens, np.cumsum(np.add.reduceat(sizes, begin))[:-1])


def followers(train: DataFrame, given, tokens: np.ndarray) -> np.ndarray:
    """How often each token follows each of single_classes, over all training texts."""
    single, bos, width = single_classes(tokens), len(tokens) - 2, SINGLES + 1

    def task(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        count = np.zeros(len(single) * width, np.int64)
        for docs in spell(batches, *given.value[1:3], together=4 * TOGETHER):
            ids = np.concatenate(docs)
            before = np.r_[bos, ids[:-1]]
            before[np.cumsum([len(d) for d in docs])[:-1]] = bos
            count += np.bincount(ids * width + single[before], minlength=len(count))
        count = count.reshape(-1, width)
        some = np.flatnonzero(count.any(1))
        return {"i": some, "i_n": count[some]} if len(some) else {}

    found = summed(train, task, len(single))
    before = np.zeros((len(single), width), np.float32)
    if found:
        before[found["i"]] = found["i_n"]
    return before


def learn_all(train: DataFrame, known, model: Attention) -> int:
    """Fits model on all training texts, in rounds; how many subwords it was shown."""
    bos = len(model.classes) - 2
    shown, passes = 0, PASSES
    for n in range(ROUNDS):
        rate = RATES[0] + (RATES[1] - RATES[0]) * n / (ROUNDS - 1)
        given = train.sparkSession.sparkContext.broadcast(model)

        def task(batches: Iterator[pd.DataFrame], given=given, rate=rate) -> dict[str, np.ndarray]:
            mine, state = None, {}
            for docs in spell(batches, *known.value[1:3]):
                if mine is None:
                    mine = Attention.__new__(Attention)
                    mine.classes, mine.mask, mine.p = given.value.classes, given.value.mask, {k: v.copy() for k, v in given.value.p.items()}
                    read = np.zeros(len(mine.classes), np.int64)
                read += np.bincount(mine.learn(docs, bos, rate, passes, state), minlength=len(read))
            if mine is None or not read.any():
                return {}
            some = np.flatnonzero(read)
            total = read.sum()
            whole = {k: v * np.float64(total) for k, v in mine.p.items() if k != "e"}
            return {"i": some, "i_n": read[some], "i_e": mine.p["e"][some] * read[some, None].astype(np.float32), "n": total} | whole

        found = summed(train.where(F.col("round") == n), task, len(model.classes))
        if found:
            shown += int(found["n"])
            for k in model.p:
                if k == "e":
                    model.p[k][found["i"]] = found["i_e"] / found["i_n"][:, None]
                else:
                    model.p[k] = (found[k] / found["n"]).astype(np.float32)
        given.unpersist()
    return shown


def score_documents(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Tokens are lower-case (A-Z) words and one end a text.  base_score is the
    add-one unigram score in log10 from counts over all training documents,
    score the attention model's log10 probability of the words and the end.  A null or empty text is one end; repeated rows count and are
    scored as often as they occur; without training documents counts are zero;
    an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    rows = _held_out(docs)
    train = rows.where("not held_out")
    counts = table(word_counts(train))
    ends = train.count()
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, n_distinct = totals[0] + ends, totals[1] + (ends > 0)
    top = frequent_words(counts.where(F.length("word") <= FREQUENT_BYTES), frequent).collect()
    known = {bytes(r["word"]): r["c"] for r in top}

    def subword_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, size = subwords(path)
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = [encode(b" " + bytes(w)) for w in batch["word"]]
            sizes = [len(i) for i in ids]
            if ids:
                total += np.bincount(np.concatenate(ids), np.repeat(batch["c"].to_numpy(), sizes), size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"token": some, "c": total[some]})

    encode, size = subwords(path)
    bos, eos = size, size + 1
    # A row a vocabulary entry at most.
    tokens = np.zeros(size + 2, np.int64)
    for r in counts.mapInPandas(subword_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).collect():
        tokens[r["token"]] = r["c"]
    tokens[eos] = ends
    sample = [np.array([i for w in words.split() for i in encode(b" " + w)] + [eos] * last, np.int64) for words, last in training_windows(train, int(totals[0]))]
    # Of each frequent word, and of the end after them: subwords, count.
    spelt = [encode(b" " + w) for w in known] + [[eos]]
    sizes_of, ids_of = np.array([len(x) for x in spelt], np.int32), np.array([i for x in spelt for i in x], np.int32)
    del spelt
    frequent_ones = spark.sparkContext.broadcast((list(known), sizes_of, ids_of))
    texts = table(numbered(rows.withColumn("round", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int")), frequent_ones, path))
    learnt = texts.where("not held_out").select("words", "spelt", "sizes", "round")
    classes = token_classes(tokens, followers(learnt, frequent_ones, tokens))
    model = Attention(size + 2, classes)
    losses = model.fit(sample, bos)
    shown = learn_all(learnt, frequent_ones, model)
    in_class = np.bincount(classes, tokens + 0.1)
    share = (np.log(tokens + 0.1) - np.log(in_class[classes])).astype(np.float32)
    known_counts = np.array([*known.values(), ends], np.int64)
    given = spark.sparkContext.broadcast((sizes_of, ids_of, known_counts, model, share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_known, ids, of_all, model, share = given.value
        logs = np.log10(of_all.astype(float) + 1)
        end = len(of_all) - 1
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = batch.iloc[at : at + 100]
                names = [w for others in some["others"] for w in others.split()]
                of, lengths, tokens, sizes = unpacked(some, of_known, ids)
                begin, upto = np.cumsum(lengths) - lengths, np.cumsum(sizes)
                seqs = np.split(tokens, upto[begin[1:] - 1])
                base = np.add.reduceat(np.r_[logs, np.zeros(len(names))][of], begin) - lengths * np.log10(n_all + n_distinct + 1)
                have = np.add.reduceat((of <= end).astype(np.int64), begin) - (ends == 0)
                owner = np.repeat(np.arange(len(some)), lengths)
                beyond = of > end
                spelt = np.add.reduceat(model.score(seqs, bos, share), upto - sizes)
                # What the other words are worth is added once their counts are known: for each text and word, of all its places.
                by = np.argsort(of[beyond], kind="stable")
                d, w, places = owner[beyond][by], of[beyond][by] - end - 1, spelt[beyond][by]
                cuts = np.flatnonzero(np.diff(w, prepend=-1))
                rest = [[] for _ in range(len(some))]
                places, d, w = places.tolist(), d.tolist(), w.tolist()
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(d)], strict=False):
                    rest[d[a]].append({"word": names[w[a]], "spelt": places[a:b]})
                # The frequent words, and the ends.
                here = ~beyond
                per_text, c = np.bincount(owner[here], minlength=len(some)), of_all[of[here]]
                spelt, train = spelt[here], ~some["held_out"].to_numpy(bool)[owner[here]]
                fit = [None] * len(some)
                if train.any():
                    fit[0] = mixed(spelt[train], log_share(c[train] - 1, n_all - 1), np.array([train.sum()]))[0]
                yield pd.DataFrame({
                    "rid": part + row + np.arange(len(some)), "doc_id": some["doc_id"].astype("Int64").array, "held_out": some["held_out"].array, "n_tokens": lengths,
                    "known": have, "base": base, "rest": rest, "mixed": list(mixed(spelt, log_share(c, n_all), per_text)), "fit": fit,
                })
                row += len(some)
        release_memory()

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, rest array<struct<word:binary,spelt:array<double>>>, mixed array<double>, fit array<double>"
    scored = table(texts.drop("round").mapInPandas(run, schema))
    # Words beyond the frequent ones meet their counts in a join; one that training lacks has none.
    rest = scored.select("rid", "held_out", F.explode("rest").alias("r")).select("rid", "held_out", "r.word", "r.spelt").join(counts, "word", "left")
    rest = table(rest.select("rid", "held_out", "spelt", "c"))

    def fit_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(PARTS))
        for batch in batches:
            if len(batch):
                sizes = batch["spelt"].map(len).to_numpy()
                total += mixed(np.concatenate(batch["spelt"].to_list()), log_share(np.repeat(batch["c"].to_numpy(np.int64), sizes) - 1, n_all - 1), sizes).sum(0)
        yield pd.DataFrame({"fit": [total]})

    fits = scored.where("fit is not null").select("fit").union(rest.where("not held_out").select("spelt", "c").mapInPandas(fit_rest, "fit array<double>"))
    likely = fits.agg(*[F.sum(F.col("fit")[i]) for i in range(len(PARTS))]).first()
    best = int(np.argmax(likely)) if ends else len(PARTS) // 2
    score_documents.losses, score_documents.shown = (losses, float(PARTS[best])), shown
    part, ten = float(PARTS[best]), float(np.log(10))
    own = F.log(F.col("c") / F.lit(float(max(n_all, 1)))) + float(np.log(part))

    def word(x: Column) -> Column:
        by_subwords = x + float(np.log1p(-part))
        return F.when(F.col("c").isNull(), by_subwords).otherwise(F.greatest(by_subwords, own) + F.log1p(F.exp(-F.abs(by_subwords - own))))

    rest = rest.withColumn("mixed", F.aggregate("spelt", F.lit(0.0), lambda total, x: total + word(x)))
    n = F.when(F.col("c").isNull(), 0).otherwise(F.size("spelt"))
    rest = rest.groupBy("rid").agg(F.sum(n).alias("more"), F.sum(n * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("plus"), F.sum("mixed").alias("others"))
    return scored.drop("rest", "fit").join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plus", F.lit(0.0))).alias("base_score"), ((F.col("mixed")[best] + F.coalesce("others", F.lit(0.0))) / ten).alias("score"),
    )
