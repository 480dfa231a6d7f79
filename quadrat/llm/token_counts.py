"""Token counts under a unigram vocabulary.

Distinct pre-tokens of a batch are put into a trie.  A node's forward score,
the best sum of piece scores over segmentations of the string that leads to it,
depends only on that string, so it is computed once however many pre-tokens
share it.  A node also carries the walks through the vocabulary's trie that are
still alive there, so only pieces that can match are looked at.  The count of
pieces on the best segmentation is stored at each terminal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrat.llm.common import texts

#: Terminal counts that a worker keeps; when full, the older half stays.
CACHE = 400_000
#: Characters of a pre-token up to which all of a depth are scored at once.
LEVELS = 64
#: Characters up to which a pre-token's nodes and count are kept.
LONGEST = 1024


class Unigram:
    """Piece counts of best segmentations.

    pieces: (string, log probability).  A character that no piece covers is
    written as its bytes, each with the lowest score less one.  Of equal scores
    the segmentation with fewer pieces counts.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.root: dict = {}
        self.floor = min((s for _, s in pieces), default=0.0) - 1.0
        for text, score in pieces:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = max(score, node.get("", score))
        self.counts: dict[str, int] = {}
        # The vocabulary's trie in arrays: steps sorted by (state, character), and each state's piece score.
        states, steps = [self.root], []
        for i, node in enumerate(states):
            for c, after in node.items():
                if c:
                    steps.append((i << 21 | ord(c), len(states)))
                    states.append(after)
        steps.sort()
        self.keys = np.array([k for k, _ in steps] + [1 << 62], np.int64)
        self.after = np.array([a for _, a in steps] + [-1], np.int64)
        self.piece = np.array([node.get("", -np.inf) for node in states])
        self.inner = np.array([len(node) > ("" in node) for node in states])

    def count(self, tokens: list[str]) -> None:
        """Puts the counts of new pre-tokens into self.counts."""
        self._by_level(sorted(t for t in tokens if len(t) <= LEVELS))
        self._by_character([t for t in tokens if len(t) > LEVELS])

    def _by_level(self, tokens: list[str]) -> None:
        """All trie nodes of one depth at once; in sorted pre-tokens those under a node follow each other."""
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start, pieces = np.cumsum(length) - length, np.zeros(len(tokens), np.int64)
        alive = np.flatnonzero(length)
        # The last level's nodes: of each alive pre-token its node; of each node its score, pieces and live walks, the new one first.
        node, score, number = np.zeros(len(alive), np.int64), np.zeros(1), np.zeros(1, np.int64)
        state, begun, used = np.zeros(1, np.int64), score, number
        first, many = np.zeros(1, np.int64), np.ones(1, np.int64)
        for depth in range(int(length.max(initial=0))):
            c = flat[start[alive] + depth]
            new = np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])]
            node, parent, c = np.cumsum(new) - 1, node[new], c[new]
            n = many[parent]
            owner = np.repeat(np.arange(len(c)), n)
            walk = np.arange(len(owner)) + np.repeat(first[parent] - np.cumsum(n) + n, n)
            key = state[walk] << 21 | c[owner]
            at = np.searchsorted(self.keys, key)
            goes = np.flatnonzero(self.keys[at] == key)
            owner, walk, state = owner[goes], walk[goes], self.after[at[goes]]
            begun, used = begun[walk], used[walk]
            # A character that no piece covers: each of its bytes is a piece.
            size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            own, least = score[parent] + size * self.floor, number[parent] + size
            s = begun + self.piece[state]
            score = own.copy()
            np.maximum.at(score, owner, s)
            number = np.where(own == score, least, np.iinfo(np.int64).max)
            best = np.flatnonzero(s == score[owner])
            np.minimum.at(number, owner[best], used[best] + 1)
            ends = length[alive] == depth + 1
            pieces[alive[ends]] = number[node[ends]]
            alive, node = alive[~ends], node[~ends]
            # Walks that can go on, each node's new one before them.
            on = np.flatnonzero(self.inner[state])
            owner = owner[on]
            many = np.bincount(owner, minlength=len(c)) + 1
            first = np.cumsum(many) - many
            to = np.arange(len(owner)) + owner + 1
            state, begun, used = (self._placed(x[on], to, y, first) for x, y in ((state, np.zeros(len(c), np.int64)), (begun, score), (used, number)))
        self.counts.update(zip(tokens, pieces.tolist(), strict=True))

    @staticmethod
    def _placed(walks: np.ndarray, to: np.ndarray, fresh: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty(len(walks) + len(fresh), fresh.dtype)
        out[to], out[first] = walks, fresh
        return out

    def _by_character(self, tokens: list[str]) -> None:
        """The same, node by node: for long pre-tokens, whose depths hold few nodes."""
        root, floor = self.root, self.floor
        # A trie node: [children, forward score, pieces, live walks as (vocabulary node, score, pieces)]
        top: list = [{}, 0.0, 0, []]
        for token in tokens:
            node = top
            for c in token:
                child = node[0].get(c)
                if child is None:
                    # A byte-wise character: each of its bytes is a piece.
                    size = len(c.encode("utf-8", "surrogatepass"))
                    best, n, live = node[1] + size * floor, node[2] + size, []
                    for walk, score, k in (*node[3], (root, node[1], node[2])):
                        step = walk.get(c)
                        if step is not None:
                            live.append((step, score, k))
                            s = step.get("")
                            if s is not None:
                                s += score
                                if s > best or s == best and k + 1 < n:
                                    best, n = s, k + 1
                    child = [{}, best, n, live]
                    if len(token) <= LONGEST:
                        node[0][c] = child
                node = child
            self.counts[token] = node[2]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Unigram:
    """Pieces of a sentencepiece file.  Its own scores are ranks of merges; as log probabilities they are read by Zipf's law, -ln(rank + 2)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    norm = math.log(sum(1 / (r + 2) for r in range(len(plain))))
    return Unigram([(sp.id_to_piece(i), -math.log(r + 2) - norm) for r, i in enumerate(plain)])


def count_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of docs.

    A pre-token is a word with the mark of a space before it, U+2581.  A null
    or empty text has none of either; repeated rows are counted alike; an empty
    table gives no rows; other columns are left out; texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = vocabulary(path)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                words = [["▁" + w.decode("utf-8", "replace") for w in t.split()] for t in part["text"]]
                # One trie for the texts together: their new pre-tokens share prefixes.
                known, new = model.counts, set()
                for w in words:
                    new.update(w)
                new.difference_update(known)
                if len(known) + len(new) > CACHE:
                    model.counts = known = dict(islice(known.items(), CACHE // 2))
                    new = {x for w in words for x in w if x not in known}
                model.count(list(new))
                get = model.counts.__getitem__
                rows += [(i, len(w), sum(map(get, w))) for i, w in zip(part["doc_id"], words, strict=True)]
                for x in new:
                    if len(x) > LONGEST:
                        del known[x]
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_tokens"]).astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(run, "doc_id long, n_words long, n_tokens long")
