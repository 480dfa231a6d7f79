"""BPE encoding and decoding.

A pre-token is encoded by backtracking.  One Aho-Corasick pass over the new
pre-tokens of many texts gives the longest vocabulary tokens along each greedy
path; the encoder takes the longest token, checks it with its left neighbour against the pair table (two
tokens may stand side by side only if the merges of their joined bytes leave
them so), and otherwise falls back to the next shorter token that starts there
or to the token before.  A bit for each position keeps it from being tried
twice, so the work is linear and the result is that of the merges.
Decoding copies the bytes between a token's two entries in an offset table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrat.llm.common import kept, release_memory, texts

#: Entries of a worker's table of strings that are encoded already.  When it is full the older half, which holds the frequent ones, stays.
CACHE = 400_000
#: Characters of a string that is kept there; longer ones are encoded anew.
LONGEST = 256


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes as the byte-level BPE of a tokenizer file does."""

    def __init__(self, path: str):
        import ahocorasick
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_chars()
        raw = lambda s: bytes(map(to_byte.__getitem__, s))
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * self.size
        for b, i in ids.items():
            self.token[i] = b
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = raw(a), raw(b)
            whole = ids[a + b]
            self.rank[ids[a], ids[b]] = r, whole
            self.parts.setdefault(whole, (ids[a], ids[b]))
        self.made = {whole: r for r, whole in reversed(self.rank.values())}
        # A vocabulary entry that its own merges don't reach never stands in a text.
        reached: dict[int, bool] = {}
        for b, i in sorted(ids.items(), key=lambda x: len(x[0])):
            parts = self.parts.get(i)
            reached[i] = len(b) == 1 or parts is not None and reached[parts[0]] and reached[parts[1]] and self._seam(*parts, self.made[i])
        ids = {b: i for b, i in ids.items() if reached[i]}
        # The next shorter token that begins a token, for falling back.
        self.shorter: dict[int, int] = {}
        for b, i in ids.items():
            self.shorter[i] = next((ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ids), -1)
        self.find = ahocorasick.Automaton()
        for b, i in ids.items():
            self.find.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.find.make_automaton()
        self.ids = ids
        self.trie: dict = {}
        for b, i in ids.items():
            node = self.trie
            for c in b.decode("latin-1"):
                node = node.setdefault(c, {})
            node[""] = i
        self.pairs: dict[int, bool] = {}
        self.sizes = [len(b) for b in self.token]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.offsets, self.blob = _offsets(self.token)
        self.num_offsets, self.num_blob = _offsets([b"%d," % i for i in range(self.size)])
        self.cache: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _seam(self, a: int, b: int, bound: int) -> bool:
        """Whether no merge across the seam of a and b comes before the one of rank bound, nor before those that made a and b."""
        x, y, made, parts, rank, joint = a, b, self.made, self.parts, self.rank, None
        while True:
            joint = rank.get((x, y))
            if joint is not None and joint[0] < bound:
                return False
            rx, ry = made.get(x, -1), made.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            # Undo the later merge; the left one, if equal merges made both, came first.
            if rx > ry:
                bound, x = rx, parts[x][1]
            else:
                bound, y = ry + (rx < ry), parts[y][0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side."""
        if len(self.pairs) > 300_000:
            self.pairs.clear()
        ok = self.pairs[a << 20 | b] = self._seam(a, b, 1 << 60)
        return ok

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of a pre-token."""
        return self.encode_pieces([piece])[0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens; one Aho-Corasick pass over all of them finds the longest tokens of each greedy path."""
        joined = "\u0100".join([p.decode("latin-1") for p in pieces])
        greedy = [(end, i) for end, (i, _) in self.find.iter_long(joined)] if joined else []
        sizes, pairs, fits, whole = self.sizes, self.pairs, self.compatible, self.ids
        out, k, base, total = [], 0, 0, len(greedy)
        for piece in pieces:
            stop, path = base + len(piece), []
            while k < total and greedy[k][0] < stop:
                path.append(greedy[k][1])
                k += 1
            base = stop + 1
            one = whole.get(piece)
            if one is not None:
                out.append([one])
                continue
            last = -1
            for token in path:
                if last >= 0:
                    ok = pairs.get(last << 20 | token)
                    if not (fits(last, token) if ok is None else ok):
                        out.append(self._backtrack(piece))
                        break
                last = token
            else:
                out.append(path)
        return out

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at a position: a walk down the automaton's trie."""
        node, best = self.trie, -1
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            best = node.get("", best)
        return best

    def _backtrack(self, piece: bytes) -> list[int]:
        text, n = piece.decode("latin-1"), len(piece)
        out: list[int] = []
        free = bytearray(b"\x01") * (n + 1)
        sizes, shorter, pairs, fits = self.sizes, self.shorter, self.pairs, self.compatible
        at, last, token = 0, -1, self._longest(text, 0)
        while True:
            end = at + sizes[token]
            if free[end]:
                if last < 0:
                    ok = True
                else:
                    ok = pairs.get(last << 20 | token)
                    if ok is None:
                        ok = fits(last, token)
                if ok:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, self._longest(text, end)
                    continue
            token = shorter[token]
            while token < 0:
                free[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
            last = out[-1] if out else -1

    def _learn(self, strings: Iterable[str]) -> None:
        """Encodes the pre-tokens that the cache lacks."""
        if len(self.cache) >= CACHE // 2:
            self.cache = dict(islice(self.cache.items(), CACHE // 4))
        new = list({s for s in strings if len(s) <= LONGEST and s not in self.cache})
        for s, ids in zip(new, self.encode_pieces([s.encode() for s in new]), strict=True):
            self.cache[s] = np.array(ids, np.int32).tobytes()

    def _ids(self, s: str) -> bytes:
        """Ids of a pre-token that _learn has seen."""
        return self.cache[s] if len(s) <= LONGEST else np.array(self.encode_bytes(s.encode()), np.int32).tobytes()

    def _plain(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        self._learn(found)
        return b"".join(map(self._ids, found))

    def _parts(self, text: str) -> list[tuple[str, list[str] | None] | int]:
        """Pieces of a text that are encoded apart: special tokens, and strings with the runs that follow them at single spaces.

        A pre-token may hold a space only as its first character, unless
        another white space character stands next to it; a string without such
        a neighbour falls apart at its spaces, another is kept whole.
        """
        out = []
        for part in [text] if self.cut is None or not any(s in text for s in self.special) else self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                first, *rest = part.split(" ")
                beside = [c for c in set(rest).difference(self.runs) if not c or c[0].isspace() or c[-1].isspace()]
                out.append((part, []) if beside or rest and (not first or first[-1].isspace()) else (first, rest))
        return out

    def shrink(self) -> None:
        """Keeps the eldest eighth of the caches, which has most of the common strings."""
        self.cache = dict(islice(self.cache.items(), CACHE // 16))
        self.runs = dict(islice(self.runs.items(), CACHE // 8))

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of texts; a special token's string in one becomes that token."""
        if len(self.runs) >= CACHE:
            self.runs = dict(islice(self.runs.items(), CACHE // 2))
        parts = [self._parts(text) for text in batch]
        runs, find = self.runs, self.pattern.findall
        new: set[str] = set()
        for text in parts:
            for part in text:
                if not isinstance(part, int):
                    new.update(s for s in set(part[1]).difference(runs) if len(s) <= LONGEST)
        split = {s: find(" " + s) for s in new}
        self._learn(p for s in split.values() for p in s)
        for s, found in split.items():
            runs[s] = b"".join(map(self._ids, found))
        out = []
        for text in parts:
            got = []
            for part in text:
                if isinstance(part, int):
                    got.append(np.int32(part).tobytes())
                else:
                    got.append(self._plain(part[0]))
                    got += [runs[s] if len(s) <= LONGEST else self._plain(" " + s) for s in part[1]]
            out.append(np.frombuffer(b"".join(got), np.int32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, special tokens included."""
        return _gather(self.offsets, self.blob, ids)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return _gather(self.num_offsets, self.num_blob, ids)[:-1]


def _offsets(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.frombuffer(b"".join(parts), np.uint8)


def _gather(offsets: np.ndarray, blob: np.ndarray, ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    starts, sizes = offsets[ids], offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(sizes)
    return blob[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes()


def _encoded(enc: Encoder, batch: pd.DataFrame, size: int = 1_000_000) -> Iterator[list[tuple[int, np.ndarray]]]:
    """doc_id and ids of each row, in groups of about so many bytes of text."""
    group: list[tuple[int, str]] = []
    have = 0
    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
        group.append((doc_id, text.decode("utf-8", "replace")))
        have += len(text)
        if have >= size:
            yield list(zip([x[0] for x in group], enc.encode_batch([x[1] for x in group]), strict=True))
            group, have = [], 0
    if group:
        yield list(zip([x[0] for x in group], enc.encode_batch([x[1] for x in group]), strict=True))


@kept
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Ids of each whole text, and what they decode to.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes) and, if asked for, ids.  One row for
    each row of docs: repeated rows stay, a null or empty text has no ids, a
    null doc_id stays null, an empty table gives no rows; other columns of docs
    are left out.  Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            for group in _encoded(enc, batch):
                # A part of a batch at a time: ids take more room than their texts.
                rows = []
                for doc_id, ids in group:
                    row = (doc_id, len(ids), hashlib.sha256(enc.decimal(ids)).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest())
                    rows.append((*row, ids) if with_ids else row)
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "n_tokens": "int64"})
        enc.shrink()
        release_memory()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts(docs).mapInPandas(run, schema)
