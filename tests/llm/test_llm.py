"""Each operator against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import bpe, common, jaccard_join, license_scan, line_dedup, lm_score, mixing, order_minhash, quality, suffix_dedup, token_counts
from quadrat.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, row string, h long"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices(["th", "en", "ou", "ing", "é", "re"], k=RNG.randint(1, 4))) for _ in range(300)]


def _sentence(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def _texts():
    base = [_sentence(RNG.randint(20, 200)) for _ in range(25)]
    shared = _sentence(60)
    out = [*base, base[0], base[0], base[1] + " one more", shared + "\n" + base[2], base[3] + "\n" + shared, base[4] + "\n" + base[5] + "\n" + base[6], base[7] + "\n" + base[5] + "\n" + base[6]]
    near = base[8].split(" ")
    near[len(near) // 2] = "other"
    return [*out, " ".join(near), "", None, "word", "  \n ", "a b\tc\n\nd", _sentence(9000), "ab " * 400, "Released under the MIT License.\nSPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR (Apache-2.0 AND MIT)", "<|endoftext|> tail", "THE END!! ### $$$ 12 34", "😀 中文 " * 40]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 0, "q", "r", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, repeated rows, two texts under one id."""
    rows = [(None, "some words here", None, None, None, None, None, None), (1, None, *[None] * 6), (2, "same row twice " * 20, *[None] * 6), (2, "same row twice " * 20, *[None] * 6), (2, "other text " * 20, *[None] * 6), (None, None, *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA)


OPERATORS = {
    "bpe": lambda d: bpe.encode_documents(d, tokenizer_path("byte_bpe_50k.json")),
    "minhash": order_minhash.fingerprint_documents,
    "lm": lambda d: lm_score.score_documents(d, tokenizer_path("byte_bpe_50k.tiktoken"), 50),
    "jaccard": jaccard_join.jaccard_components,
    "suffix": suffix_dedup.dedup_bytes,
    "quality": quality.judge,
    "tokens": lambda d: token_counts.count_documents(d, tokenizer_path("piece_bpe_32k.model")),
    "license": license_scan.scan_documents,
    "lines": line_dedup.dedup_lines,
    "mixing": mixing.mix_digest,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(spark, awkward, name):
    assert len(OPERATORS[name](awkward).collect()) == awkward.count()
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_bpe_equals_the_tokenizers_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in OPERATORS["bpe"](docs).collect():
        ids = t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_keeps_many_strings():
    """Strings that come again aren't encoded again, though there are more of them than a worker once kept."""
    enc = bpe.Encoder(tokenizer_path("byte_bpe_50k.json"))
    text = " ".join(f"w{i}" for i in range(220_000))
    first = enc.encode(text)
    enc.encode("another")
    assert len(enc.runs) >= 219_999 and (enc.encode(text) == first).all()


def test_order_minhash(docs):
    rows = {r["doc_id"]: r for r in order_minhash.fingerprint_documents(docs).collect()}
    for i, t in enumerate(TEXTS):
        t, other, r = t or "", TEXTS[i - 1] or "", rows[i]
        half = len(t) // 2
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()
    assert rows[0]["fingerprint"] == rows[25]["fingerprint"] == rows[26]["fingerprint"] and rows[26]["near_next"] == 1.0
    long = [r for i, r in rows.items() if i < 25 and r["n_chars"] > 500]
    assert 0.02 < np.mean([r["near_edited"] for r in long]) < 0.5 and np.mean([r["near_next"] for r in long]) < 0.05


def _brute_fingerprint(text, k=5, l=2, m=64):
    """The same fingerprint in plain Python, with Spark's xxhash64."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    one = lambda b, seed: signed(xxhash.xxh64_intdigest(b, seed & (1 << 64) - 1))
    number = lambda x, seed=42: one((x & (1 << 64) - 1).to_bytes(8, "little"), seed)

    def many(xs):
        h = 42
        for x in xs:
            h = number(x, h)
        return h

    small = lambda x, seed: one((x & (1 << 32) - 1).to_bytes(4, "little"), seed)
    words = [one(w, 42) for w in (text or "").encode().split()]
    if not words:
        return ""
    pos = (1 << 26) - 1
    kmers = [(many(words[i : i + k]) & ~pos, i) for i in range(max(1, len(words) - k + 1))]
    seen: Counter = Counter()
    numbered = []
    for h, i in kmers:
        numbered.append((small(seen[h], number(h >> 26)) & ~pos, i))
        seen[h] += 1

    def components(items, n):
        step, out = (1 << 64) // n, []
        items = sorted((h | i) for h, i in items)
        for b in range(n):
            point = (-(1 << 63) + b * step) & ~pos | pos
            start = sum(x < point for x in items)
            picked = [items[(start + j) % len(items)] for j in range(l)]
            out.append(many([(x & (1 << 64) - 1) >> 26 for x in sorted(picked, key=lambda x: x & pos)]))
        return out

    if len(numbered) < order_minhash.FEW:
        got = []
        for seed in range(order_minhash.ORDERS):
            again = [(small(seed, number((h & (1 << 64) - 1) >> 26)) & ~pos, i) for h, i in numbered]
            got += components(again, m // order_minhash.ORDERS)
    else:
        got = components(numbered, m)
    return "".join(f"{x & 0xFFFF:04x}" for x in got)


def test_order_minhash_equals_brute_force(docs):
    rows = {r["doc_id"]: r for r in order_minhash.fingerprint_documents(docs).collect()}
    share = lambda a, b: 1.0 if a == b else 0.0 if not a or not b else sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64
    for i, t in enumerate(TEXTS):
        t, other, r = t or "", TEXTS[i - 1] or "", rows[i]
        half = len(t) // 2
        mine, edited = _brute_fingerprint(t), _brute_fingerprint(t[: len(t) - half] + other[:half])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (mine, edited)
        assert (r["near_edited"], r["near_next"]) == (share(mine, edited), share(mine, _brute_fingerprint(other)))


def test_order_matters_to_fingerprints(spark):
    a, b = _sentence(100), _sentence(100)
    df = spark.createDataFrame([(a + " " + b, b + " " + a)], "x string, y string")
    near = df.select(order_minhash.likeness(order_minhash.fingerprint(F.col("x"), l=3), order_minhash.fingerprint(F.col("y"), l=3))).first()[0]
    assert 0.05 < near < 0.7  # the sets agree almost wholly


def test_lm_base_and_held_out(docs):
    rows = {r["doc_id"]: r for r in OPERATORS["lm"](docs).collect()}
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    c = Counter(w for i, t in enumerate(TEXTS) if not held[i] for w in split(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(TEXTS):
        w = split(t)
        assert (rows[i]["held_out"], rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows.values())


def test_lm_words_keep_their_frequencies(docs):
    """How many words the workers hold doesn't matter to the scores."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    few, all_ = ({r["doc_id"]: r["score"] for r in lm_score.score_documents(docs, path, n).collect()} for n in (3, 100_000))
    assert few == pytest.approx(all_, rel=1e-6)


def test_attention_beats_frequencies_on_held_out_sequences():
    """Sequences that walk a ring, so what comes next is known from the context alone."""
    rng = np.random.default_rng(4)
    make = lambda: np.append((np.arange(60) * rng.choice([1, 2]) + rng.integers(8)) % 8, 9)
    train, held = [make() for _ in range(300)], [make() for _ in range(20)]
    m = lm_score.Attention(10, np.arange(10))
    losses = m.fit(train, 8, passes=8, size=32)
    assert losses[-1] < losses[0]
    got = m.score(held, 8, np.zeros(10, np.float32))
    assert len(got) == 20 * 61 and got.mean() > 0.5 * np.log(1 / 8)
    alone = m.score(held[3:4], 8, np.zeros(10, np.float32))
    assert np.allclose(alone, got[3 * 61 : 4 * 61], atol=1e-4)  # neighbours in a batch don't leak


def test_lm_learns_from_texts_beyond_the_start(spark, monkeypatch):
    """The start sees one window of words in any order; which word follows is to be learnt from the other texts."""
    monkeypatch.setattr(lm_score, "SAMPLE_WINDOWS", 1)
    rng, words = random.Random(3), ["the", "of", "and", "to", "in", "is", "for", "on"]
    ring = lambda: " ".join(words[(i + a) % 8] for a in [rng.randrange(8)] for i in range(200))
    rows = [(i, ring()) for i in range(150)]
    made = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), tokenizer_path("byte_bpe_50k.tiktoken"))
    held = [r for r in made.collect() if r["held_out"]]
    assert len(held) > 5 and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


@pytest.mark.parametrize("n", [300, 50_000])
def test_lm_learns_from_all_training_texts(spark, n):
    """Of few texts and of many (over four million subwords) every one is learned from whole; each has six blocks."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("the of and to in is for on " * 11 + "the of and to in is for").alias("text"))
    lm_score.score_documents(rows, tokenizer_path("byte_bpe_50k.tiktoken"))
    assert lm_score.score_documents.shown == 96 * sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(n))


def test_lm_learns_in_little_time():
    """Once a task has read some texts, a subword takes less than adding 110 numbers in Python; it took about 150."""
    rng = np.random.default_rng(5)
    docs, state = [rng.integers(0, 5000, 1000) for _ in range(100)], {}
    m = lm_score.Attention(5002, np.arange(5002) % 192)
    m.learn(docs, 5000, 0.005, 1, state)
    took = []
    for _ in range(3):
        began = time.process_time()
        sum(range(2_000_000))
        one = (time.process_time() - began) / 2_000_000
        began = time.process_time()
        m.learn(docs, 5000, 0.005, 1, state)
        took.append((time.process_time() - began) / 100_000 / one)
    assert min(took) < 110


def test_lm_texts_are_stored_as_their_subwords(spark, docs):
    """With few frequent words: numbers and others of every text give the subwords of its words and the end."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encode, size = lm_score.subwords(path)
    known = [VOCABULARY[0].encode(), b"word"]
    ids = [encode(b" " + w) for w in known] + [[size + 1]]
    of_known, ids = np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], np.int32)
    given = spark.sparkContext.broadcast((known, of_known, ids))
    got = lm_score.numbered(lm_score._held_out(docs).withColumn("round", F.lit(0)), given, path).toPandas()
    of, lengths, tokens, sizes = lm_score.unpacked(got, of_known, ids)
    words = [[*(TEXTS[i] or "").encode().lower().split(), None] for i in got["doc_id"]]
    assert lengths.tolist() == [len(w) for w in words]
    assert tokens.tolist() == [i for w in words for x in w for i in (encode(b" " + x) if x else [size + 1])]
    assert np.split(tokens, np.cumsum(sizes)[:-1])[0].tolist() == encode(b" " + words[0][0])
    small = lm_score.spell(iter([got]), of_known, ids, 50)
    assert np.concatenate([x for some in small for x in some]).tolist() == tokens.tolist()


def test_attention_gradients():
    rng = np.random.default_rng(0)
    m = lm_score.Attention(12, np.arange(12) % 5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y, first, _ = m.blocks([rng.integers(0, 11, n) for n in (5, 40, 17)], 11)
    _, g = m.gradients(x, y, first)
    for k, at in (("q", (1, 2)), ("v", (3, 4)), ("near", (3, 12)), ("w1", (0, 5)), ("u", (2, 1)), ("e", (int(x[1, 2]), 3))):
        old, e = m.p[k][at], 1e-5
        m.p[k][at] = old + e
        a, _ = m.gradients(x, y, first)
        m.p[k][at] = old - e
        b, _ = m.gradients(x, y, first)
        m.p[k][at] = old
        assert g[k][at] == pytest.approx((a - b) / 2 / e, rel=1e-4, abs=1e-9)


@pytest.mark.parametrize(("k", "num", "limits"), [(3, 90, (1500, 4)), (5, 80, (1500, 4)), (1, 60, (2, -1)), (1, 60, (2, 0.5))])
def test_jaccard_components(docs, k, num, limits):
    sets = []
    for t in TEXTS:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(sets)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, k, num, *limits).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_jaccard_links_through_texts_without_an_id(spark):
    """5 resembles the text without an id, and that resembles 9; 5 and 9 don't."""
    w = [f"w{i}" for i in range(200)]
    rows = [(5, " ".join(w[:190])), (None, " ".join(w[8:198])), (9, " ".join(w[16:] + ["a", "b"])), (None, "apart " * 3)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == [(5, 5), (9, 5), (None, 5), (None, None)]


def test_keep_one_keeps_different_texts_under_one_id(spark):
    long, other = TEXTS[0], TEXTS[1]
    rows = [(2, long), (2, other), (1, long + " more"), (3, other), (3, other), (None, long), (None, None), (4, None), (5, ""), (6, TEXTS[2]), (6, TEXTS[2])]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, long + " more"), (2, other), (None, long), (None, None), (4, None), (5, ""), (6, TEXTS[2])], key=str)


def test_open_groups_hold_a_set_once_and_groups_of_the_same_sets_once(spark):
    """Groups 1 and 2 hold the same sets, 3 has two that many tasks sent, 4 is closed, 5 has one more that was held back."""
    groups = {1: [1, 2, 3, 3], 2: [3, 2, 1], 3: [1, 1, 3], 4: [1, 2, 2], 5: [1, 2, 3]}
    sent = spark.createDataFrame([(k, s, len(g)) for k, g in groups.items() for s in g], "key long, sid long, c long")
    held = spark.createDataFrame([(9, 5, 4), (9, 5, 4), (9, 4, 4)], "key long, other long, sid long")
    comps = spark.createDataFrame([(1, 1), (2, 1), (4, 1)], "sid long, component long")
    sketch = spark.createDataFrame([(s, 9, bytearray(4)) for s in range(1, 5)], "sid long, n long, bins binary")
    got = sorted((r["key"], r["sid"], r["comp"], r["c"]) for r in jaccard_join._open_groups(sent, held, comps, sketch).collect())
    assert got == [(1, 1, 1, 3), (1, 2, 1, 3), (1, 3, 3, 3), (5, 1, 1, 4), (5, 2, 1, 4), (5, 3, 3, 4), (5, 4, 1, 4)]


def test_jaccard_tasks_forget_encoders():
    bpe.encoder(tokenizer_path("byte_bpe_50k.json"))
    assert bpe.encoder.cache_info().currsize
    common.forget()
    assert not bpe.encoder.cache_info().currsize


def test_partenum_loses_no_similar_pair():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        made = jaccard_join.PartEnum(num)
        for n in [*range(1, 40), 75, 200, 801]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                gone = rng.integers(0, n * (100 - num) // 100 + 1)
                most = int((n - gone) * 100 / num) - n
                b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 63, max(0, most)).astype(np.uint64)])
                if len(b) and jaccard_join.similar(a, b, num) and not np.array_equal(a, b):
                    assert np.intersect1d(made.signatures(a), made.signatures(b)).size


@pytest.mark.parametrize("options", [{}, {"anchor_segments": 1}, {"bucket_segments": 3}])
def test_suffix_dedup(docs, options):
    texts, least, first = [(t or "").encode() for t in TEXTS], 100, {}
    for d, t in enumerate(texts):
        for s in range(len(t) - least + 1):
            first.setdefault(t[s : s + least], (d, s))
    for r in suffix_dedup.dedup_bytes(docs, **options).collect():
        t = texts[r["doc_id"]]
        gone = bytearray(len(t))
        for s in range(len(t) - least + 1):
            if first[t[s : s + least]] != (r["doc_id"], s):
                gone[s : s + least] = b"\1" * least
        assert r["n_removed"] == sum(gone) and r["n_bytes"] == len(t)
        assert r["n_spans"] == len(bytes(gone).replace(b"\0", b" ").split())
        assert r["kept_sha256"] == hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


def test_quality_counts():
    for t in TEXTS:
        t = t or ""
        c, _ = quality.measures(t.encode())
        w = t.encode().split()
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = t.split("\n")
        dup = sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines))
        assert c == {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(ch in "#*$%&|<>" for ch in t), "n_dup_lines": dup, "n_repeat_words": len(cover)}


def test_weak_supervision_finds_the_bad():
    rng = np.random.default_rng(2)
    patterns: Counter[str] = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        patterns["".join("-" if rng.random() < (0.003 if good else 0.5) else "+" for _ in range(6))] += 1
    q = quality.fit(dict(patterns))
    assert q["++++++"] > 0.9 and q["+--+++"] < 0.1
    assert quality.fit({}) == {}


def test_token_counts():
    model = token_counts.Unigram([("a", -1.0), ("b", -1.2), ("ab", -1.5), ("abc", -4.0), ("bc", -2.0), ("c", -1.1)])
    words = ["abc", "abcb", "aab", "é", "cab", ""]
    model.count(words)

    def brute(w):
        best = {0: (0.0, 0)}
        pieces = {"a": -1.0, "b": -1.2, "ab": -1.5, "abc": -4.0, "bc": -2.0, "c": -1.1}
        for i in range(1, len(w) + 1):
            ways = [(best[j][0] + pieces[w[j:i]], -best[j][1] - 1) for j in range(i) if w[j:i] in pieces]
            size = len(w[i - 1].encode())
            ways.append((best[i - 1][0] - 5.0 * size, -best[i - 1][1] - size))
            s, n = max(ways)
            best[i] = (s, -n)
        return best[len(w)][1]

    assert [model.counts[w] for w in words] == [brute(w) for w in words]


def test_license_scan(docs):
    rows = {r["doc_id"]: r for r in license_scan.scan_documents(docs).collect()}
    r = rows[next(i for i, t in enumerate(TEXTS) if t and "SPDX" in t)]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (1, 3, 3, "mit", "apache,gpl,mit")
    assert license_scan.postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert license_scan.evaluate("GPL-3.0 OR MIT")[0] == 1.0 and license_scan.evaluate("GPL-3.0 AND MIT")[0] == 0.3
    assert license_scan.evaluate(") AND (")[1] == set()


def test_line_dedup(docs):
    first, kept = {}, {}
    seqs = [[(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for t in TEXTS]
    for d, s in enumerate(seqs):
        for k in range(len(s)):
            for key in ([(s[k][1], s[k + 1][1])] if k + 1 < len(s) else []) + ([s[k][1]] if len(s[k][1].split()) >= 30 else []):
                first.setdefault(key, (d, k))
    for d, s in enumerate(seqs):
        gone = set()
        for k in range(len(s)):
            if k + 1 < len(s) and first[s[k][1], s[k + 1][1]] != (d, k):
                gone |= {s[k][0], s[k + 1][0]}
            if s[k][1] in first and first[s[k][1]] != (d, k):
                gone.add(s[k][0])
        kept[d] = None if TEXTS[d] is None else "\n".join(x for k, x in enumerate(TEXTS[d].split("\n")) if k not in gone)
    assert {r["d"]: r["text"] for r in line_dedup.dedup_lines(docs).select(F.col("row.doc_id").alias("d"), "text").collect()} == kept


def test_mixing(docs):
    rows = mixing.mix_digest(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_digest(docs.repartition(5)).collect()))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    sizes = {i: len((t or "").encode().split()) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    source = lambda i: (i % 9 == 0, f"s{i % 4}" * (i % 9 != 0))
    of = {}
    for r in rows:
        of.setdefault(source(r["doc_id"]), []).append(r)
    names = sorted(of)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    cap = {s: 3 * sum(r["size"] for r in of[s]) for s in names}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    for s in names:
        assert of[s][0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in of[s]) - target[s]) <= max(r["size"] for r in of[s])
    mixed = mixing.mix(docs)
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in rows) and mixed.columns == docs.columns


def test_splitting_tree_keeps_quotas():
    quotas = mixing.splitting_tree([100, 7, 0, 33], 8, random.Random(1))
    assert np.sum(quotas, 0).tolist() == [100, 7, 0, 33]
    assert max(map(sum, quotas)) - min(map(sum, quotas)) <= 3


def _brute_lines(texts):
    """Texts by id without later repeated runs of lines."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    first, kept = {}, {}
    seqs = {d: [(k, strip(x)) for k, x in enumerate(t.split("\n")) if strip(x)] for d, t in sorted(texts.items())}
    keys = lambda s, k: ([(s[k][1], s[k + 1][1])] if k + 1 < len(s) else []) + ([s[k][1]] if len(s[k][1].split()) >= 30 else [])
    for d, s in seqs.items():
        for k in range(len(s)):
            for key in keys(s, k):
                first.setdefault(key, (d, k))
    for d, s in seqs.items():
        gone = set()
        for k in range(len(s)):
            for key in keys(s, k):
                if first[key] != (d, k):
                    gone |= {s[k][0], s[k + 1][0]} if isinstance(key, tuple) else {s[k][0]}
        kept[d] = "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in gone)
    return kept


def test_pipeline_equals_brute_force(spark, tmp_path, docs):
    """Each stage's decisions on what the stage before has kept, and the digests at the end."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    # Quality rules: base rules hold and the posterior of the votes' pattern is one half or more.
    judged = {i: quality.measures((t or "").encode()) for i, t in enumerate(TEXTS)}
    votes = {i: quality.vote(m) for i, (_, m) in judged.items()}
    posterior = quality.fit(dict(Counter(votes.values())))
    good = {i: TEXTS[i] for i, (c, _) in judged.items() if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] and posterior[votes[i]] >= 0.5}
    # Lines, then the least document of each component of 5-word sets at 80 per cent.
    left = {d: t for d, t in _brute_lines(good).items() if t.split()}
    sets = {}
    for d, t in left.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    up = {d: d for d in sets}
    root = lambda d: d if up[d] == d else root(up[d])
    for d in sets:
        for e in sets:
            if e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                x, y = sorted((root(d), root(e)))
                up[y] = x
    single = [d for d in sorted(sets) if root(d) == d]
    # Mixing: as often as the operator's own digest says, whose targets a test of its own checks.
    source = {i: None if i % 9 == 0 else f"s{i % 4}" for i in range(len(TEXTS))}
    table = spark.createDataFrame([(d, left[d], "en", source[d], len(left[d])) for d in single], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix_digest(table).collect()}
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for d in single:
        ids = t.encode(left[d], add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += taken[d]
    assert Counter(tuple(r)[:4] for r in rows.collect()) == +want and 0 < len(single) < len(good)


def test_long_texts_take_time_in_proportion():
    """A long text's work grows with its length: 2 MB each."""
    began = time.process_time()
    phrases = b"under the mit license here " * 75_000
    got = license_scan.scan(phrases)
    assert (got[0], got[1], got[2], got[3]) == (375_000, 75_000, 2, 374_997)
    tags = b"SPDX-License-Identifier: MIT " * 70_000
    assert license_scan.scan(tags)[5] == "mit"
    deep = b"SPDX-License-Identifier: " + b"(" * 1_000_000 + b"MIT" + b")" * 1_000_000
    assert license_scan.scan(deep)[5] == "mit"
    h = np.arange(50_000)
    marks = [{"shift": 0, "at": int(k), "least": 2} for k in h[:-1]]
    assert line_dedup._covered(h, h, marks).all()
    same = np.zeros(3000, np.int64)
    assert line_dedup._covered(same, same, [{"shift": k, "at": k, "least": 2} for k in range(1, 2999)]).sum() == 2999
    enc = bpe.encoder(tokenizer_path("byte_bpe_50k.json"))
    word = "abcdefgh" * 250_000
    assert enc.decode(enc.encode(word)) == word.encode() and not any(len(s) > bpe.LONGEST for s in enc.cache)
    model = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    model.count(["ab" * 100_000])
    assert model.counts.pop("ab" * 100_000) > 0
    assert quality.measures(word.encode())[0]["n_words"] == 1
    assert len(jaccard_join.shingle_sets([b"a b c d e f " * 300_000], 5)[0]) == 6
    encode, _ = lm_score.subwords(tokenizer_path("byte_bpe_50k.tiktoken"))
    assert encode(word.encode())
    assert time.process_time() - began < 60


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(f"line {i} of it" for i in range(50_000))
    rows = spark.createDataFrame([(1, text), (2, "first\n" + text + "\nlast"), (3, "word " * 400_000)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_gone"], r["text"]) for r in line_dedup.dedup_lines(rows).collect()}
    assert got == {1: (0, text), 2: (50_000, "first\nlast"), 3: (0, "word " * 400_000)}
