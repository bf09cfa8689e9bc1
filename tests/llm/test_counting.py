"""Centroid clustering, phrase mining and token counts against plain versions and the tokenizer library."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from econcheck.llm import centroids, core, phrases, token_count

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, distance string"


# --- centroid clustering ---------------------------------------------------------------


def plain_clusters(rows, size, k, rounds, seed=3):
    """The contract in Python integers; rows of (id, vector)."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cent = [v for _, v in key[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cent]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(cent)):
            mine = [v for _, v, own, _ in at if own == c]
            if mine:
                cent[c] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign() if cent else []
    total = Counter()
    for _, _, c, d in at:
        total[c] += d

    def long(x):
        return x if x < 1 << 63 else None

    return sorted(((i, c, long(d), long(total[c]), long(sum(total.values())), hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, _, c, d in at), key=str)


def clusters(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_vectors(n, size, rng, scale=1.0):
    return [(i, [rng.gauss(0, scale) for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("n,size,k,rounds", [(300, 4, 5, 10), (40, 64, 8, 3), (3, 4, 8, 10), (1, 2, 8, 2)])
def test_clusters_equal_plain(llm, n, size, k, rounds):
    rows = some_vectors(n, size, random.Random(n))
    df = llm.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)
    assert clusters(centroids.cluster_vectors(df.repartition(5), size, k, rounds)) == plain_clusters(rows, size, k, rounds)


def test_clusters_of_odd_rows(llm):
    """Ties, repeated rows, null ids, other lengths, nulls and non-finite components."""
    rng = random.Random(1)
    rows = some_vectors(60, 3, rng)
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(200 + i, [float(i % 2), 0.0, -0.5]) for i in range(40)]
    rows += [(300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, None, 2.0]), (304, [1.0, float("nan"), 2.0]), (305, [float("inf"), 0.0, 0.0]), (306, [1.0] * 4)]
    df = llm.createDataFrame([(i, v, None, None, None) for i, v in rows], VECTORS)
    assert clusters(centroids.cluster_vectors(df, 3, 6, 7)) == plain_clusters(rows, 3, 6, 7)
    assert centroids.cluster_vectors(df.where("false"), 3).collect() == []
    assert centroids.cluster_vectors(df.where("vec_id is null"), 3).collect() == []


def test_clusters_of_far_vectors_stay_exact(llm):
    rng = random.Random(2)
    rows = some_vectors(30, 2, rng) + [(100 + i, [rng.gauss(0, 1e9), rng.gauss(0, 1e9)]) for i in range(20)] + [(200, [1.5e307, -1.5e307]), (201, [1e308, 0.0]), (202, [5e-324, -5e-324])]
    df = llm.createDataFrame([(i, v, 0, "", "") for i, v in rows], VECTORS)
    assert clusters(centroids.cluster_vectors(df, 2, 4, 5)) == plain_clusters(rows, 2, 4, 5)


def test_table_of_a_block_equals_direct_distances():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8)).round(2)
    b = centroids.Block.of(np.arange(500), np.ones(500, dtype=bool), x, 1024)
    cent = [[int(v) for v in rng.integers(-2000, 2000, 8)] for _ in range(5)]
    again = centroids.Block.read(b.row())
    ints = np.floor(x * 1024).astype(np.int64)
    direct = ((ints[:, None, :] - np.array(cent)[None]) ** 2).sum(2)
    for block in (b, again):
        cluster, distance = block.nearest(cent, 1024)
        assert (cluster == direct.argmin(1)).all() and (distance == direct.min(1)).all()
    for c, n, sums in b.sums(direct.argmin(1), 5, 1024):
        assert n == (direct.argmin(1) == c).sum() and sums == ints[direct.argmin(1) == c].sum(0).tolist()


# --- phrase mining ---------------------------------------------------------------------


def plain_phrases(rows, least, top=2000, share=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang, low = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q) - len(w) + 1)) and 100 * b >= share * a for q, b in cand.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def mined(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def chatter(rng, n, words="a b c the of New york state x é Ünder 中 don't"):
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!", "\x0b", " ", "\x1c"]
    return "".join(rng.choice(words.split()) + rng.choice(marks) for _ in range(n))


@pytest.mark.parametrize("least,parts", [(10, None), (3, 1), (2, 5)])
def test_phrases_equal_plain(docs_of, least, parts):
    rng = random.Random(least)
    rows = [(chatter(rng, rng.randint(0, 120)), rng.choice(["en", "de", None])) for _ in range(60)] + [(None, "en"), ("", "en"), (" .,; \n", "fr"), ("the the the the", "en"), ("lone", "")]
    df = docs_of(*((i % 50, t, lang) for i, (t, lang) in enumerate(rows)), (None, rows[0][0], rows[0][1]))
    rows.append(rows[0])
    assert mined(df.repartition(4), least=least, parts=parts) == plain_phrases(rows, least)
    assert mined(df, least=least, top=4) == plain_phrases(rows, least, 4)
    assert mined(df.where("false")) == []


def test_phrases_of_long_texts_are_counted_in_windows(docs_of, monkeypatch):
    """Windows that end at marks, at blanks or, for a word longer than a window, later, lose and repeat nothing."""
    rng = random.Random(9)
    long = chatter(rng, 4000)
    rows = [(long, "en"), (chatter(rng, 3000, "p q r s"), "en"), ("w" * 700 + " a b " + "v" * 900, "en"), (" ".join(rng.choices("ab", k=3000)), "en")]
    for size in (64, 257, 1000):
        monkeypatch.setattr(phrases, "RUN", size)
        counted = Counter()
        for text, _ in rows:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            for window in phrases._windows(data, np.array([0, len(data)]), 3):
                run = phrases.Runs(*window, 3)
                for k, (keys, c) in enumerate(run.counted, 1):
                    for p, x in zip(run.phrases(k, keys).to_pylist(), c.tolist()):
                        counted[p] += x
                counted[""] += run.n
        monkeypatch.undo()
        whole = Counter()
        for text, _ in rows:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            run = phrases.Runs(data, np.array([0, len(data)]), 0, 3)
            for k, (keys, c) in enumerate(run.counted, 1):
                for p, x in zip(run.phrases(k, keys).to_pylist(), c.tolist()):
                    whole[p] += x
            whole[""] += run.n
        assert counted == whole
    assert mined(docs_of(*((i, t, lang) for i, (t, lang) in enumerate(rows)))) == plain_phrases(rows, 10)


def test_summary_keeps_every_frequent_key():
    """Small capacities force cuts; merged in any order, no key with the threshold's mass is lost."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        keys = core.mix(rng.zipf(1.3, 6000).clip(max=4000).astype(np.uint64))
        least = int(rng.integers(5, 60))
        summary = phrases.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, 40):
            k, c = np.unique(part, return_counts=True)
            summary.merge(k, c.astype(np.int64))
            summary._settle()
        k, c = np.unique(keys, return_counts=True)
        assert summary.taken < least and np.isin(k[c >= least], summary.frequent(least)).all()
        assert len(summary.keys) <= summary.capacity


def test_scores_pass_64_bits(llm):
    """Counts of 10^11 need products of 28 digits; the score is their exact floor."""
    counts = [("en", "a", 1, 10**11 + 7), ("en", "b", 1, 3 * 10**11 + 1), ("en", "a b", 2, 10**11 - 3), ("en", "", 0, 10**12)]
    df = llm.createDataFrame(counts, "lang string, phrase string, words int, f long")
    keep = phrases.phrase_counts
    phrases.phrase_counts = lambda *a, **b: df
    try:
        got = [tuple(r) for r in phrases.collocations(None).collect()]
    finally:
        phrases.phrase_counts = keep
    a, l, r = 10**11 - 3, 10**11 + 7, 3 * 10**11 + 1
    assert got == [("en", 1, "a b", a, l, r, 10**12, 10**6 * a * a // (l * r))]


# --- token counts ----------------------------------------------------------------------

ODD = [
    None, "", " ", "  ", " " * 40 + "x", "▁", "a▁b", "▁" * 33 + "the", "中文 and ελληνικά 12½ Ⅷ", "\x00\x01", "<s> </s> <unk> <0x0A>", "x" * 5000, "ab!?" * 900,
    "😀 𝒳 ​﻿", "é é", "\r\n\t\x0b", "    a   b    c     d" * 20, "=" * 77, "the quick brown fox " * 3000, "tail  \n ", "Ünïcödé ﬁ ½",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_equal_library(docs_of, library):
    rng = random.Random(5)
    letters = "▁ \n\té中=*-/\\()abcdefghijklmnopqrstuvwxyzETAOIN.,;😀ẞ0123"
    pieces = [library.id_to_piece(i) for i in range(300, 32000, 7)]
    texts = [*ODD, *("".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(300)), *("".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(300))]
    rows = [*enumerate(texts), (3, "again"), (3, "again"), (None, "null id")]
    got = token_count.count_tokens(docs_of(*rows), MODEL, limit=100).collect()
    assert got[0].score == "x" and "text" not in got[0].asDict()
    want = sorted((str(i), len((t or "").encode()), n, n > 100) for i, t in rows for n in [len(library.encode(t or ""))])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_count.count_tokens(docs_of().where("false"), MODEL).count() == 0


def test_token_counts_replace_columns_of_their_name(llm, library):
    df = llm.createDataFrame([("old", "two words", 1.5, 7)], "n_tokens string, text string, over_limit double, k int")
    (r,) = token_count.count_tokens(df, MODEL).collect()
    assert (r.k, r.n_bytes, r.n_tokens, r.over_limit) == (7, 9, len(library.encode("two words")), False)


def test_store_of_counts_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_count, "HELD_CHARS", 600)
    with open(MODEL, "rb") as f:
        own = token_count.Vocabulary(f.read())
    rng = random.Random(8)
    for _ in range(40):
        text = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 300))) for _ in range(10))
        assert own.count(text) == len(library.encode(text))
        assert own.held_chars == sum(map(len, own.held)) <= 600
