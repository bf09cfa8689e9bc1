"""BPE, packing, n-gram join and decontamination against plain brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from econcheck.llm import bpe, components, core, decontaminate, ngram_join, packing

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [None, "", " ", "\n\n  \t", "a", "don't we'll I'D", "naïve Ñandú straße", "中文 and ελληνικά 12½ Ⅷ", "a\x1cb  \x1d c", "<|endoftext|>", "x" * 5000, "ab!?" * 900, "the quick brown fox " * 3000, "tail  \n "]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def theirs(text):
    return np.array(THEIRS.encode_ordinary(text or ""), dtype="<u4").tobytes()


def test_round_trip_equals_library(docs_of):
    docs = docs_of(*enumerate(ODD), (3, "a"), (3, "a"), (None, "null id"))
    out = bpe.round_trip(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, keep=True).collect()
    assert len(out) == len(ODD) + 3
    for r in out:
        ids = theirs(r.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_encode_keeps_other_columns_and_replaces_its_own(docs_of):
    out = bpe.encode_texts(docs_of((1, "one two"), (2, None)), RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in out.collect()}
    assert bytes(got[1].ids) == theirs("one two") and bytes(got[2].ids) == b"" and got[1].score == "x"
    assert bpe.encode_texts(docs_of().where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_higher_order_fold_and_decoding(llm):
    rng = random.Random(3)
    words = ["", "a", " the", "ing", "é", "中文", " theorem's", *("".join(rng.choices("etaoinshrdlu é", k=rng.randint(1, 14))) for _ in range(150))]
    pieces = llm.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", bpe.merge_words(F.col("w"), RANKS).alias("p"))
    for w, p in pieces.collect():
        if w is None:
            assert p is None
            continue
        own = bpe.Words(RANKS)
        ids = np.frombuffer(own.encode([[w]])[0], dtype="<u4") if w else []
        assert [RANKS[bytes(x)] for x in p] == list(ids)
    back = pieces.where("w is not null").select("w", F.transform("p", lambda x: F.length(x)).alias("n"))
    assert back.count() == len(words)
    text = "decode me, naïve fox"
    ids = np.frombuffer(theirs(text), dtype="<u4").tolist()
    got = llm.createDataFrame([(ids,), ([],), ([10**6],)], "ids array<int>").select(bpe.decode_ids(F.col("ids"), RANKS).alias("t")).collect()
    assert bytes(got[0].t).decode() == text and bytes(got[1].t) == b"" and got[2].t is None


def test_words_held_are_bounded_and_those_in_use_stay(monkeypatch):
    assert bpe.WORDS_HELD * 160 < 1 << 26  # bytes of a worker
    monkeypatch.setattr(bpe, "WORDS_HELD", 200)
    own, folds, most = bpe.Words(RANKS), Counter(), 0
    learn = own._learn
    own._learn = lambda words: (folds.update(words), learn(words))
    for k in UPPER + LOWER:
        lists = [["xqzvik", f"qvx{k}zkw{j}"] for j in LOWER]
        assert own.encode(lists) == [theirs(a) + theirs(b) for a, b in lists]
        most = max(most, len(own) + len(own.older))
    assert folds["xqzvik"] == 1
    assert most <= 200 + 27



@pytest.mark.parametrize("capacity", [16, 64])
def test_packing_is_lossless_and_full(docs_of, capacity):
    rng = random.Random(5)
    texts = [t for t in ODD if t is None or len(t) < 4000] + ["w" * rng.randint(0, 200) for _ in range(200)]
    docs = docs_of(*enumerate(texts))
    packed = packing.pack_bytes(docs, capacity=capacity, group_tokens=1024)
    rows = packed.collect()
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == capacity and not ids[r.n_tokens :].any() and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == r.n_segments == len(r.parts)
        for d, p, i, j in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, {})[p] = ids[i:j]
    for d, t in enumerate(texts):
        v = np.concatenate([parts[d][p] for p in sorted(parts[d])])
        assert v[-1] == packing.EOS and (v[:-1] - packing.FIRST).astype(np.uint8).tobytes() == (t or "").encode()
    assert len({(r.grp, r.row) for r in rows}) == len(rows)


def test_packing_written_and_read(llm, docs_of, tmp_path):
    docs = docs_of(*((i, t) for i, t in enumerate(ODD) if t))
    packing.write_matrices(packing.pack_bytes(docs, capacity=128), str(tmp_path / "m"))
    got = {r.doc_id: r.text for r in packing.read_texts(llm, str(tmp_path / "m")).collect()}
    assert got == {i: t for i, t in enumerate(ODD) if t}


def test_packing_empty_and_repeated(docs_of):
    assert packing.pack_bytes(docs_of().where("false")).count() == 0
    rows = packing.pack_bytes(docs_of(*[(7, "same")] * 50, (None, "x")), capacity=32, group_tokens=64).collect()
    assert sorted(str(d) for r in rows for d in r.doc_ids) == ["7"] * 50 + ["None"]


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(2)
    for capacity in (7, 32, 100):
        sizes = sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True)
        rooms = []
        for n in sizes:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(capacity - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    rows = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            o = len(s & t)
            if s and t and 100 * o >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(LOWER, k=4)) for _ in range(400)]
    common = rng.choices(vocabulary, k=25)
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(5, 90)) + (common if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_equal_brute_force(docs_of, seed):
    texts = near_copies(seed, 40, 9) + [None, "", "  ", "one two", "ONE two", "one two three", "Ä b", "ä b"]
    random.Random(seed).shuffle(texts)
    rows = list(enumerate(texts))
    got = ngram_join.ngram_components(docs_of(*rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingles(t)) for d, t in rows}


def test_ngram_large_group_of_near_copies(docs_of):
    # every copy differs from every other; some chains hold together only through others
    rng = random.Random(8)
    base = ["".join(rng.choices(LOWER, k=5)) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in range(i // 10):
            w[(7 * j + i) % 120] = f"v{i % 10}x{j}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_components(docs_of(*rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_ngram_repeated_and_null_ids(docs_of):
    a, b = "p q r s t u v w", "k l m n o p q r s"
    got = ngram_join.ngram_components(docs_of((5, a), (5, b), (3, a), (9, b), (None, a), (None, None), (5, a))).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("5", "3")] * 3 + [("3", "3"), ("9", "3"), ("None", "None"), ("None", "None")])
    assert ngram_join.ngram_components(docs_of().where("false")).count() == 0


def test_components_of_chains(llm):
    ngram_join.written(llm.range(1))  # names a checkpoint folder where none is set
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r.id: r.component for r in components.components(llm.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100}


def brute_tiling(doc, item, seed):
    """Coverage of the item by longest-first tiling, all positions compared."""
    ud, ui, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = []
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and not ui[i + k] and not ud[d + k]:
                    k += 1
                if k >= seed:
                    best.append((-k, i, d))
        if not best:
            return covered
        k, i, d = min(best)
        for j in range(-k):
            ui[i + j] = ud[d + j] = True
        covered -= k


def test_tiling_equals_plain_tiling():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item = rng.integers(0, 6, rng.integers(4, 30)).astype(np.uint64)
        doc = rng.integers(0, 6, rng.integers(0, 60)).astype(np.uint64)
        tiles = decontaminate.tile(doc, np.arange(len(doc)), item, 3)
        assert sum(t[2] for t in tiles) == brute_tiling(doc.tolist(), item.tolist(), 3)


def test_contaminated_documents(llm, docs_of):
    rng = random.Random(6)
    word = ["".join(rng.choices(LOWER, k=rng.randint(2, 8))) for _ in range(300)]
    items = [rng.choices(word, k=24) for _ in range(4)]
    noise = lambda n: rng.choices(word, k=n)
    text = {
        1: noise(50) + items[0] + noise(50),
        2: noise(20) + items[1][12:] + noise(9) + items[1][:12] + noise(20),  # reordered
        3: [w.upper() + "," for w in items[2]],
        4: noise(400),
        5: noise(10) + items[3][:9] + noise(10),  # less than the threshold
        6: items[0] + items[2],
    }
    rows = [(k, " ".join(v)) for k, v in text.items()] + [(7, None), (8, ""), (6, " ".join(text[6])), (None, " ".join(items[0]))]
    bench = llm.createDataFrame([(i, " ".join(v)) for i, v in enumerate(items)] + [(9, None), (10, "too short"), (0, " ".join(items[0]))], "item_id long, text string")
    got = decontaminate.contaminated(docs_of(*rows), bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 0), ("2", 1), ("3", 2), ("6", 0), ("6", 2), ("None", 0)]
    assert {r.n_tiles for r in got if r.doc_id == 2} == {2}
    kept = decontaminate.clean(docs_of(*rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "7", "8", "None"] and kept.columns == docs_of(*rows).columns
    assert decontaminate.contaminated(docs_of(*rows), bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs_of().where("false"), bench).count() == 0


def test_contaminated_by_items_that_repeat_themselves(llm, docs_of):
    rng = random.Random(9)
    word = ["".join(rng.choices(LOWER, k=5)) for _ in range(200)]
    items = [["la"] * 20, word[:3] * 9, word[10:15] * 8, ["row", "1", "of", "9"] * 6 + word[20:24], word[30:50]]
    text = [v for item in items for v in (item, word[60:90] + item + word[90:99], item[len(item) // 2 :] + word[99:120] + item[: len(item) // 2], item[: len(item) // 2], item[: len(item) // 4] + word[120:140])]
    text += [["la"] * 3000, word[:3] * 500, word[10:15] * 3 + ["x"] + word[10:15] * 3]
    bench = llm.createDataFrame([(i, " ".join(v)) for i, v in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(docs_of(*((d, " ".join(v)) for d, v in enumerate(text))), bench).collect()}
    share = {(d, i): brute_tiling(v[:200], item, 4) / len(item) for d, v in enumerate(text) for i, item in enumerate(items)}
    assert got == {pair: x for pair, x in share.items() if x >= 0.6} and {(d, d // 5) for d in range(0, 25, 5)} <= set(got)


def test_contaminated_in_any_script_and_by_short_items(llm, docs_of):
    chinese, thai = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65", "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35\u0e21\u0e32\u0e01"
    items = [chinese, thai, 'one "two" three - four five: \'six\' seven', "Alpha beta", "L'\u00e9t\u00e9", "omega", "\u2026 \u2014", None]
    text = {
        1: "\u6211\u8bf4" + chinese + "\u3002\u518d\u89c1",
        2: "x" + thai + "y",
        3: "one \u201ctwo\u201d\u00a0three\u2014four\u00a0five: \u2018six\u2019 seven",
        4: "see ALPHA\u2014beta here",
        5: "alpha, gamma, beta",
        6: "dans l\u2019\u00c9t\u00e9",
        7: "omegas and so on, \u4eca\u5929",
        8: "Omega",
        9: chinese[:3] + "!" + chinese[5:8],
        10: "\u2026 \u2014",
    }
    bench = llm.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(docs_of(*text.items()), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in got) == [(1, 0, 1.0, 1), (2, 1, 1.0, 1), (3, 2, 1.0, 1), (4, 3, 1.0, 1), (6, 4, 1.0, 1), (8, 5, 1.0, 1)]


def test_tiling_of_one_repeated_word_stays_small():
    import tracemalloc

    tracemalloc.start()
    assert decontaminate.tile(np.ones(5000, dtype=np.uint64), np.arange(5000), np.ones(200, dtype=np.uint64), 4) == [(0, 0, 200)]
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_words_and_hashes_do_not_depend_on_the_run():
    import pyarrow as pa

    texts = ["One two  THREE", None, "", "four\tfive", "é É one"]
    seen = []
    for limit in (1, 8, 1 << 20):
        found = []
        for _, m, data, off in ((lo, hi - lo, d, o) for lo, hi, d, o in core.runs(pa.array(texts), limit)):
            s, e, doc = core.spans(data, off)
            h = core.word_hashes(data, s, e)
            found += [h[doc == i].tolist() for i in range(m)]
        seen.append(found)
    assert seen[0] == seen[1] == seen[2] and [len(x) for x in seen[0]] == [3, 0, 0, 2, 3] and seen[0][0][0] == seen[0][4][2]


def test_signatures_never_lose_a_link():
    """Pairs just above the threshold always have room; most pairs well below it have none."""
    rng = np.random.default_rng(11)
    far = 0
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 60, size, dtype=np.uint64))
        for share in (1.0, 0.86, 0.75, 0.5, 0.0):
            kept = a[: int(np.ceil(len(a) * share))]
            b = np.unique(np.concatenate((kept, rng.integers(0, 1 << 60, int(rng.integers(0, max(1, size // 5))), dtype=np.uint64))))
            if not len(b):
                continue
            sig = np.stack([np.frombuffer(ngram_join._signature(s), dtype=np.uint64) for s in (a, b)])
            ok = ngram_join._room(np.array([len(a), len(b)]), sig, np.array([0]), np.array([1]), 75)[0]
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 75 * (len(a) + len(b) - both)
            assert ok or not linked
            far += 100 * both < 55 * (len(a) + len(b) - both) and not ok
    assert far > 400


def test_unlinked_near_copies_are_not_listed(llm, monkeypatch):
    """A large group that shares a passage, with no link inside it, emits fewer rows than it has holders."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = llm.createDataFrame([(i, passage + " " + " ".join(f"{i}x{rng.random()}" for _ in range(60))) for i in range(400)], "doc_id long, text string")
    seen = []
    real = ngram_join._across

    def counted(shared, percent):
        out = real(shared, percent)
        seen.append((shared.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_across", counted)
    got = ngram_join.ngram_components(docs).collect()
    assert all(r.doc_id == r.component_id for r in got) and len(got) == 400
    assert all(listed <= holders for holders, listed in seen)


def test_pairs_are_listed_about_once(llm, monkeypatch):
    """Sets just below the threshold share many prefix shingles; a pair is not listed for each of them."""
    passage = " ".join(f"p{i}" for i in range(460))
    docs = llm.createDataFrame([(i, passage + " " + " ".join(f"{i}x{j}" for j in range(80))) for i in range(20)], "doc_id long, text string")
    seen = []
    real = ngram_join._across

    def counted(shared, percent):
        out = real(shared, percent)
        seen.append((out.count(), out.select("a", "b").distinct().count()))
        return out

    monkeypatch.setattr(ngram_join, "_across", counted)
    got = ngram_join.ngram_components(docs).collect()
    assert all(r.doc_id == r.component_id for r in got) and len(got) == 20
    assert seen and all(pairs == 190 and listed <= 3 * pairs for listed, pairs in seen)


def test_ngram_components_with_small_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 50)
    monkeypatch.setattr(ngram_join, "BUCKET_HOLDERS", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rng = random.Random(9)
    base = ["".join(rng.choices(LOWER, k=5)) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i // 6):
            w[(7 * j + i) % 120] = f"v{i % 10}x{j}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_components(docs_of(*rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
