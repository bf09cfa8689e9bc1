"""Classifiers by held-out accuracy; WARC by round trip; URL rules and neighbours by brute force."""

import base64
import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from econcheck.llm import ann, langid, quality, toxicity, url_rules, warc
from econcheck.llm.samples import by_class, remainder

SYLLABLES = {"en": "th er on an re he in ed nd ha at en", "de": "ch ei sch ung en der ver zu ge lich heit", "fr": "eau ou qu en es oi ai ment tion re", "es": "cion ar os ado ez mente que ll do as"}


def invented(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    langs = list(SYLLABLES)
    return [(i, invented(rng, langs[i % 4], rng.randint(3, 120)), langs[i % 4]) for i in range(400)]


def test_languages_held_out(docs_of, corpus):
    rows = [*corpus, (1000, None, "en"), (1001, "", "fr"), (1002, "123 !? 77", "de"), (1003, corpus[0][1], None), (None, corpus[1][1], "de"), (1004, "the " * 20_000, "en")]
    out = langid.predict_languages(docs_of(*rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    held = [r for r in corpus if crc(r[0], 4) == 2]
    assert all(got[r[0]].held_out == (crc(r[0], 4) == 2) for r in corpus) and not got[None].held_out
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == corpus[0][2] and all(0 <= r.score <= 1 for r in out)


def test_languages_without_examples(docs_of, corpus):
    out = langid.predict_languages(docs_of((1, "some text", None), (2, None, None))).collect()
    assert {r.lang_pred for r in out} == {"und"}
    assert langid.predict_languages(docs_of().where("false")).count() == 0
    one = langid.predict_languages(docs_of(*[r for r in corpus if r[2] == "de"])).collect()
    assert {r.lang_pred for r in one} == {"de"}
    kept = langid.identify(docs_of(*corpus[:3]), None)
    assert kept.columns[-2:] == ["lang_pred", "score"] and kept.columns.count("score") == 1 and {r.n for r in kept.collect()} == {3}


def test_samples_are_bounded_and_repeatable(llm):
    rows = llm.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    a, b = (sorted(r.doc_id for r in by_class(rows.repartition(n), "y", 100).collect()) for n in (1, 7))
    assert a == b and 120 < len(a) <= 400
    assert by_class(rows.where("false"), "y", 10).count() == 0
    assert [r[0] for r in llm.createDataFrame([(7,), (None,)], "d long").select(remainder(F.col("d"), 5)).collect()] == [crc(7, 5), None]


def test_quality_held_out(llm, docs_of, corpus):
    rng = random.Random(3)
    spoil = [lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in t.split()), lambda t: " ".join([t.split()[0]] * 30), lambda t: " | ".join(t.split())]
    rows = [(i, spoil[i % 4](t) if i % 3 == 0 else t) for i, t, _ in corpus] + [(1000, None), (1001, ""), (None, "the end")]
    labels = llm.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)] + [(2, None, 0), (1000, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.predict_quality(docs_of(*rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert held and all(crc(r.doc_id, 5) == 0 for r in held)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.93 * len(held)
    _, rules = quality.fit_quality(docs_of(*rows), labels)
    assert 0 < len(rules) < 120
    none = quality.predict_quality(docs_of(*rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.predict_quality(docs_of().where("false"), labels).count() == 0


def test_quality_rules_compiled_equal_arrays(docs_of, corpus):
    model = (0.3, [(((0, True, 2.0),), 1.5), (((1, False, 6.0), (8, True, 0.5)), -2.0)])
    rows = quality.with_statistics(docs_of(*corpus[:40])).withColumn("p", quality.compiled(*model)).collect()
    for r in rows:
        x = np.array([[r[s] for s in quality.STATS]])
        z = model[0] + sum(w * quality._holds(x, rule)[0] for rule, w in model[1])
        assert abs(r.p - 1 / (1 + np.exp(-z))) < 1e-12


def test_toxicity_held_out_and_located(llm, docs_of):
    rng = random.Random(9)
    bad = ["idiota", "scumbag", "trashy"]
    rows, labels = [], []
    for i in range(500):
        sentences = [invented(rng, "en", rng.randint(4, 12)) for _ in range(rng.randint(1, 15))]
        if i % 4 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(bad) + " you"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, "plain words. some scumbag you.")]
    table = llm.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.predict_toxicity(docs_of(*rows), table).collect()
    got = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert len(out) == len(rows) and sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    text = dict(rows)
    for r in held:
        if r.predicted and r.doc_id % 4 == 0:
            raw = text[r.doc_id].encode()
            assert any(w in raw[o.start : o.end].decode() for o in r.offending for w in bad)
    assert all((got[i].score, got[i].predicted, got[i].offending) == (0.0, 0, []) for i in (1000, 1001, 1002))
    assert got[None].predicted == 1 and not got[None].held_out
    assert toxicity.predict_toxicity(docs_of().where("false"), table).count() == 0
    none = toxicity.predict_toxicity(docs_of(*rows), table.where("false")).collect()
    assert len(none) == len(rows) and all(0 <= r.score < 0.5 for r in none)


def brute_rule(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.b.net", "/", "allow"), ("b.net", "/es/x", "block")]


@pytest.mark.parametrize("rules", [RULES, [*RULES, ("", "/", "block")], []])
def test_url_rules_equal_brute_force(llm, rules):
    rng = random.Random(1)
    labels = ["www", "example", "com", "net", "org", "a", "b", "xcom", "EXAMPLE", "é"]
    urls = [f"{rng.choice(['http', 'https'])}://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}{rng.choice(['', '/', '/en/', '/en/1?q=://x', '/es/x#f', '/fr/', '?a', '#b', '/EN/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "x://://y", "http://www.example.com/en/\nline", urls[0], urls[0], "http://example.com.", "http://.com/"]
    pages = llm.createDataFrame([(i, u, "h", "k", "s") for i, u in enumerate(urls)], "page_id long, url string, key string, stack string, rule string")
    got = url_rules.judge_urls(pages, llm.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(urls[r.page_id], rules), urls[r.page_id]
    assert url_rules.judge_urls(pages.where("false"), llm.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_warc_round_trip(llm, tmp_path):
    tricky = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n"
    pages = [(5, "http://a/1", "same"), (2, "http://a/2\r\nX-Evil: 1", "same"), (9, None, "same"), (1, "u", None), (3, "u", ""), (4, "é", tricky), (6, "u", "größe"), (6, "u", "other"), (7, "u", tricky), (8, "u", "WARC/1.1\r\n" * 50), (5, "http://a/1", "same"), (None, "n", "null id"), (10, "big", "x" * 300_000)]
    df = llm.createDataFrame([(*p, "t", "d") for p in pages], "page_id long, url string, html string, digest string, size string")
    warc.write_archives(df, str(tmp_path / "w"), records_per_file=4)
    out = warc.read_archives(llm, str(tmp_path / "w")).collect()
    assert len(out) == len(pages) and all(r.sound for r in out)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, b"" if again else raw))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.size, r.digest, r.kind, r.refers_to, bytes(r.payload))) for r in out)


def test_warc_threshold_empty_and_broken(llm, tmp_path):
    df = llm.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "t"), min_bytes=5)
    got = {r.page_id: (r.kind, r.refers_to) for r in warc.read_archives(llm, str(tmp_path / "t"), payload=False).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    warc.write_archives(df.where("false"), str(tmp_path / "e"))
    assert warc.read_archives(llm, str(tmp_path / "e")).count() == 0
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    os.makedirs(tmp_path / "b")
    (tmp_path / "b" / "one.warc").write_bytes(record + record + b"junk" + record)  # the chain breaks at the junk
    (tmp_path / "b" / "two.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))  # a member for each record
    (tmp_path / "b" / "three.warc").write_bytes(b"not a warc file" + record)
    got = [os.path.basename(r.file) for r in warc.read_archives(llm, str(tmp_path / "b")).collect()]
    assert sorted(got) == ["one.warc"] * 2 + ["two.warc.gz"] * 2


def test_digest_expression(llm):
    got = llm.createDataFrame([("",), ("abc",), ("é" * 999,)], "t string").select("t", warc.sha1_base32(F.col("t").cast("binary")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)


def brute_neighbours(ids, x, k):
    best = {}
    for i, v in zip(ids, x):
        if i % 20:
            continue
        score = {}
        for j, w in zip(ids, x):
            if j != i:
                score[j] = max(score.get(j, -np.inf), float(v @ w))
        best[i] = sorted(score.items(), key=lambda t: (-t[1], t[0]))[:k]
    return best


def test_neighbours_small_and_odd(llm):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (60, 4)).astype(np.float32)
    x[(x == 0).all(1)] = 1
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    odd = [(100, None, 0, 1), (120, [0.0] * 4, 0, 1), (140, [1.0, float("nan"), 0.0, 0.0], 0, 1), (160, [float("inf"), 0.0, 0.0, 1.0], 0, 1), (180, [1.0, None, 0.0, 0.0], 0, 1), (200, [1.0], 0, 1), (220, [], 0, 1), (None, [1.0, 1.0, 1.0, 1.0], 0, 1), rows[20]]
    df = llm.createDataFrame(rows + odd, "vec_id long, embedding array<float>, list int, score int")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_neighbours(range(60), x.astype(float), 5)
    assert got == {q: [(n + 1, j, s) for n, (j, s) in enumerate(v)] for q, v in want.items()}
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    assert ann.nearest(df.where("false"), df.where("false")).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.nearest(df.where("false"), df).count() == 0


def test_neighbours_recall(llm):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 24)) * rng.uniform(0.5, 2, (6000, 1))
    x[3000:4500] = x[17] + 0.05 * rng.normal(size=(1500, 24))  # a dense spot
    x = x.astype(np.float32)
    df = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    d = x.astype(float)
    hits = 0
    for q in range(0, 6000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        true = np.lexsort((np.arange(6000), -s))[:20]
        assert len(got[q]) == 20 and all(abs(s[j] - v) < 1e-9 for j, v in got[q].items())
        hits += sum(int(j) in got[q] for j in true)
    assert hits / (300 * 20) >= 0.9
