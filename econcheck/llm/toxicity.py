"""Toxicity by multiple-instance learning: documents carry the labels, sentences the scores.

A sentence's chance is a logistic function of its words (hashed). A document is toxic if any
sentence is: its chance is the noisy-or of its sentences. The weights are fitted through that
noisy-or from document labels alone, and the sentence scores then say where the offence is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from econcheck.llm import core
from econcheck.llm.samples import by_class, remainder

BUCKETS = 1 << 18
PER_CLASS = 4_000
EVIDENCE = 15.0
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 13, 33, 46, 63]] = True  # line ends and ! . ?


def _instances(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, sentence) of each word; (document, start, end) of each sentence that has words."""
    start, end, doc = core.spans(data, off, core.ALNUM)
    bucket = (core.word_hashes(data, start, end) >> np.uint64(46)).astype(np.int64)
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
    where = breaks[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return bucket, np.cumsum(new) - 1, doc[first], start[first], end[last]


def fit_noisy_or(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rounds: int = 400, lasso: float = 2e-4) -> tuple[float, np.ndarray]:
    """(bias, weight of each bucket) that maximise the likelihood of document labels under the noisy-or.

    ``docs``: (bucket, sentence number) arrays. Only buckets that toxic documents hold
    significantly more often (likelihood ratio of ``EVIDENCE`` or more) can have a weight.
    """
    out = np.zeros(BUCKETS)
    if not len(docs) or not y.any() or y.all():
        return float(np.log((y.mean() if len(y) else 0.5) * 0.02 + 0.001)), out
    held = np.zeros((2, BUCKETS))
    for (b, _), v in zip(docs, y, strict=True):
        held[int(v), np.unique(b)] += 1
    size = np.array([[(y == 0).sum()], [(y == 1).sum()]], dtype=float)
    both = held.sum(0)

    def likelihood(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        share = np.clip(n / m, 1e-12, 1 - 1e-12)
        return n * np.log(share) + (m - n) * np.log1p(-share)

    ratio = 2 * (likelihood(held, size).sum(0) - likelihood(both, size.sum()))
    names = np.flatnonzero((ratio >= EVIDENCE) & (held[1] / size[1] > held[0] / size[0]))
    number = np.full(BUCKETS, -1)
    number[names] = np.arange(len(names))
    word, sent, sent_doc, total = [], [], [], 0
    for d, (b, s) in enumerate(docs):
        if not len(b):
            continue
        ok = number[b] >= 0
        pairs = np.unique(s[ok].astype(np.int64) * max(1, len(names)) + number[b[ok]])
        word.append(pairs % max(1, len(names)))
        sent.append(total + pairs // max(1, len(names)))
        sent_doc.append(np.full(int(s.max()) + 1, d))
        total += int(s.max()) + 1
    if not total:
        return -4.0, out
    word, sent, sent_doc = np.concatenate(word), np.concatenate(sent), np.concatenate(sent_doc)
    weight = weight / weight.sum()
    w, b = np.zeros(len(names)), -5.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for i in range(1, rounds + 1):
        z = np.bincount(sent, weights=w[word], minlength=total) + b
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(sent_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(docs))
        doc_p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d log-likelihood / dz: for a toxic document (1 - P) / P * p, for a clean one -p
        g = p * np.where(y > 0, (1 - doc_p) / doc_p, -1.0)[sent_doc] * weight[sent_doc]
        gw, gb = np.bincount(word, weights=g[sent], minlength=len(names)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 / (1 + i / 100)
        w += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * lasso * 50)
        b += 0.5 * rate * (mb / (1 - 0.9**i)) / (np.sqrt(vb / (1 - 0.99**i)) + 1e-6)
    out[names] = w
    return float(b), out


def fit_toxicity(docs: DataFrame, labels: DataFrame, cap: int = PER_CLASS) -> tuple[float, np.ndarray]:
    """Bias and bucket weights from about ``cap`` labelled documents of each class.

    ``labels(doc_id, toxic)``: null labels are left out, the largest of repeated ones counts.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = by_class(known, "toxic", cap)  # at most 4 * cap ids

    def rows(batches):
        for batch in batches:
            for lo, hi, data, off in core.runs(batch.column(1)):
                bucket, sent, sent_doc, _, _ = _instances(data, off)
                doc = sent_doc[sent] if len(sent) else sent
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                words, numbers = [], []
                for d in range(hi - lo):
                    a, b = cut[d], cut[d + 1]
                    words.append(bucket[a:b].astype("<i4").tobytes())
                    numbers.append((sent[a:b] - (sent[a] if b > a else 0)).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words, pa.binary()), pa.array(numbers, pa.binary())], names=["toxic", "b", "s"])

    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    got = text.mapInArrow(rows, "toxic int, b binary, s binary").toPandas().drop_duplicates(["toxic", "b"]).sort_values(["toxic", "b"])  # copies teach nothing new
    y = got["toxic"].to_numpy().clip(0, 1).astype(float)
    have = {c: max(1, int((got["toxic"] == c).sum())) for c in counts}
    weight = got["toxic"].map({c: counts[c] / have[c] for c in counts}).to_numpy(float)
    return fit_noisy_or([(np.frombuffer(b, "<i4"), np.frombuffer(s, "<i4")) for b, s in zip(got["b"], got["s"], strict=True)], y, weight)


def score_toxicity(docs: DataFrame, model: tuple[float, np.ndarray], cut: float = 0.5, spans: bool = True) -> DataFrame:
    """``docs`` with score, predicted (1 if score >= ``cut``) and offending.

    ``offending`` lists (start, end, score) of each sentence whose own chance reaches ``cut``,
    and of the likeliest one of a document that reaches it only in sum; offsets are bytes of
    the UTF-8 text. Null, empty and wordless texts score 0. Columns of these names are replaced.
    """
    plain = docs.drop("score", "predicted", "offending")
    bias, weights = model
    used = np.flatnonzero(weights)
    held = docs.sparkSession.sparkContext.broadcast((bias, used, weights[used]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def rows(batches):
        bias, used, own = held.value
        table = np.zeros(BUCKETS)
        table[used] = own
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores, offending = [], []
            for lo, hi, data, off in core.runs(batch.column(at)):
                bucket, sent, sent_doc, start, end = _instances(data, off)
                # a word counts once in a sentence
                live = np.flatnonzero(table[bucket])
                pairs = np.unique(sent[live] * BUCKETS + bucket[live])
                z = np.bincount(pairs // BUCKETS, weights=table[pairs % BUCKETS], minlength=len(sent_doc)) + bias
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                none = np.bincount(sent_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=hi - lo)
                total = np.clip(-np.expm1(none), 0, 1)
                scores.append(total)
                if spans:
                    found: dict[int, list[dict]] = {}
                    for s in np.flatnonzero(p >= cut):
                        d = int(sent_doc[s])
                        found.setdefault(d, []).append({"start": int(start[s] - off[d]), "end": int(end[s] - off[d]), "score": float(p[s])})
                    for d in np.flatnonzero(total >= cut):
                        if int(d) not in found:
                            own_s = np.arange(*np.searchsorted(sent_doc, [d, d + 1]))
                            s = int(own_s[p[own_s].argmax()])
                            found[int(d)] = [{"start": int(start[s] - off[d]), "end": int(end[s] - off[d]), "score": float(p[s])}]
                    offending += [found.get(d, []) for d in range(hi - lo)]
                else:
                    offending += [[]] * (hi - lo)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array(offending, span)], names=[*batch.schema.names, "score", "predicted", "offending"])

    kind = T._parse_datatype_string("score double, predicted int, offending array<struct<start: long, end: long, score: double>>")
    return plain.mapInArrow(rows, T.StructType([*plain.schema.fields, *kind.fields]))


def predict_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, cut: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending); learnt from labels whose doc_id has another remainder than ``held``.

    A null doc_id is never learnt from and not held out. Repeated rows come back one for one.
    """
    model = fit_toxicity(docs, labels.where(remainder(F.col("doc_id"), fold) != held))
    named = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), fold) == held, F.lit(False)).alias("held_out"), "text")
    return score_toxicity(named, model, cut).drop("text")
