"""Quality classifier as a sparse ensemble of rules over text statistics.

Small trees are grown on a bounded sample of labelled documents. Each path from a root
becomes a conjunctive rule, lasso-penalised logistic regression keeps few of them, and those
are compiled into one Spark column expression over the columns of statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from econcheck.llm import core
from econcheck.llm.samples import by_class, remainder

PER_CLASS = 3_000
STATS = [
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share", "stop_rate", "exclaim_rate",
    "distinct_share", "top_share", "repeat_share", "line_words", "distinct_lines", "gram_share", "long_share", "short_share",
]
_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or other letter, 3 digit, 4 sentence mark, 5 other symbol, 6 exclamation
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
for _c in b".,;:?'\"()-":
    _KIND[_c] = 4
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _KIND[_c] = 5
_KIND[ord("!")] = 6
_NOT_LINE = np.ones(256, dtype=bool)
_NOT_LINE[[10, 13]] = False


def _per(doc: np.ndarray, docs: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weight, minlength=docs).astype(float)


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the number of distinct hashes and the count of the most frequent one."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(h)))
    top = np.zeros(docs)
    np.maximum.at(top, doc[at], length)
    return _per(doc[at], docs), top


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` per document; all zero for a text without words."""
    docs = len(off) - 1
    start, end, doc = core.spans(data, off)
    h = core.word_hashes(data, start, end)
    words = _per(doc, docs)
    w = np.maximum(words, 1)
    kind = _KIND[data]
    upto = {k: np.concatenate(([0], np.cumsum(kind == k))) for k in range(1, 7)}
    n = {k: (c[off[1:]] - c[off[:-1]]).astype(float) for k, c in upto.items()}
    letters = np.maximum(n[1] + n[2], 1)
    size = np.maximum(sum(n.values()), 1)
    distinct, top = _distinct(h, doc, docs)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    g, at = core.grams(h, doc, 3)
    gd = doc[at] if len(at) else np.zeros(0, dtype=np.int64)
    grams = np.maximum(_per(gd, docs), 1)
    ls, le, ld = core.spans(data, off, _NOT_LINE)
    lines = np.maximum(_per(ld, docs), 1)
    length = (end - start).astype(float)
    stops = kind[end - 1] if len(end) else np.zeros(0, dtype=np.uint8)
    return np.stack(
        [
            np.log1p(words), _per(doc, docs, length) / w, n[1] / letters, n[3] / size, n[5] / size, n[4] / w, _per(doc, docs, (stops == 4).astype(float)) / w, n[6] / w,
            distinct / w, top / w, _per(doc, docs, same.astype(float)) / w, np.log1p(words / lines), _distinct(core.word_hashes(data, ls, le), ld, docs)[0] / lines,
            _distinct(g, gd, docs)[0] / grams, _per(doc, docs, (length > 14).astype(float)) / w, _per(doc, docs, (length < 4).astype(float)) / w,
        ],
        1,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` and one double column per statistic of its whole ``text``; null reads as empty, equal names are replaced."""
    plain = docs.drop(*STATS)

    def rows(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            parts = [statistics(data, off) for _, _, data, off in core.runs(batch.column(at))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x[:, i]) for i in range(len(STATS)))], names=[*batch.schema.names, *STATS])

    return plain.mapInArrow(rows, T.StructType([*plain.schema.fields, *(T.StructField(s, T.DoubleType()) for s in STATS)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold) of every condition


def _grow(x: np.ndarray, r: np.ndarray, h: np.ndarray, own: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, out: list[Rule], f: np.ndarray) -> None:
    """One regression tree on gradients ``r`` and curvatures ``h``; its paths go to ``out``, its values into ``f``."""
    def gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * a / (b + 1.0)

    best = (1e-6, None)
    if depth and own.sum() >= 40:
        ro, ho, xo = r[own], h[own], x[own]
        for j, cut in enumerate(cuts):
            slot = np.searchsorted(cut, xo[:, j], side="left")
            a, b, m = (np.cumsum(np.bincount(slot, weights=v, minlength=len(cut) + 1))[:-1] for v in (ro, ho, np.ones(len(ro))))
            g = gain(a, b) + gain(ro.sum() - a, ho.sum() - b) - gain(ro.sum(), ho.sum())
            g[(m < 15) | (len(ro) - m < 15)] = 0
            if len(g) and g.max() > best[0]:
                best = (g.max(), (j, float(cut[g.argmax()])))
    if best[1] is None:
        f[own] += 0.3 * r[own].sum() / (h[own].sum() + 1.0)
        return
    j, t = best[1]
    for above in (False, True):
        way = (*path, (j, above, t))
        out.append(way)
        _grow(x, r, h, own & ((x[:, j] > t) == above), cuts, depth - 1, way, out, f)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > t) == above for j, above, t in rule])


def fit_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 24, depth: int = 3, lasso: float = 2e-3) -> tuple[float, list[tuple[Rule, float]]]:
    """(bias, rules with weights): paths of boosted trees, thinned by a lasso-penalised logistic fit."""
    weight = weight / weight.sum() * len(y)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49)).round(6)) for j in range(x.shape[1])]
    f = np.full(len(y), np.log(max(1e-6, (weight * y).sum()) / max(1e-6, (weight * (1 - y)).sum())))
    rules: list[Rule] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        _grow(x, weight * (y - p), weight * p * (1 - p), np.ones(len(y), dtype=bool), cuts, depth, (), rules, f)
    rules = list(dict.fromkeys(rules))
    base = float(np.log(max(1e-6, (weight * y).sum()) / max(1e-6, (weight * (1 - y)).sum())))
    if not rules:
        return base, []
    z = np.stack([_holds(x, r) for r in rules], 1).astype(float)
    step = 4 / (z.sum(1).max() + 1)
    w, v, b = np.zeros(len(rules)), np.zeros(len(rules)), base
    for i in range(1500):
        e = weight * (1 / (1 + np.exp(-(z @ v + b))) - y) / len(y)
        new = v - step * (z.T @ e)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * lasso)
        b -= step * e.sum() * 4
        v, w = new + (i / (i + 3)) * (new - w), new
    return float(b), [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-4]


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble as one column expression over ``STATS``, between 0 and 1."""
    total = F.lit(bias)
    for rule, weight in rules:
        test = F.lit(True)
        for j, above, t in rule:
            test = test & ((F.col(STATS[j]) > t) if above else (F.col(STATS[j]) <= t))
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, cap: int = PER_CLASS) -> tuple[float, list[tuple[Rule, float]]]:
    """Bias and rules from about ``cap`` labelled documents of each class, weighted back to their shares.

    ``labels(doc_id, quality)``: null labels are left out, the largest of repeated ones counts.
    Without any labelled text there are no rules and every score is one half.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = by_class(known, "quality", cap)  # at most 4 * cap ids
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("quality", *STATS).toPandas()
    if not len(rows):
        return 0.0, []
    rows = rows.sort_values(list(rows.columns))
    y = rows["quality"].to_numpy().clip(0, 1).astype(float)
    have = {c: max(1, int((rows["quality"] == c).sum())) for c in counts}
    weight = rows["quality"].map({c: counts[c] / have[c] for c in counts}).to_numpy(float)
    return fit_rules(rows[STATS].to_numpy(float), y, weight)


def score_quality(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], cut: float = 0.3) -> DataFrame:
    """``docs`` with score (higher: quality 1 likelier) and predicted (1 if score >= ``cut``); null and empty texts too."""
    held = with_statistics(docs.drop("score", "predicted")).withColumn("score", compiled(*model)).drop(*STATS)
    return held.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def predict_quality(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted); learnt from labels whose doc_id has another remainder than ``held``.

    A null doc_id is never learnt from and not held out. Repeated rows come back one for one.
    """
    model = fit_quality(docs, labels.where(remainder(F.col("doc_id"), fold) != held))
    named = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), fold) == held, F.lit(False)).alias("held_out"), "text")
    return score_quality(named, model, cut).drop("text")
