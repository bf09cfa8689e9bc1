"""Language identification in two levels: the family first, then close languages against each other.

A text is its counts of letter n-grams (one to three bytes, in hashed columns, square roots,
unit length). Families are told apart one against the rest; inside a family every two
languages have a linear support vector machine, and their votes decide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from econcheck.llm import core
from econcheck.llm.samples import by_class, remainder

COLUMNS = 2_048
PER_LANGUAGE = 800
UNKNOWN = "und"
#: fixed values: which languages are close relatives; a language that is not here is its own family
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of hashed letter n-grams per document."""
    n, docs = len(data), len(off) - 1
    b = np.where(core.ALNUM[data] & ~((data >= 48) & (data <= 57)), core.LOWER[data], 32).astype(np.uint32)
    doc = np.repeat(np.arange(docs, dtype=np.int64), np.diff(off))
    out = np.zeros(docs * COLUMNS, dtype=np.float32)
    code = np.zeros(n, dtype=np.uint32)
    for k in range(3):
        if n <= k:
            break
        code = code[: n - k] * np.uint32(256) + b[k:] if k else b.copy()
        ok = (doc[: n - k] == doc[k:]) & ((b[: n - k] != 32) | (b[k:] != 32))
        column = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(21)).astype(np.int64)
        out += np.bincount((doc[: n - k] * COLUMNS + column)[ok], minlength=docs * COLUMNS)
    out = np.sqrt(out).reshape(docs, COLUMNS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss; ``y`` is -1 or 1."""
    x = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), 1).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.25
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * x.T @ (share * y * slack) + penalty * v
        new = v - step * grad
        v, w = new + (i / (i + 3)) * (new - w), new
    return w


def _slope(margin: np.ndarray) -> float:
    """How steep a logistic curve of the signed margin fits the sample best."""
    grid = np.array([0.5, 1, 2, 3, 4, 6, 8, 12])
    return float(grid[np.argmin([np.logaddexp(0, -a * margin).mean() for a in grid])])


def fit(x: np.ndarray, lang: list[str]) -> dict:
    """Family machines, and a machine for every two languages of one family."""
    names = np.array(lang)
    family = np.array([FAMILIES.get(v, v) for v in lang])
    model: dict = {"families": sorted(set(family)), "family": {}, "members": {}, "pair": {}}
    for f in model["families"]:
        y = np.where(family == f, 1.0, -1.0)
        w = svm(x, y) if (y < 0).any() else np.append(np.zeros(x.shape[1]), 1.0)
        model["family"][f] = (w, _slope(y * (x @ w[:-1] + w[-1])))
        model["members"][f] = sorted(set(names[family == f]))
        for a, b in combinations(model["members"][f], 2):
            own = (names == a) | (names == b)
            y = np.where(names[own] == a, 1.0, -1.0)
            w = svm(x[own], y)
            model["pair"][a, b] = (w, _slope(y * (x[own] @ w[:-1] + w[-1])))
    return model


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row; the score is the family's share times the language's share in it."""
    def chance(w: tuple[np.ndarray, float]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(w[1] * (x @ w[0][:-1] + w[0][-1]), -30, 30)))

    raw = np.stack([chance(model["family"][f]) for f in model["families"]], 1)
    share = raw / np.maximum(raw.sum(1, keepdims=True), 1e-12)
    best = raw.argmax(1)
    lang, score = np.empty(len(x), dtype=object), np.zeros(len(x))
    for i, f in enumerate(model["families"]):
        own = best == i
        names = model["members"][f]
        votes, sums = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        for a, b in combinations(range(len(names)), 2):
            p = chance(model["pair"][names[a], names[b]])
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            sums[:, a] += p
            sums[:, b] += 1 - p
        within = sums / np.maximum(sums.sum(1, keepdims=True), 1e-12) if len(names) > 1 else np.ones((len(x), 1))
        pick = (votes + 1e-6 * sums).argmax(1) if len(names) > 1 else np.zeros(len(x), dtype=int)
        lang[own] = np.array(names, dtype=object)[pick][own]
        score[own] = (share[:, i] * np.minimum(1, within[np.arange(len(x)), pick] * (len(names) / 2 if len(names) > 2 else 1)))[own]
    return lang, np.clip(score, 0, 1)


def fit_languages(docs: DataFrame, cap: int = PER_LANGUAGE) -> dict | None:
    """A model from about ``cap`` documents of each language; None without labelled letters."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    chosen = by_class(known.select("doc_id", "lang", "text"), "lang", cap)

    def rows(batches):
        for batch in batches:
            for lo, hi, data, off in core.runs(batch.column(1), rows=256):
                x = features(data, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = chosen.select("lang", "text").mapInArrow(rows, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.float16).reshape(got.num_rows, COLUMNS).astype(np.float32)
    order = np.lexsort((x @ np.arange(COLUMNS, dtype=np.float32), np.array(got.column("lang").to_pylist())))
    return fit(x[order], [got.column("lang")[int(i)].as_py() for i in order])


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole ``text`` alone.

    ``und`` and score 0 if the text is null, empty or has no letter, or if there was nothing
    to learn from. Columns of ``docs`` with these two names are replaced, all others kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("lang_pred", "score")
    kept = plain.withColumn("_letters", F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))

    def rows(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            flags = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            lang, score = [], []
            for lo, hi, data, off in core.runs(batch.column(at), rows=256):
                if held.value is None or not flags[lo:hi].any():
                    lang += [UNKNOWN] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                l, s = predict(held.value, features(data, off))
                lang += [x if ok else UNKNOWN for x, ok in zip(l, flags[lo:hi], strict=True)]
                score += [float(x) if ok else 0.0 for x, ok in zip(s, flags[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    out = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(rows, out)


def predict_languages(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learnt from rows whose remainder by ``fold`` is not ``held``.

    A null doc_id is never learnt from and not held out. Repeated rows come back one for one.
    """
    part = remainder(F.col("doc_id"), fold)
    model = fit_languages(docs.select("doc_id", "lang", "text").where(part != held))
    named = docs.select("doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), "text")
    return identify(named, model).drop("text")
