"""Approximate nearest neighbours by inner product over balanced posting lists.

Centroids are fitted on a bounded sample and kept in memory with a neighbour graph. Every
vector is filed under its nearest centroid, and near a boundary under others as well. A
query walks the graph, keeps the lists whose distance is within a ratio of the nearest, and
is scored against their members. Lists are bundled so that a task has some 65,536 members and
16,384 questions to a list; larger bundles are cut by a hash of the ids, so no task holds an
unbounded list, and a query gets its best from each bundle once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000
MEMBERS = 256
MAX_LISTS = 4_096
DEGREE = 24
BUNDLE = 65_536
ASKS = 16_384


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm2) of the rows that take part: finite, not zero, of the most common length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).where("norm2 > 0")
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("v") == (common.d if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means whose assignment pays for the size a list already has, so that lists come out alike."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:k]].astype(np.float64)
    sizes = np.full(len(centres), len(sample) / len(centres))
    for _ in range(rounds):
        d = (centres**2).sum(1) - 2 * sample @ centres.T
        own = d.argmin(1)
        spread = np.abs(d[np.arange(len(sample)), own] - np.median(d, axis=1)).mean()
        own = (d + 0.05 * spread * (sizes * len(centres) / len(sample))).argmin(1)
        sizes = np.bincount(own, minlength=len(centres)).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        lost = np.flatnonzero(~full)
        if len(lost):
            centres[lost] = sample[rng.integers(0, len(sample), len(lost))]
    return centres


def neighbour_graph(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Per centroid its nearest others and a few far ones, which keep the graph in one piece."""
    n = len(centres)
    near, far = min(degree, n), min(4, n)
    d = (centres**2).sum(1) - 2 * centres @ centres.T
    ring = (np.arange(n)[:, None] + np.linspace(1, max(1, n - 1), far).astype(int)) % n
    return np.concatenate((np.argsort(d, axis=1)[:, :near], ring), axis=1)


def search_graph(q: np.ndarray, centres: np.ndarray, graph: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of about the ``keep`` nearest centroids of each row: best-first walks in step."""
    n, keep = len(centres), min(keep, len(centres))
    norm, qq = (centres**2).sum(1), (q**2).sum(1)
    beam = min(n, max(2 * keep, 32))
    entry = np.unique(np.linspace(0, n - 1, beam).astype(int))
    ids = np.broadcast_to(entry, (len(q), len(entry))).copy()
    dist = norm[ids] - 2 * q @ centres[entry].T
    seen = np.zeros((len(q), n), dtype=bool)
    seen[:, entry] = True
    done = np.zeros((len(q), n), dtype=bool)
    rows = np.arange(len(q))
    for _ in range(4 * beam):
        waiting = np.where(np.take_along_axis(done, ids, 1), np.inf, dist)
        best = waiting.argmin(1)
        if not np.isfinite(waiting[rows, best]).any():
            break
        node = ids[rows, best]
        done[rows, node] = True
        more = graph[node]
        d = norm[more] - 2 * np.einsum("bd,bkd->bk", q, centres[more])
        d[np.take_along_axis(seen, more, 1)] = np.inf
        np.put_along_axis(seen, more, True, 1)
        ids, dist = np.concatenate((ids, more), 1), np.concatenate((dist, d), 1)
        top = np.argpartition(dist, beam - 1, axis=1)[:, :beam] if dist.shape[1] > beam else np.broadcast_to(np.arange(dist.shape[1]), dist.shape)
        ids, dist = np.take_along_axis(ids, top, 1), np.take_along_axis(dist, top, 1)
    order = np.argsort(dist, axis=1)[:, :keep]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1) + qq[:, None]
    return ids, np.where(np.isfinite(dist), np.sqrt(np.maximum(dist, 0)), np.inf)


def _filed(vectors: DataFrame, model, keep: int, ratio: float, least: int, lift: float, asking: bool) -> DataFrame:
    """(list, vec_id, v): each vector under every list within ``ratio`` of its nearest, at least ``least``.

    ``lift`` is the largest norm: members get the coordinate that makes all norms equal, so
    that the nearest by distance is the largest by inner product; queries get zero.
    """
    schema = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float32()))])

    def rows(batches):
        centres, graph = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = _matrix(part.column(1)).astype(np.float64)
                extra = np.zeros(len(x)) if asking else np.sqrt(np.maximum(lift**2 - (x**2).sum(1), 0))
                if asking:  # a query's length does not change its order of members
                    x = x / np.linalg.norm(x, axis=1, keepdims=True) * lift
                ids, dist = search_graph(np.concatenate((x, extra[:, None]), 1), centres, graph, keep)
                ok = (dist <= ratio * dist[:, :1]) & np.isfinite(dist)
                ok[:, : min(least, ok.shape[1])] |= np.isfinite(dist[:, :least])
                at, col = np.nonzero(ok)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at, col].astype(np.int32)), taken.column(0), taken.column(1).cast(pa.list_(pa.float32()))], schema=schema)

    return vectors.select("vec_id", "v").mapInArrow(rows, "list int, vec_id long, v array<float>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: float = 0.25, ratio: float = 1.12, least: int = 12, copies: int = 4, closure: float = 1.08) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` nearest found, by largest inner product.

    ``vectors(vec_id, embedding)`` are the candidates and ``queries`` rows of the same shape; a
    query's own vec_id is no candidate. Ties go to the smaller vec_id; rows that repeat a
    vec_id count once, with the larger score. Null, zero, non-finite vectors and vectors not
    of the most common length take no part. With fewer than ``k`` candidates all are given; no
    candidates, no rows. The centroids are fitted on at most 20,000 vectors; every vector is
    filed. ``probes`` is the largest share of lists a query visits, ``ratio`` the distance up to which it
    does, ``least`` how many it always visits; ``copies`` and ``closure`` say the same of filing.
    """
    spark = vectors.sparkSession
    base = usable(vectors)
    size = base.agg(F.count("*").alias("n"), F.max("norm2").alias("m"), F.avg(F.sqrt("norm2")).alias("mean")).first()
    asked = usable(queries)
    if not size.n:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("norm2").alias("score")).where("false")
    lift = float(np.sqrt(size.m))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    x = _matrix(sample.column("v").combine_chunks()).astype(np.float64)
    x = np.concatenate((x, np.sqrt(np.maximum(lift**2 - (x**2).sum(1), 0))[:, None]), 1)
    lists = int(min(MAX_LISTS, len(x), max(1, size.n // MEMBERS)))
    centres = fit_centroids(x, lists)
    model = spark.sparkContext.broadcast((centres, neighbour_graph(centres)))
    members, probed = _filed(base, model, copies, closure, 1, lift, False), _filed(asked, model, max(least, int(probes * lists)), ratio, least, lift, True)
    # at most MAX_LISTS rows, whatever the input
    sizes = members.groupBy("list").agg(F.count("*").alias("m"), F.lit(0).alias("q")).union(probed.groupBy("list").agg(F.lit(0), F.count("*"))).groupBy("list").agg(F.sum("m").alias("m"), F.sum("q").alias("q")).collect()
    bundles = max(1, -(-sum(r.m for r in sizes) // BUNDLE))
    held, asks = [0] * bundles, [0] * bundles
    for r in sizes:
        held[r.list % bundles] += r.m
        asks[r.list % bundles] += r.q
    cut = F.broadcast(spark.createDataFrame([(i, max(1, -(-m // (2 * BUNDLE))), max(1, -(-q // ASKS))) for i, (m, q) in enumerate(zip(held, asks, strict=True))], "bundle int, chunks int, shares int"))
    bundle = F.pmod("list", F.lit(bundles)).alias("bundle")
    chunk = members.select("list", bundle, "vec_id", "v").join(cut, "bundle").select("list", "bundle", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "vec_id", "v")
    share = probed.select("list", bundle, "vec_id", "v").join(cut, "bundle").select("list", "bundle", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.pmod(F.xxhash64("vec_id"), "shares").cast("int").alias("share"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def top(s: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the k best distinct ids, ties to the smaller; an id stands in the lists of a bundle ``copies`` times at most, and each repeated row as often."""
        at = np.arange(len(s))
        m = 2 * k * copies
        while True:
            if m < len(s):
                at = np.flatnonzero(s >= np.partition(s, -m)[-m])
            order = at[np.lexsort((ids[at], -s[at]))]
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
            if len(order) >= k or m >= len(s):
                return order[:k]
            m *= 4

    def score(m: pa.Table, q: pa.Table) -> pa.Table:
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        if m.num_rows and q.num_rows:
            mx, qx = (_matrix(t.column("v").combine_chunks()).astype(np.float64) for t in (m, q))
            ml, ql, mi, qi = m.column("list").to_numpy(), q.column("list").to_numpy(), m.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
            for name in np.unique(ql):
                own, asking = np.flatnonzero(ml == name), np.flatnonzero(ql == name)
                for lo in range(0, len(asking) if len(own) else 0, 256):
                    part = asking[lo : lo + 256]
                    s = qx[part] @ mx[own].T
                    ids = mi[own]
                    s[qi[part][:, None] == ids[None, :]] = -np.inf
                    for i, row in zip(qi[part].tolist(), s, strict=True):
                        at = top(row, ids)
                        at = at[np.isfinite(row[at])]
                        best.setdefault(i, []).append((ids[at], row[at]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, found in best.items():
            ids, s = (np.concatenate(c) for c in zip(*found, strict=True))
            at = top(s, ids) if len(ids) else np.zeros(0, dtype=int)
            out.append((np.full(len(at), i), ids[at], s[at]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    key = ["bundle", "chunk", "share"]
    found = chunk.groupBy(*key).cogroup(share.groupBy(*key)).applyInArrow(score, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
