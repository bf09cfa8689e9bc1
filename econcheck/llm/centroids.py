"""Centroid clustering of vectors in exact integers, by scalar lookup tables.

Vectors become integers once and are stored in blocks: for every dimension the values that
occur in the block, and for every vector the places of its values. A round tabulates, per
block, the squared difference of each dimension, occurring value and centroid; distances are
gathers from that table and their sums. Only centroids and sums per centroid leave the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from econcheck.llm.store import written

SIZE, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BLOCK = 4096
#: below this size of all values, a squared distance of 64 components stays inside 64 bits
NARROW = 1 << 27
#: the largest float whose product with the scale is finite
_FINITE = 2.0**1000
_BLOCK = "vec_id binary, known binary, sizes binary, occurring binary, places binary"


def usable(vector: Column, size: int = SIZE) -> Column:
    """Whether a vector has ``size`` components, none null or non-finite."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def _integers(floors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of the stored floats: 64-bit integers where all are small, else exact Python integers."""
    if not len(floors) or np.abs(floors).max() * scale <= NARROW:
        return np.floor(floors * scale).astype(np.int64)
    return np.array([math.floor(x * scale) if abs(x) < _FINITE else int(x) * scale for x in floors.tolist()], dtype=object)


class Block:
    """Up to ``BLOCK`` vectors: ids, and per dimension the occurring values and each vector's place among them."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, occurring: np.ndarray, places: np.ndarray):
        self.ids, self.known, self.sizes, self.occurring, self.places = ids, known, sizes, occurring, places

    @classmethod
    def of(cls, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, scale: int) -> Block:
        inner = np.abs(vectors) < _FINITE
        floors = np.where(inner, np.floor(np.where(inner, vectors, 0) * scale) / scale, vectors)
        found = [np.unique(floors[:, d], return_inverse=True) for d in range(floors.shape[1])]
        return cls(ids, known, np.array([len(u) for u, _ in found]), np.concatenate([u for u, _ in found]), np.stack([p.reshape(-1) for _, p in found]))

    def row(self) -> list[bytes]:
        return [self.ids.astype("<i8").tobytes(), self.known.astype("u1").tobytes(), self.sizes.astype("<i4").tobytes(), self.occurring.astype("<f8").tobytes(), self.places.astype("<u2").tobytes()]

    @classmethod
    def read(cls, row: list[bytes]) -> Block:
        ids, known, sizes, occurring = (np.frombuffer(x, dtype=t) for x, t in zip(row, ("<i8", "u1", "<i4", "<f8"), strict=False))
        return cls(ids, known.astype(bool), sizes, occurring, np.frombuffer(row[4], dtype="<u2").reshape(len(sizes), len(ids)))

    def nearest(self, centroids: list[list[int]], scale: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector, the smaller of equals, and the squared distance to it."""
        values = _integers(self.occurring, scale)
        wide = values.dtype == object or any(abs(x) > NARROW for c in centroids for x in c)
        kind = object if wide else np.int64
        dimension = np.repeat(np.arange(len(self.sizes)), self.sizes)
        # squared difference by occurring value of each dimension (rows) and centroid (columns)
        table = (values.astype(kind)[:, None] - np.array(centroids, dtype=kind).T[dimension]) ** 2
        first = np.cumsum(self.sizes) - self.sizes
        total = np.zeros((len(self.ids), len(centroids)), dtype=kind)
        for d, at in enumerate(first.tolist()):
            total += table[at + self.places[d].astype(np.int64)]
        best = total.argmin(1)
        return best, total[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, k: int, scale: int) -> Iterator[tuple[int, int, list[int]]]:
        """(centroid, vectors, sum of their components) of each centroid that got vectors."""
        values = _integers(self.occurring, scale)
        first = np.cumsum(self.sizes) - self.sizes
        for c in range(k):
            mine = np.flatnonzero(cluster == c)
            if len(mine):
                yield c, len(mine), [int(values[at + self.places[d, mine].astype(np.int64)].sum()) for d, at in enumerate(first.tolist())]


def _blocks(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    schema = pa.schema([(f.split()[0], pa.binary()) for f in _BLOCK.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            row = Block.of(*(np.concatenate(x) for x in zip(*held, strict=True)), scale).row()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], schema=schema)

        n = 0
        for batch in batches:
            ids, values = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy()
            for lo in range(0, len(number), BLOCK):
                part = slice(lo, lo + BLOCK)
                if held and n + len(number[part]) > BLOCK:
                    yield block()
                    n = 0
                held.append((number[part], known[part], values[part]))
                n += len(number[part])
        if held:
            yield block()

    return vectors.mapInArrow(rows, _BLOCK)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block.read([c[i].as_py() for c in batch.columns])


def _cluster_sums(blocks: DataFrame, centroids: list[list[int]], scale: int) -> list[Row]:
    """Per centroid: vectors, sum of each component, sum of distances; one row of a task and centroid is shuffled."""
    width = len(centroids[0])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in _read(batches):
            cluster, distance = b.nearest(centroids, scale)
            for c, n, sums in b.sums(cluster, len(centroids), scale):
                t = total.setdefault(c, [0, [0] * width, 0])
                t[0], t[1], t[2] = t[0] + n, [x + y for x, y in zip(t[1], sums, strict=True)], t[2] + sum(distance[cluster == c].tolist())
        # digits, because sums of far components pass 64 bits and even decimals
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([[str(x) for x in [*t[1], t[2]]] for t in total.values()], pa.list_(pa.string()))], names=["cluster", "n", "sums"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for c, n, sums in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                t = total.setdefault(c, [0, [0] * (width + 1)])
                t[0], t[1] = t[0] + n, [x + int(y) for x, y in zip(t[1], sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([[str(x) for x in t[1]] for t in total.values()], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    ddl = "cluster int, n long, sums array<string>"
    # rows of a task are dealt by centroid and a salt, added, and the few sums left are added by the driver
    dealt = blocks.mapInArrow(rows, ddl).repartition(F.col("cluster"), F.expr("hash(sums) & 3"))
    return dealt.mapInArrow(added, ddl).collect()


def _total(rows: list[Row], k: int, width: int) -> list[tuple[int, list[int], int]]:
    total = [(0, [0] * width, 0) for _ in range(k)]
    for r in rows:
        n, sums, inertia = total[r.cluster]
        total[r.cluster] = (n + r.n, [x + int(y) for x, y in zip(sums, r.sums[:-1], strict=True)], inertia + int(r.sums[-1]))
    return total


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def cluster_vectors(vectors: DataFrame, size: int = SIZE, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, in exact integers.

    Vectors with exactly ``size`` components, none null or non-finite, take part; a component x
    counts as floor(scale * x). Centroids start as the ``k`` vectors with the smallest sha256 of
    ``seed:id``, rows of equal ids in the order of their components; with fewer vectors there
    are fewer centroids. Each round moves every centroid with vectors to the floor of their
    means; ties go to the smaller number. Null ids take part but start no centroid (if no row
    has an id, there is no result). Repeated rows stay, other columns are ignored, an empty
    table gives no rows. A distance or sum beyond 64 bits is null; assignments stay exact.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).where(usable(F.col("vector"), size)).select("id", F.col("vector").cast("array<double>").alias("vector"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = plain.where("id is not null").withColumn("key", key).orderBy("key", "vector").limit(k).collect()
    ddl = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], ddl)
    blocks = written(_blocks(plain, size, scale))
    centroids = [[math.floor(x * scale) if abs(x) < _FINITE else int(x) * scale for x in r.vector] for r in start]
    for _ in range(rounds):
        sums = _total(_cluster_sums(blocks, centroids, scale), len(centroids), size)
        centroids = [[x // n for x in s] if n else c for c, (n, s, _) in zip(centroids, sums, strict=True)]
    inertias = [s[2] for s in _total(_cluster_sums(blocks, centroids, scale), len(centroids), size)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches):
            cluster, distance = b.nearest(centroids, scale)
            of = cluster.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.ids, pa.int64(), mask=~b.known),
                    pa.array(cluster, pa.int32()),
                    pa.array([_long(x) for x in distance.tolist()], pa.int64()),
                    pa.array([_long(inertias[c]) for c in of], pa.int64()),
                    pa.array([_long(sum(inertias))] * len(of), pa.int64()),
                    pa.array([digests[c] for c in of], pa.string()),
                ],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return blocks.mapInArrow(rows, ddl)


def oracle_sql(size: int = SIZE, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of ``cluster_vectors`` over ``embeddings`` with distinct ids: one pair of steps a round."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
long AS MATERIALIZED (SELECT vec_id, unnest(range(1, {size + 1})) AS d, unnest(v) AS x FROM kept),
first AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, unnest(range(1, {size + 1})) AS d, unnest(v) AS y FROM first)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, c, s FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS s FROM long JOIN c{r} USING (d) GROUP BY vec_id, c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s, c) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT c, d, sum(x) AS s, count(*) AS n FROM long JOIN a{r} USING (vec_id) GROUP BY c, d),
c{r + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS y FROM c{r} LEFT JOIN m{r} USING (c, d))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) USING (c)
"""
