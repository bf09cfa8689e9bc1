"""Token ids packed into rows of fixed length by best-fit-decreasing.

Documents longer than a row are split without loss: whole rows of one document need no
packing, what is left of it is packed like a short document. Pieces are dealt by a hash into
groups of bounded size, and each group is packed on its own: longest piece first, each into
the row with the least room that still takes it. A segment tree over the room that rows have
left answers that search in the logarithm of the row length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 8_192
GROUP_TOKENS = 1 << 22
#: fixed values of the byte vocabulary: padding, end of document, first byte
PAD, EOS, FIRST = 0, 1, 3
_ID = np.arange(256, dtype=np.uint16) + FIRST
_ID[255] = EOS  # no UTF-8 text holds this byte


class Rooms:
    """Rows by the room they have left: the least room of at least ``n`` that some row has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        rows = self.rows.setdefault(room, [])
        rows.append(row)
        i = room + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, row) of the best fit, removed; of rows with equal room the one added last."""
        i = n + self.size
        while not self.some[i]:
            while i & 1:  # nothing further right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the right edge
                return None
        while i < self.size:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.size
        rows = self.rows[room]
        row = rows.pop()
        if not rows:
            while i and not (i < self.size and (self.some[2 * i] or self.some[2 * i + 1])):
                self.some[i] = 0
                i >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into ``sizes``, which must fall and not exceed ``capacity``."""
    rooms, rows = Rooms(capacity), []
    for i, n in enumerate(sizes):
        hit = rooms.take(n)
        if hit is None:
            rows.append([i])
            rooms.add(capacity - n, len(rows) - 1)
        else:
            room, row = hit
            rows[row].append(i)
            rooms.add(room - n, row)
    return rows


def pack_bytes(docs: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Rows of ``capacity`` byte-level ids of the whole texts of ``docs(doc_id, text)``.

    (grp, row, n_tokens, n_segments, doc_ids, parts, cu_seqlens, position_resets, ids): ``ids``
    is ``capacity`` little-endian unsigned 16-bit numbers, padded with 0; segment i is
    ``cu_seqlens[i]`` to ``cu_seqlens[i + 1]`` and holds part ``parts[i]`` of ``doc_ids[i]``;
    positions restart at each of ``position_resets``. A document is its bytes (id: byte + 3)
    and one end mark (1), cut every ``capacity`` ids; a null or empty text is its end mark.
    Rows with equal ids or texts are packed one by one; a null doc_id stays null. Groups depend
    on the data only; a group that holds more than twice its share is packed in pieces.
    """
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = names.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    tokens = names.select("doc_id", F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\xff"))).alias("t"))
    parts = tokens.select("doc_id", "t", F.explode(F.expr(f"sequence(0, cast((length(t) - 1) div {capacity} as int))")).alias("part"))
    pieces = parts.select("doc_id", "part", F.expr(f"substring(t, part * {capacity} + 1, {capacity})").alias("t"))
    pieces = pieces.withColumn("n", F.length("t")).withColumn("grp", F.pmod(F.xxhash64("doc_id", "part", F.crc32("t")), F.lit(groups)))
    schema = pa.schema([
        ("grp", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()),
    ])

    def packed(grp: int, base: int, held: list[tuple]):
        rows = best_fit_decreasing([len(h[2]) for h in held], capacity)
        for lo in range(0, len(rows), 128):
            out: list[list] = [[] for _ in schema]
            for r, row in enumerate(rows[lo : lo + 128], base + lo):
                ends = np.cumsum([0, *(len(held[i][2]) for i in row)])
                ids = np.full(capacity, PAD, dtype="<u2")
                ids[: ends[-1]] = _ID[np.frombuffer(b"".join(held[i][2] for i in row), dtype=np.uint8)]
                for c, v in zip(out, (grp, r, int(ends[-1]), len(row), [held[i][0] for i in row], [held[i][1] for i in row], ends.tolist(), ends[:-1].tolist(), ids.tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    def rows(batches):
        grp, base, held, size = None, 0, [], 0
        for batch in batches:
            for doc_id, part, t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (g != grp or size > 2 * group_tokens):
                    yield from packed(grp, base, held)
                    base, held, size = (base + len(held) if g == grp else 0), [], 0
                elif g != grp:
                    base = 0
                grp = g
                held.append((doc_id, part, t))
                size += len(t)
        if held:
            yield from packed(grp, base, held)

    dealt = pieces.repartition("grp").sortWithinPartitions("grp", F.desc("n"), "doc_id", "part", "t")
    kind = "grp long, row long, n_tokens int, n_segments int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"
    return dealt.select("doc_id", "part", "t", "grp").mapInArrow(rows, kind)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: one id row, its cumulative lengths and resets per record."""
    packed.write.parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) rebuilt from written rows, for documents whose doc_id is neither null nor repeated."""

    def rows(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for ids, docs, parts, cu in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(ids, dtype="<u2")
                for d, p, i, j in zip(docs, parts, cu[:-1], cu[1:], strict=True):
                    for c, x in zip(out, (d, p, (v[i:j][v[i:j] >= FIRST] - FIRST).astype(np.uint8).tobytes()), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "part", "t"])

    pieces = spark.read.parquet(path).select("ids", "doc_ids", "parts", "cu_seqlens").mapInArrow(rows, "doc_id long, part int, t binary")
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "t"))).alias("p"))
    return whole.select("doc_id", F.decode(F.aggregate("p", F.lit(bytearray()), lambda s, x: F.concat(s, x["t"])), "UTF-8").alias("text"))
