"""Vectorised reading of texts inside tasks: words, hashes and shingles of an Arrow batch.

Everything works on the UTF-8 bytes of a bounded run of documents at a time, so memory in
a task depends on the run (one megabyte, or one longer document), not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words as in the contract of the n-gram join: runs of anything but ASCII white space
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words without punctuation: ASCII letters and digits, and every byte of other letters
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, RUN_BYTES + 1)
        tables = []
        for base in (_P, _P_INV):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            tables.append(np.cumprod(t))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a finaliser in the style of splitmix)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def runs(column: pa.Array, limit: int = RUN_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes and ``rows`` rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes of ``kind``; none crosses documents."""
    word = kind[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = word[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, ASCII letters lower-cased."""
    n = len(data)
    if not len(start):
        return np.zeros(0, dtype=U64)
    pw, inv = _tables(n)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((LOWER[data].astype(U64) + U64(1)) * pw, out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of every ``n`` consecutive words of one document."""
    last = len(h) - n + 1
    if last <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[:last] == doc[n - 1 :])
    acc = np.full(len(at), n, dtype=U64)
    for j in range(n):
        acc = mix(acc * U64(0x2545F4914F6CDD1D) + h[at + j])
    return acc, at


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Per document the hashes of its ``n``-word shingles; fewer words make one shingle, no words none."""
    start, end, doc = spans(data, off)
    h = word_hashes(data, start, end)
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    g, at = grams(h, doc, n)
    where = np.searchsorted(at, first)
    out = []
    for d in range(len(off) - 1):
        if count[d] >= n:
            out.append(g[where[d] : where[d + 1]])
        elif count[d]:
            acc = np.array([count[d]], dtype=U64)
            for j in range(first[d], first[d + 1]):
                acc = mix(acc * U64(0x2545F4914F6CDD1D) + h[j : j + 1])
            out.append(acc)
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def batches(rows: Iterable[list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows to record batches of at most ``size`` rows."""
    keep: list[list] = []
    for row in rows:
        keep.append(row)
        if len(keep) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*keep, strict=True), schema, strict=True)], schema=schema)
            keep = []
    if keep:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*keep, strict=True), schema, strict=True)], schema=schema)
