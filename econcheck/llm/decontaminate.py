"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on the word n-grams they share (the seeds). Each
candidate pair is then tiled: the longest common run of words that are still unmarked is
marked in both, again and again, until none of ``seed`` words is left. Runs are found from
rolling-hash matches of ``seed`` words and extended. The share of an item's words that lie
under tiles does not depend on the order of its parts, so reordered passages are caught.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from econcheck.llm import core
from econcheck.llm.store import written

SEED = 4
COVERAGE = 0.6
SLOTS_BITS = 22
U64 = np.uint64
#: what parts words beyond ASCII, and the letters of scripts written without spaces, each a word with its marks
NO_WORD = r"[^\x00-\x7F\p{L}\p{M}\p{N}]+"
ALONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*"


def _words(column: pa.Array):
    """(first row, number of rows, word hashes, their documents) of runs of lower-cased texts."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    wide = pc.invert(pc.string_is_ascii(lower))
    if pc.any(wide).as_py():
        parted = pc.replace_substring_regex(lower.filter(wide), NO_WORD, " ")
        lower = pc.replace_with_mask(lower, wide, pc.replace_substring_regex(parted, ALONE, r" \0 "))
    for lo, hi, data, off in core.runs(lower):
        start, end, doc = core.spans(data, off, core.ALNUM)
        yield lo, hi - lo, core.word_hashes(data, start, end), doc


def tile(doc: np.ndarray, place: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length) of greedy string tiling; ``place`` are the words' positions in the document.

    In each round all maximal runs of unmarked equal words are found from hash matches of
    ``seed`` words; the longest are marked first (ties: first in the item, then in the
    document), a run that has been cut in the meantime waits for the next round.
    """
    tiles: list[tuple[int, int, int]] = []
    zero = np.zeros(len(doc), dtype=np.int64)
    gd, at = core.grams(doc, zero, seed)
    whole = place[at + seed - 1] - place[at] == seed - 1 if len(at) else np.zeros(0, dtype=bool)
    gd, at = gd[whole], at[whole]
    gi, ai = core.grams(item, np.zeros(len(item), dtype=np.int64), seed)
    order = np.argsort(gi, kind="stable")
    lo, hi = (np.searchsorted(gi[order], gd, side=x) for x in ("left", "right"))
    n = hi - lo
    d = np.repeat(at, n).astype(np.int32)
    i = ai[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]].astype(np.int32)
    # along a diagonal, consecutive seeds make one run
    by = np.lexsort((i, d - i))
    i, d = i[by], d[by]
    used_d, used_i = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    while len(i):
        first = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(d) != 1) | (np.diff(place[d]) != 1)))
        length = np.diff(np.append(first, len(i))) + seed - 1
        best = np.lexsort((d[first], i[first], -length))
        for k, x, y in zip(length[best].tolist(), i[first][best].tolist(), d[first][best].tolist(), strict=True):
            if not used_i[x : x + k].any() and not used_d[y : y + k].any():
                used_i[x : x + k] = used_d[y : y + k] = True
                tiles.append((int(place[y]), x, k))
        taken_i, taken_d = (np.append(0, np.cumsum(u)) for u in (used_i, used_d))
        free = (taken_i[i + seed] == taken_i[i]) & (taken_d[d + seed] == taken_d[d])
        i, d = i[free], d[free]
    return tiles


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for every document and item with at least that coverage.

    Words are runs of letters and digits in lower case, in scripts without spaces single letters;
    ``coverage`` is the share of the item's words under tiles. An item of fewer than ``seed``
    words matches where all of them stand in a row. Null and empty texts match nothing. Rows that repeat doc_id and text give one row, different texts of one
    doc_id each their own; null ids are kept as null. An empty benchmark gives no rows.
    """
    return _matches(docs, benchmark, seed, coverage).drop("text_key")


def _matches(docs: DataFrame, benchmark: DataFrame, seed: int, coverage: float) -> DataFrame:
    """The rows of ``contaminated`` with text_key (xxhash64), which tells the texts of one doc_id apart."""
    spark = docs.sparkSession
    item_schema = pa.schema([("item_id", pa.int64()), ("item", pa.binary())])

    def item_rows(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, m, h, doc in _words(batch.column(1)):
                cut = np.searchsorted(doc, np.arange(m + 1))
                for i in range(m):
                    if cut[i + 1] > cut[i]:
                        yield [ids[lo + i], h[cut[i] : cut[i + 1]].astype("<u8").tobytes()]

    items = benchmark.select(F.col("item_id").cast("long"), "text").distinct().mapInArrow(lambda b: core.batches(item_rows(b), item_schema), "item_id long, item binary")

    def gram_rows(batches):
        for batch in batches:
            for keys, item in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                h = np.frombuffer(item, dtype="<u8")
                g, n = np.unique(core.grams(h, np.zeros(len(h), dtype=np.int64), min(seed, len(h)))[0].astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(g), c.type) for k, c in zip(keys, batch.columns[:-1], strict=True)), pa.array(g), pa.array(n)], names=[*batch.schema.names[:-1], "g", "places"])

    item_grams = written(items.withColumn("words", F.expr("octet_length(item) div 8")).select("item_id", "item", "words"))
    grams = written(item_grams.select("item_id", "words", "item").mapInArrow(gram_rows, "item_id long, words long, g long, places long"))
    # seed, and the lengths of shorter items
    sizes = sorted(x.n for x in item_grams.select(F.least("words", F.lit(seed)).alias("n")).distinct().collect())
    # a table of fixed size: 2^22 slots, whatever the size of the benchmark; it only spares the join what cannot match
    slots = np.zeros(1 << SLOTS_BITS, dtype=bool)
    slots[grams.select(F.expr(f"shiftrightunsigned(g, {64 - SLOTS_BITS})").alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    held = spark.sparkContext.broadcast(slots)
    hit_schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.binary()), ("doc", pa.binary())])

    def hit_rows(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, m, h, doc in _words(batch.column(2)):
                under = np.zeros(0, dtype=np.int64)
                for n in sizes:
                    g, at = core.grams(h, doc, n)
                    at = at[held.value[(g >> U64(64 - SLOTS_BITS)).astype(np.int64)]]
                    under = np.union1d(under, (at[:, None] + np.arange(n)).ravel())
                if not len(under):
                    continue
                first = np.searchsorted(doc, np.arange(m + 1))
                cut = np.searchsorted(under, first)
                for i in np.flatnonzero(np.diff(cut)):
                    mine = under[cut[i] : cut[i + 1]]
                    yield [ids[lo + i], keys[lo + i], (mine - first[i]).astype("<i4").tobytes(), h[mine].astype("<u8").tobytes()]

    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    hits = written(plain.mapInArrow(lambda b: core.batches(hit_rows(b), hit_schema, 512), "doc_id long, text_key long, place binary, doc binary").distinct())

    def seed_rows(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc_id, key, place, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, p = np.frombuffer(doc, dtype="<u8"), np.frombuffer(place, dtype="<i4")
                for n in sizes:
                    g, at = core.grams(h, np.zeros(len(h), dtype=np.int64), n)
                    g = np.unique(g[p[at + n - 1] - p[at] == n - 1].astype(np.int64)) if len(at) else g.astype(np.int64)
                    for c, v in zip(out, ([doc_id] * len(g), [key] * len(g), g.tolist()), strict=True):
                        c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "text_key", "g"])

    seeds = hits.mapInArrow(seed_rows, "doc_id long, text_key long, g long")
    # a tile of t words has t - seed + 1 places of grams in the item, so that many shared places, repeated grams
    # counted each time, cover seed times as many words at most
    pairs = seeds.join(grams, "g").groupBy("doc_id", "text_key", "item_id", "words").agg(F.sum("places").alias("n")).where(F.col("n") * F.least("words", F.lit(seed)) / F.col("words") >= coverage)
    tile_schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())])

    def tile_rows(batches):
        for batch in batches:
            for doc_id, key, item_id, place, doc, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(item, dtype="<u8")
                found = tile(np.frombuffer(doc, dtype="<u8"), np.frombuffer(place, dtype="<i4").astype(np.int64), words, min(seed, len(words)))
                share = sum(t[2] for t in found) / len(words)
                if share >= coverage:
                    yield [doc_id, key, item_id, share, len(found), max(t[2] for t in found)]

    full = pairs.select("doc_id", "text_key", "item_id").join(item_grams.select("item_id", "item"), "item_id")
    own = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "place", "doc")
    full = full.join(own, full.doc_id.eqNullSafe(own.d) & (full.text_key == own.k))
    return full.select("doc_id", "text_key", "item_id", "place", "doc", "item").mapInArrow(lambda b: core.batches(tile_rows(b), tile_schema), "doc_id long, text_key long, item_id long, coverage double, n_tiles int, longest int")


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not contaminated; rows with a null doc_id stay."""
    bad = _matches(docs, benchmark, seed, coverage).where("doc_id is not null").select("doc_id", F.col("text_key").alias("_text_key")).distinct()
    return docs.withColumn("_text_key", F.xxhash64("text")).join(bad, ["doc_id", "_text_key"], "left_anti").select(*docs.columns)
