"""Collocations by language: phrases of two and three words that stand together more often than chance.

Pass one hashes every run of words and keeps, per hash partition, a mergeable Misra-Gries
summary whose capacity exceeds the partition's mass divided by the threshold, so every frequent
run of words survives. Pass two counts the survivors exactly, by their words; scores come from
those counts alone, in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from econcheck.llm import core
from econcheck.llm.store import written

LEAST, TOP, LONGEST, SHARE, UNKNOWN = 10, 2000, 3, 50, "und"
#: shares of a language that are ranked by themselves before their best are ranked together
SHARES = 8
#: counters of one summary when the mass spreads evenly; more mass makes more hash partitions
COUNTERS = 1 << 21
#: bytes of text taken at a time; a run of that size has fewer than 2^21 distinct words
RUN = 1 << 20
_ID = 21
#: bytes of text a task gathers, by language, before it counts them
GATHERED = 2 << 20
#: bits of the survivors' filter: so many a survivor, and never more than the bound (64 MB)
BITS_EACH, MOST_BITS = 32, 1 << 29
_LOW = np.uint64((1 << 48) - 1)

MARK = np.zeros(256, dtype=bool)
MARK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
GAP = MARK.copy()
GAP[[0x20, 0x09]] = True
WORD = ~GAP


class Runs:
    """The distinct runs of one to ``longest`` words of a piece of text, counted exactly.

    ``ids`` of a run of n words are word numbers of this object, 21 bits each, in one integer.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, new: int, longest: int):
        start, end, doc = core.spans(data, off, WORD)
        letters = core.LOWER[data][WORD[data]]
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.words = words.dictionary
        ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(MARK[data]), start) + doc
        fresh = start >= new
        self.n = int(fresh.sum())
        self.counted = []
        for k in range(1, min(longest, len(ids)) + 1):
            last = len(ids) - k + 1
            key = ids[:last]
            for j in range(1, k):
                key = key << _ID | ids[j : last + j]
            self.counted.append(np.unique(key[(piece[:last] == piece[k - 1 :]) & fresh[k - 1 :]], return_counts=True))

    def parts(self, k: int, keys: np.ndarray) -> list[np.ndarray]:
        """The word numbers of runs of ``k`` words, one array a place."""
        return [keys >> _ID * (k - 1 - j) & (1 << _ID) - 1 for j in range(k)]

    def hashes(self, lang: str) -> list[np.ndarray]:
        """For each length the 64-bit hashes of the distinct runs, by language and words; equal in all tasks."""
        seed = xxhash.xxh64_intdigest(lang)
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()], dtype=np.uint64)
        out = []
        for k, (keys, _) in enumerate(self.counted, 1):
            h = np.full(len(keys), k, dtype=np.uint64)
            for p in self.parts(k, keys):
                h = core.mix(h * np.uint64(0x2545F4914F6CDD1D) + own[p])
            out.append(h)
        return out

    def phrases(self, k: int, keys: np.ndarray) -> pa.Array:
        """The words of the runs, joined by spaces."""
        return pc.binary_join_element_wise(*(self.words.take(pa.array(p)) for p in self.parts(k, keys)), pa.scalar(" ", pa.large_string())).cast(pa.string())


def _windows(data: np.ndarray, off: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first new byte) of a run of texts; one text longer than a run comes in windows.

    A window starts with the last words of the one before it, which it must not count again.
    """
    if len(data) <= RUN or len(off) > 2:
        yield data, off, 0
        return
    at = back = 0
    while at < len(data):
        end = min(at + RUN, len(data))
        while end < len(data):
            gaps = np.flatnonzero(GAP[data[end - RUN : end]])
            if len(gaps):
                end += int(gaps[-1]) + 1 - RUN
                break
            end = min(end + RUN, len(data))  # one word longer than a run
        part = data[back:end]
        yield part, np.array([0, len(part)]), at - back
        start = core.spans(part, np.array([0, len(part)]), WORD)[0]
        tail = start[len(start) - longest + 1 :] if longest > 1 else start[:0]
        back, at = (back + int(tail[0]) if len(tail) else end), end


def _texts(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[list[tuple[str, Runs]]]:
    """Groups of (language, counted runs); a group is what a task has gathered of all languages."""
    held: dict[str, list[pa.Array]] = {}
    size = 0

    def counted() -> Iterator[tuple[str, Runs]]:
        for lang, texts in held.items():
            for _, _, data, off in core.runs(pa.concat_arrays(texts), RUN):
                for window in _windows(data, off, longest):
                    yield lang, Runs(*window, longest)

    for batch in batches:
        langs, texts = batch.column(0).dictionary_encode(), pc.fill_null(batch.column(1), "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(ends):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + GATHERED - size, side="right")))
            for i in pc.unique(langs.indices[lo:hi]).to_pylist():
                held.setdefault(langs.dictionary[i].as_py(), []).append(texts[lo:hi].filter(pc.equal(langs.indices[lo:hi], i)))
            size += int(ends[hi - 1]) - before
            lo = hi
            if lo < len(ends) or size >= GATHERED:
                yield counted()
                held.clear()
                size = 0
    if held:
        yield counted()


class Summary:
    """A Misra-Gries summary of hashes; summaries merge by adding counters and cutting back to the capacity.

    A cut by x takes x from each of more than ``capacity`` counters, so what all cuts take from one
    counter, ``taken``, stays below mass / capacity.
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._new.append((keys, counts))
        self._size += len(keys)
        if self._size > max(1 << 18, len(self.keys)):
            self._settle()

    def _settle(self) -> None:
        if not self._new:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self._new)])
        counts = np.concatenate([self.counts, *(c for _, c in self._new)])
        self._new, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.taken += cut
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut

    def frequent(self, least: int) -> np.ndarray:
        """Every key that can have ``least`` occurrences."""
        self._settle()
        return self.keys[self.counts + self.taken >= least]


def _share(h: np.ndarray, n: int) -> np.ndarray:
    """The one of ``n`` equal ranges of all hashes (n up to 2^31) that each hash falls into."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _low(h: np.ndarray) -> bytes:
    """Six low bytes of each hash: with its hash partition enough to tell almost all apart; those told apart wrongly only cost pass two a count."""
    return np.ascontiguousarray(h.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def _of_low(raw: bytes) -> np.ndarray:
    full = np.zeros((len(raw) // 6, 8), dtype="u1")
    full[:, :6] = np.frombuffer(raw, dtype="u1").reshape(-1, 6)
    return full.reshape(-1).view("<u8").astype(np.uint64)


def _survivors(texts: DataFrame, least: int, longest: int, parts: int) -> DataFrame:
    """(p, n, keys) per hash partition: the low bytes of every hash that can have ``least`` occurrences."""
    block = pa.schema([("p", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for group in _texts(batches, longest):
                # a key that reaches the threshold here is sure to survive: more of its mass is not needed
                found = [(np.concatenate(run.hashes(lang)), np.minimum(np.concatenate([c for _, c in run.counted]), least).astype("<u4")) for lang, run in group if run.counted]
                if not found:
                    continue
                h, c = (np.concatenate(x) for x in zip(*found, strict=True))
                found.clear()
                order = np.argsort(h)
                h, c = h[order], c[order]
                p = _share(h, parts)
                edge = np.flatnonzero(np.append(True, p[1:] != p[:-1])).tolist()
                for lo, hi in zip(edge, [*edge[1:], len(p)], strict=True):
                    # the mass comes in a row of its own, which sorts before the summaries
                    yield [int(p[lo]), int(c[lo:hi].sum()), None, None]
                    yield [int(p[lo]), None, _low(h[lo:hi]), c[lo:hi].tobytes()]

        return core.batches(rows(), block, 64)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            own, mass, summary = None, 0, None

            def result():
                keys = summary.frequent(least)
                return [own, len(keys), _low(keys)]

            for batch in batches:
                for p, m, keys, counts in zip(*batch.columns, strict=True):
                    if p.as_py() != own:
                        if summary is not None:
                            yield result()
                        own, mass, summary = p.as_py(), 0, None
                    if m.is_valid:
                        mass += m.as_py()
                        continue
                    summary = summary or Summary(mass // least + 1)
                    summary.merge(_of_low(keys.as_py()), np.frombuffer(counts.as_py(), dtype="<u4").astype(np.int64))
            if summary is not None:
                yield result()

        return core.batches(rows(), pa.schema([("p", pa.int32()), ("n", pa.int64()), ("keys", pa.binary())]), 1)

    blocks = texts.mapInArrow(summaries, "p int, mass long, keys binary, counts binary")
    dealt = blocks.repartitionById(parts, "p").sortWithinPartitions("p", F.col("mass").isNull())
    return dealt.mapInArrow(merged, "p int, n long, keys binary")


def _filter(survivors: DataFrame, parts: int) -> np.ndarray:
    """A bit for every range of low hash bits that holds a survivor; its size is bounded by ``MOST_BITS``."""
    n = survivors.agg(F.sum("n")).first()[0] or 0
    bits = 1 << 16
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits <<= 1
    width = bits.bit_length() - 1

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the survivors of a task in one map, in the parts of it that are not empty
        own = np.zeros(bits, dtype=bool)
        for batch in batches:
            for keys in batch.column(0):
                own[_slot(_of_low(keys.as_py()), width)] = True
        packed = np.packbits(own).reshape(-1, 1 << 13)
        yield from core.batches(([i, packed[i].tobytes()] for i in np.flatnonzero(packed.any(1)).tolist()), pa.schema([("i", pa.int32()), ("bits", pa.binary())]), 64)

    # one row a part of the map: maps of several tasks are joined by OR before they reach the driver
    pieces = survivors.select("keys").coalesce(max(1, parts // 8)).mapInArrow(slots, "i int, bits binary")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, dtype="u1")
                total[i] = total[i] | x if i in total else x
        yield from core.batches(([i, x.tobytes()] for i, x in total.items()), pa.schema([("i", pa.int32()), ("bits", pa.binary())]), 64)

    whole = np.zeros((bits >> 16, 1 << 13), dtype="u1")
    for i, raw in pieces.repartition("i").mapInArrow(joined, "i int, bits binary").toLocalIterator():
        whole[i] = np.frombuffer(raw, dtype="u1")
    return whole.reshape(-1)


def _slot(h: np.ndarray, width: int) -> np.ndarray:
    """The place of a hash in a filter of 2^width bits: its low 48 bits, spread anew."""
    return (core.mix(h & _LOW) >> np.uint64(64 - width)).astype(np.int64)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, parts: int | None = None) -> DataFrame:
    """(lang, phrase, words, f) of every run of one to ``longest`` words with at least ``least`` occurrences in its language.

    A row with an empty phrase and 0 words holds the number of all word occurrences of the
    language. Counts are exact. ``parts`` is the number of hash partitions (by default so many
    that a summary has about ``COUNTERS`` counters).
    """
    if not 1 <= longest <= 3:
        raise ValueError("runs of one to three words")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    if parts is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # a word takes two bytes at least, and starts one run of each length at most
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size // 2 + 1) * longest // (least * COUNTERS)))
    bits = _filter(written(_survivors(texts, least, longest, parts)), parts)
    held, width = spark.sparkContext.broadcast(bits), (len(bits) * 8).bit_length() - 1
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _texts(batches, longest):
            for lang, run in group:
                found = [([0], pa.array([""], pa.string()), [run.n])] if run.n else []
                for k, (h, (keys, counts)) in enumerate(zip(run.hashes(lang), run.counted, strict=True), 1):
                    at = _slot(h, width)
                    left = (held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                    found.append(([k] * int(left.sum()), run.phrases(k, keys[left]), counts[left]))
                for k, phrase, f in found:
                    for lo in range(0, len(phrase), 1 << 15):
                        part = slice(lo, lo + (1 << 15))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase[part]), pa.string()), pa.array(k[part], pa.int32()), phrase[part], pa.array(f[part], pa.int64())], schema=schema)

    counted = texts.mapInArrow(exact, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, longest: int = LONGEST, parts: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, a descending and phrase.

    Texts are cut at ``.,;:!?`` and line ends into pieces and those into words at blanks and
    tabs, A to Z in lower case. A phrase of two to ``longest`` words with a >= ``least``
    occurrences scores the least floor(1000000 a a / (l r)) over its cuts into a first and a
    second part with l and r occurrences (the first cut of equals), unless its words stand
    inside a longer phrase with at least ``share`` percent as many occurrences. n counts the
    language's words. A null language reads as ``und``, null and empty texts hold nothing, ids
    and other columns play no part, repeated rows count each time, an empty table gives no
    rows; a very long text is counted in windows. Exact while counts stay below 10^16.
    """
    counts = written(phrase_counts(docs, least, longest, parts))
    word = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), cut)
    cuts = cuts.select("*", F.concat_ws(" ", F.slice(word, F.lit(1), F.col("k"))).alias("first"), F.concat_ws(" ", F.slice(word, F.col("k") + 1, F.col("words"))).alias("rest"))
    known = counts.where("words > 0")
    # parts of frequent phrases are frequent, so both are known; one part may stand in many phrases: those joins are left to the skew handling
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = written(cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # a pair goes where a phrase of three words with its first or last two has most of its occurrences
    longer = cuts.where("words > 2")
    inside = [longer.where((F.col("k") == at) & (100 * F.col("a") >= share * F.col(f))).select("lang", F.col(part).alias("phrase")) for at, part, f in ((F.col("words") - 1, "first", "l"), (F.lit(1), "rest", "r"))]
    gone = inside[0].union(inside[1]).distinct()
    big = "decimal(38,0)"
    score = F.expr(f"(cast(1000000 as {big}) * a * a) div (cast(l as {big}) * r)")
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("c").alias("c"))
    left = best.join(gone, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first the best of each share of a language, so that what meets in one task is bounded whatever the number of phrases
    share_of = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SHARES))).orderBy(*best_first)
    left = left.select("*", F.row_number().over(share_of).alias("_rn")).where(F.col("_rn") <= top).drop("_rn")
    ranked = left.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)).cast("long").alias("rank")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, top: int = TOP, share: int = SHARE) -> str:
    """DuckDB SQL for the rows of ``collocations`` over ``documents``, for phrases of two and three words."""
    return rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS MATERIALIZED (SELECT row_number() OVER () AS piece, lang, w FROM (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)) WHERE len(w) > 0),
worded AS MATERIALIZED (
  SELECT lang, a, lead(a, 1) OVER (PARTITION BY piece ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY piece ORDER BY i) AS c
  FROM (SELECT piece, lang, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM pieces)),
runs AS (
  SELECT lang, 1 AS words, a AS phrase FROM worded
  UNION ALL SELECT lang, 2, a || ' ' || b FROM worded WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM worded WHERE c IS NOT NULL),
counted AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM runs GROUP BY lang, words, phrase),
total AS (SELECT lang, sum(f) AS n FROM counted WHERE words = 1 GROUP BY lang),
cuts AS MATERIALIZED (
  SELECT lang, phrase, words, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT lang, phrase, words, f AS a, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS w FROM counted WHERE words > 1 AND f >= {least})),
headed AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head),
scored AS MATERIALIZED (
  SELECT c.*, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (c.l::HUGEINT * y.f) AS score
  FROM headed c JOIN counted y ON y.lang = c.lang AND y.phrase = c.tail),
gone AS (
  SELECT lang, head AS phrase FROM scored WHERE words = 3 AND k = 2 AND 100 * a >= {share} * l
  UNION SELECT lang, tail FROM scored WHERE words = 3 AND k = 1 AND 100 * a >= {share} * r),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM best ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= {top})
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang)
"""
