"""Similarity join on word n-gram sets with a prefix tree.

1. Every document becomes the set of its word shingles. Sets are ordered globally: shingles
   that many documents hold come last, the rest by hash. How common a shingle is comes from a
   table of counters of fixed size, added up over all documents.
2. Equal sets are one class. Two sets can only reach the threshold if they share a shingle
   among the first ``n - ceil(t n) + 1`` of either, so only those prefixes are shuffled.
3. Members of a shared shingle are first compared with one leading member, a few times with
   changing leaders. What then is one component needs no further comparison; of the other pairs
   that share a prefix shingle those are listed whose bit signatures leave room for the overlap
   that is needed (a bound, so no link is lost), and those that share enough prefix shingles are
   compared as well. No group of copies is expanded into all its pairs.
4. Pairs are verified exactly. The partners of a set lie in a prefix tree, held as their
   sorted order: neighbours share the path of their common prefix and with it the partial
   overlap counted there, and a subtree is left as soon as the elements that remain cannot
   reach the overlap that is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from econcheck.llm import core
from econcheck.llm.components import components
from econcheck.llm.store import release, written

COUNTERS = 1 << 20
PART = 1 << 14
FILTER_WORDS = 1 << 20
ROUNDS = 4
#: bits of a set's signature
SIGNATURE = 1024
#: listed pairs that a task adds up before it hands them on
HELD_PAIRS = 1 << 19
#: shingles with twice as many holders as this, and the same leading holder, are dealt to several buckets
BUCKET_HOLDERS = 1024
U64 = np.uint64


def _need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return (n * percent + 99) // 100


def _counters(docs: DataFrame, n: int) -> np.ndarray:
    """How many shingles fall on each of ``COUNTERS`` counters, over all documents (fixed size: 4 MB)."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, _, data, off in core.runs(batch.column(0)):
                total += np.bincount((np.concatenate(core.shingle_sets(data, off, n)) >> U64(44)).astype(np.int64), minlength=COUNTERS)
        for i in range(0, COUNTERS, PART):
            chunk = total[i : i + PART]
            if chunk.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // PART], pa.int32()), pa.array([np.minimum(chunk, 2**31 - 1).astype("<i4").tobytes()], pa.binary())], schema=schema)

    def add(key, table):  # at most 256 tasks' parts of 64 KB in the first round
        total = np.zeros(PART, dtype=np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, dtype="<i4")
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())], schema=schema)

    kind = "part int, counts binary"
    each = docs.select("text").mapInArrow(count, kind).withColumn("some", F.floor(F.spark_partition_id() / 256))
    rows = each.groupBy("part", "some").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind).collect()
    total = np.zeros(COUNTERS, dtype=np.int32)
    for r in rows:
        total[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, dtype="<i4")
    return total


def _classes_of_counters(total: np.ndarray) -> np.ndarray:
    """0 for counters of the usual size, one more for each doubling beyond twice the usual."""
    usual = max(1.0, float(np.median(total)))
    return np.clip(np.floor(np.log2(np.maximum(total - usual, 1) / max(4.0, usual ** 0.5 * 4))) + 1, 0, 15).astype(U64)


def _ordered(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Distinct shingles in the global order, as numbers of which the top four bits say how common they are."""
    return np.unique((late[(s >> U64(44)).astype(np.int64)] << U64(60)) | (core.mix(s) >> U64(4)))


def _signature(s: np.ndarray) -> bytes:
    """A bit for every slot that an element of the set falls on."""
    bits = np.zeros(SIGNATURE, dtype=bool)
    bits[(core.mix(s ^ U64(0x3C3C3C3CC3C3C3C3)) % U64(SIGNATURE)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _sets(docs: DataFrame, n: int, late, percent: int, prefix: bool) -> DataFrame:
    """(doc_id, n, k1, k2, sig): set size, 128-bit key and bit signature of the set; or (doc_id, n, prefix): its first shingles."""
    last = [("prefix", pa.binary())] if prefix else [("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *last])

    def rows(batches):
        order = late.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, data, off in core.runs(batch.column(1)):
                for i, s in enumerate(core.shingle_sets(data, off, n)):
                    s = _ordered(s, order)
                    m = len(s)
                    if prefix:
                        yield [ids[lo + i], m, s[: m - _need(m, percent) + 1].astype("<u8").tobytes() if m else b""]
                    else:
                        yield [ids[lo + i], m, *(int(x.sum(dtype=U64).astype(np.int64)) for x in (core.mix(s), core.mix(s ^ U64(0xA5A5A5A55A5A5A5A)))), _signature(s)]

    kind = "doc_id long, n long, " + ("prefix binary" if prefix else "k1 long, k2 long, sig binary")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: core.batches(rows(b), schema, 1024), kind)


def _postings(classes: DataFrame) -> DataFrame:
    """(g, rep, n) for every prefix shingle of every class."""
    schema = pa.schema([("g", pa.int64()), ("rep", pa.int64()), ("n", pa.int32())])

    def rows(batches):
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32)
            parts = [np.frombuffer(x, dtype="<i8") for x in batch.column(2).to_pylist()]
            at = 0
            while at < len(parts):
                end, size = at, 0
                while end < len(parts) and size < 1 << 17:
                    size += len(parts[end])
                    end += 1
                m = [len(x) for x in parts[at:end]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts[at:end])), pa.array(np.repeat(ids[at:end], m)), pa.array(np.repeat(sizes[at:end], m))], schema=schema)
                at = end

    return classes.select("rep", "n", "prefix").mapInArrow(rows, "g long, rep long, n int")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of shingles with two holders or more."""
    schema = pa.schema([("g", pa.int64()), ("rep", pa.int64()), ("n", pa.int32())])

    def rows(batches):
        held, before = None, None  # the last row so far, which waits for the next one; the shingle before it
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
            g = cols[0]
            same = g[1:] == g[:-1]
            several = np.concatenate(([before is not None and g[0] == before], same)) | np.concatenate((same, [False]))
            several[-1] = False
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in cols], schema=schema)
            before = g[-2] if len(g) > 1 else before
            held = [c[-1:] for c in cols]
        if held is not None and before is not None and held[0][0] == before:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=schema)

    return postings.repartition("g").sortWithinPartitions("g").mapInArrow(rows, "g long, rep long, n int")


def _room(n: np.ndarray, sig: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets ``x`` and ``y`` can overlap enough by their signatures.

    A bit that only one of two signatures has comes from an element that only that set has, so
    the sets differ in at least as many elements as the signatures differ in bits, and an overlap
    of ``percent (x + y) / (100 + percent)`` leaves them only so many to differ in.
    """
    both = n[x].astype(np.int64) + n[y]
    apart = np.bitwise_count(sig[x] ^ sig[y]).sum(1, dtype=np.int64)
    return apart <= both - 2 * -(-percent * both // (100 + percent))


def _added_up(pairs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, an, bn, shared) with every pair once, ``shared`` summed."""
    a, b, an, bn, shared = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((b, a))
    a, b, an, bn, shared = (x[order] for x in (a, b, an, bn, shared))
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], an[first], bn[first], np.add.reduceat(shared, first)


def _across(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b, an, bn, shared) of sets of fitting sizes, different components and near signatures that share prefix shingles.

    ``shared(g, rep, n, comp, sig, bucket)``: shingles of one bucket, which mostly have the same
    holders, come one after the other, so a task lists a pair about once, with the number of its
    shared shingles there; a pair may come again from another bucket.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("an", pa.int32()), ("bn", pa.int32()), ("shared", pa.int64())])

    def out(rep, n, x, y):
        flip = rep[x] > rep[y]
        x, y = np.where(flip, y, x), np.where(flip, x, y)
        return rep[x], rep[y], n[x], n[y], np.ones(len(x), np.int64)

    def near_enough(n, sig, x, y):
        """The pairs (x, y) that have room, a bounded number at a time."""
        for i in range(0, len(x), 1 << 14):
            px, py = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
            ok = _room(n, sig, px, py, percent)
            if ok.any():
                yield px[ok], py[ok]

    def small(first, rep, n, comp, sig):
        """Groups of like sizes side by side: every row against the row ``d`` before it, for each ``d``."""
        place = np.arange(len(rep)) - first
        at = np.flatnonzero(place > 0)
        d = 0
        while len(at):
            d += 1
            at = at[place[at] >= d]
            at = at[n[at - d] >= _need(n[at].astype(np.int64), percent)]  # sizes fall further back
            hit = at[comp[at] != comp[at - d]]
            for x, y in near_enough(n, sig, hit, hit - d):
                yield out(rep, n, x, y)

    def large(rep, n, comp, sig):
        """One group: only members outside its largest component are compared, with all that fit."""
        names, counts = np.unique(comp, return_counts=True)
        main = names[counts.argmax()]
        for i in np.flatnonzero(comp != main):
            lo = int(np.searchsorted(n, _need(int(n[i]), percent)))
            hi = int(np.searchsorted(n, int(n[i]) * 100 // percent, side="right"))
            near = np.arange(lo, hi)
            near = near[(comp[lo:hi] != comp[i]) & ((comp[lo:hi] == main) | (near < i))]
            for x, y in near_enough(n, sig, np.full(len(near), i), near):
                yield out(rep, n, x, y)

    def emit(g, rep, n, comp, sig):
        new = np.concatenate(([True], g[1:] != g[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(g)))
        big = size > 64
        few = np.repeat(~big, size)
        if few.any():
            first = np.maximum.accumulate(np.where(new[few], np.arange(few.sum()), 0))
            yield from small(first, rep[few], n[few], comp[few], sig[few])
        for lo, m in zip(start[big], size[big], strict=True):
            yield from large(rep[lo : lo + m], n[lo : lo + m], comp[lo : lo + m], sig[lo : lo + m])

    def listed(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)] + [np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=U64).reshape(-1, SIGNATURE // 64)]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            ends = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            last = int(ends[-1]) + 1 if len(ends) else 0  # the group that may go on
            if last:
                yield from emit(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
        if held:
            yield from emit(*held)

    def rows(batches):
        kept, size = [], 0
        for pairs in listed(batches):
            kept.append(pairs)
            size += len(pairs[0])
            if size < HELD_PAIRS:
                continue
            kept = [_added_up(kept)]
            size = len(kept[0][0])
            if size > HELD_PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept[0]], schema=schema)
                kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added_up(kept)], schema=schema)

    kept = shared.repartition("bucket").sortWithinPartitions("bucket", "g", "n", "rep")
    return kept.select("g", "rep", "n", "comp", "sig").mapInArrow(rows, "a long, b long, an int, bn int, shared long").where("a <> b")


def _star(labelled: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each set against the leading set, of another component, that it shares most prefix shingles with.

    A shingle's leading set is the first of its holders in an order that changes with
    ``turn``; the order is one for all shingles, so a leader's shared shingles are all counted.
    """
    first = F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("o"), F.col("rep").alias("lead"), F.col("n").alias("lead_n"), F.col("comp").alias("lead_comp")))
    leads = labelled.groupBy("g").agg(first.alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g", "l.lead", "l.lead_n", "l.lead_comp")
    met = labelled.join(leads, "g").where("comp <> lead_comp").where(f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
    sized = met.select(F.col("lead").alias("a"), F.col("rep").alias("b"), F.col("lead_n").alias("an"), F.col("n").alias("bn"))
    best = _likely(sized.withColumn("shared", F.lit(1)), percent).groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, an, bn, shared) of the pairs that share enough prefix shingles, of ``pairs`` with parts of that number.

    With sizes x and y the overlap must reach ``o = percent (x + y) / (100 + percent)``. Behind
    the prefix that ends first lie at most ``ceil(percent / 100 max(x, y)) - 1`` common
    shingles, so the rest of ``o`` must be shared inside the prefixes.
    """
    least = F.expr(f"({percent} * (an + bn) + {99 + percent}) div {100 + percent} - ((greatest(an, bn) * {percent} + 99) div 100 - 1)")
    return pairs.groupBy("a", "b", "an", "bn").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= least)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit filter of fixed size (4 MB) over ``ids``; it only spares shuffling sets nobody asks for."""
    slot = F.xxhash64("id")
    words = ids.select(F.pmod(slot, F.lit(FILTER_WORDS)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(id), 40), 32) as int))").alias("bit"))
    table = words.groupBy("w").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, dtype=np.uint32)
    bits[table.column("w").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return bits


def _wanted_sets(docs: DataFrame, ids: DataFrame, n: int, late) -> DataFrame:
    """(id, s): ordered sets, as big-endian numbers, of the documents in ``ids``."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter(ids))
    schema = pa.schema([("id", pa.int64()), ("s", pa.binary())])

    def rows(batches):
        order, held = late.value, bits.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            ok = (held[slot % FILTER_WORDS] >> ((slot >> 40) % 32).astype(np.uint32)) & np.uint32(1)
            batch = batch.filter(pa.array(ok.astype(bool)))
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            for lo, _, data, off in core.runs(batch.column(1)):
                for i, s in enumerate(core.shingle_sets(data, off, n)):
                    yield [names[lo + i], _ordered(s, order).astype(">u8").tobytes()]

    asked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").withColumn("slot", F.xxhash64("id"))
    found = asked.mapInArrow(lambda b: core.batches(rows(b), schema, 256), "id long, s binary")
    return found.join(ids, "id", "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold, by walking the prefix tree of each set's partners."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        own = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y, sa, sb in zip(a, b, batch.column(2), batch.column(3), strict=True):
                sa, sb = sa.as_py(), sb.as_py()
                if own is None or own[0] != x or own[1] != sa:
                    own, mine, path, hits, dead = (x, sa), np.frombuffer(sa, dtype=">u8").astype(U64), np.zeros(0, U64), np.zeros(1, np.int64), 1 << 62
                node = np.frombuffer(sb, dtype=">u8").astype(U64)
                m, k = min(len(path), len(node)), len(node)
                differ = np.flatnonzero(path[:m] != node[:m])
                depth = int(differ[0]) if len(differ) else m
                # overlap o is enough if 100 o >= percent (|a| + |b| - o)
                enough = -(-percent * (len(mine) + k) // (100 + percent))
                if depth >= dead and hits[dead] + min(k - dead, len(mine)) < enough:
                    continue
                depth = min(depth, len(hits) - 1)
                tail = node[depth:]
                found = np.zeros(len(tail), dtype=bool)
                if len(mine):
                    at = np.minimum(np.searchsorted(mine, tail), len(mine) - 1)
                    found = mine[at] == tail
                hits = np.concatenate((hits[: depth + 1], hits[depth] + np.cumsum(found)))
                path = node
                short = np.flatnonzero(hits + (k - np.arange(k + 1)) < enough)
                dead = int(short[0]) if len(short) else 1 << 62
                if hits[-1] >= enough:
                    yield [x, y]

    other = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    own = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    full = pairs.select("a", "b").join(other, "b").join(own, "a").select("a", "b", "sa", "sb")
    return full.sortWithinPartitions("a", "sa", "sb").mapInArrow(lambda x: core.batches(rows(x), schema), "a long, b long")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct
    ``n``-word shingles (ASCII lower case; words end at ASCII white space). A document with
    fewer words has one shingle, its whole sequence. Null, empty and blank texts have the
    empty set and link with nothing, so they are their own component. Rows that repeat a
    doc_id are one document that has the links of each of its texts; every row is returned.
    A null doc_id takes part in no link and gets a null component. Other columns are ignored.
    """
    spark = docs.sparkSession
    late = spark.sparkContext.broadcast(_classes_of_counters(_counters(docs, n)))
    sets = written(_sets(docs, n, late, percent, prefix=False))
    known = sets.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    prefixes = _sets(docs, n, late, percent, prefix=True).join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    shared = written(_shared(_postings(prefixes.withColumnRenamed("doc_id", "rep"))))
    release(spark)

    def links(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        out = written(_linked(pairs, _wanted_sets(docs, ids, n, late), percent).distinct())
        release(spark)
        return out

    reps = known.join(classes, ["k1", "k2", "n"]).select("doc_id", "rep")
    repeated = reps.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id")
    same = reps.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found, tested = same, None
    labelled = shared.select("g", "rep", "n", F.col("rep").alias("comp"))
    for turn in range(ROUNDS):
        pairs = written(_star(labelled, turn, percent))
        fresh = links(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        found = written(found.union(fresh))
        comp = components(found)
        labelled = written(shared.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("g", "rep", "n", F.coalesce("component", "rep").alias("comp")))
        release(spark)
        if fresh.isEmpty():
            break
    # near copies share many shingles: those with the same leading holder are dealt to one task, unless they are held by very many
    bucket = F.xxhash64("lead", F.pmod("g", F.greatest(F.col("holders") / BUCKET_HOLDERS, F.lit(1)).cast("long")))
    held = labelled.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("lead"), F.count("*").alias("holders"))
    mixed = held.where("lo <> hi").select("g", bucket.alias("bucket"))
    open_sets = labelled.join(mixed, "g").join(classes.select("rep", "n", "sig"), ["rep", "n"])
    rest = _likely(_across(open_sets, percent), percent)
    rest = written(rest.select("a", "b").join(tested, ["a", "b"], "left_anti"))
    release(spark)
    if not rest.isEmpty():
        comp = components(found.union(links(rest)))
    of_class = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    return sets.join(of_class, ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
