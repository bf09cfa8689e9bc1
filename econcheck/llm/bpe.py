"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by joining pieces.

``merge_words`` is the fold as Spark higher-order functions over a literal rank map. Whole
corpora go through ``encode_texts``: the same fold per distinct word of a task, next to the
texts, so that neither texts nor words are shuffled (README has the figures of both).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: most words a Python worker keeps (about 160 bytes each); those used since the last turn outlive it
WORDS_HELD = 1 << 18
_RANK_SLOTS = 1 << 16
_NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 piece and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """The pieces of a word (an array of binary) by folding ranked merges with higher-order functions.

    ``word`` is a column of strings, one match of the splitting pattern each; null gives null
    and the empty word no pieces. The ranks are a literal: an array of small maps, of which
    the checksum of a piece chooses one.
    """
    slots: list[dict[str, int]] = [{} for _ in range(_RANK_SLOTS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        slots[zlib.crc32(text.encode()) % _RANK_SLOTS][text] = rank
    literal = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")

    def rank(a: Column, b: Column) -> Column:
        both = F.concat(a, b)
        return F.coalesce(F.try_element_at(F.element_at(literal, (F.pmod(F.crc32(both.cast("binary")), F.lit(_RANK_SLOTS)) + 1).cast("int")), both), F.lit(_NONE))

    def fold(parts: Column) -> Column:
        none = F.array().cast("array<int>")
        start = F.struct(parts.alias("p"), F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts)), rank).alias("r"))

        def merged(s: Column, k: Column) -> Column:
            p, r = s["p"], s["r"]
            both = F.concat(F.get(p, k - 1), F.get(p, k))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), k - 1), F.array(both), F.slice(p, k + 2, F.size(p))).alias("p"),
                F.concat(
                    F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))),
                    F.when(k > 1, F.array(rank(F.get(p, k - 2), both))).otherwise(none),
                    F.when(k < F.size(r), F.array(rank(both, F.get(p, k + 1)))).otherwise(none),
                    F.slice(r, k + 2, F.size(r)),
                ).alias("r"),
            )

        def step(s: Column, _: Column) -> Column:
            low = F.coalesce(F.array_min(s["r"]), F.lit(_NONE))
            return F.when(low == _NONE, s).otherwise(F.get(F.transform(F.array(F.array_position(s["r"], low).cast("int")), lambda k: merged(s, k)), F.lit(0)))

        return F.aggregate(F.sequence(F.lit(1), F.size(parts)), start, step, lambda s: s["p"])

    parts = F.filter(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: c != "")
    pieces = F.get(F.transform(F.array(parts), lambda p: F.when(F.size(p) == 0, p).otherwise(fold(p))), F.lit(0))
    return F.when(word.isNotNull(), F.transform(pieces, lambda p: F.encode(p, "ISO-8859-1")))


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their binary pieces joined; null if an id is not in the vocabulary."""
    size = max(ranks.values()) + 1
    table: list[str | None] = [None] * size
    for piece, rank in ranks.items():
        table[rank] = piece.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(table)), "array<string>")
    joined = F.aggregate(ids, F.lit(""), lambda s, i: F.concat(s, F.get(literal, i.cast("int"))))
    return F.encode(joined, "ISO-8859-1")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern``; texts of letters below U+0250 use an equal pattern of the faster engine."""
    full = regex.compile(pattern)
    if "\\p{" not in pattern:
        return full.findall
    low = [chr(c) for c in range(0x250)]
    classes = {k: "".join(re.escape(c) for c in low if unicodedata.category(c).startswith(k)) for k in ("L", "N")}
    quick = re.compile(pattern.replace(r"\p{L}", "\0L").replace(r"\p{N}", "\0N").replace("[^\\s\0L\0N]", f"[^\\s{classes['L']}{classes['N']}]").replace("\0L", f"[{classes['L']}]").replace("\0N", f"[{classes['N']}]"))
    # \s of the two engines differs in the separators U+001C to U+001F
    odd = re.compile("[\x1c-\x1fɐ-\U0010ffff]")

    def split(text: str) -> list[str]:
        return full.findall(text) if odd.search(text) else quick.findall(text)

    return split


class Words(dict):
    """Word -> its ids as little-endian 32-bit numbers, for distinct words seen lately.

    Two generations of half ``WORDS_HELD`` bound the memory: a full one becomes ``older``, words
    found there come back without a fold, and the rest goes with the next turn.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict[str, bytes] = {}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = [(ranks[p[:i]] << 32 | ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        table = np.array(sorted(merges), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.rank = table[:, 0], table[:, 1].astype(np.int32)

    def encode(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of words; words not held are folded together."""
        asked = set().union(*lists)
        new = asked.difference(self)
        if len(self) + len(new) > WORDS_HELD // 2:
            self.older = dict(self)
            self.clear()
            new = asked
        known = {w: ids for w in new if (ids := self.older.get(w)) is not None}
        self.update(known)
        self._learn(new.difference(known))
        return [b"".join(map(self.__getitem__, words)) for words in lists]

    def _learn(self, words: set[str]) -> None:
        rest: list[tuple[int, str, bytes]] = []
        for word in words:
            raw = word.encode()
            own = self.ranks.get(raw)
            if own is not None:
                self[word] = own.to_bytes(4, "little")
            elif len(raw) > 48:
                self[word] = _folded_long([raw[i : i + 1] for i in range(len(raw))], self.ranks)
            else:
                rest.append((len(raw), word, raw))
        rest.sort(key=lambda x: x[0])
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            ids, count = self._fold(np.frombuffer(b"".join(x[2] for x in part), dtype=np.uint8), np.array([x[0] for x in part]))
            end = np.cumsum(count) * 4
            for (_, word, _), i, j in zip(part, (end - count * 4).tolist(), end.tolist(), strict=True):
                self[word] = ids[i:j]

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], _NONE).astype(np.int32)

    def _fold(self, data: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Fold ranked merges over the byte arrays of many words at once, one merge of each word a step.

        A piece stands by its id, which is its rank. A step merges, in every word, the
        adjacent pair of lowest rank, the leftmost first, until no word has a pair with a rank.
        """
        wide = int(size.max())
        piece = np.full((len(size), wide + 1), -1, dtype=np.int32)
        piece[:, :wide][np.arange(wide) < size[:, None]] = self.byte[data]
        rank = np.full((len(size), wide), _NONE, dtype=np.int32)
        both = np.nonzero(piece[:, 1:] >= 0)
        rank[both] = self._ranks_of(piece[both], piece[both[0], both[1] + 1])
        live = np.arange(len(size))
        column = np.arange(wide + 1)
        while len(live):
            r = rank[live]
            k = r.argmin(1)
            low = r[np.arange(len(live)), k]
            ok = low < _NONE
            live, k, low, r = live[ok], k[ok], low[ok], r[ok]
            if not len(live):
                break
            row = np.arange(len(live))
            p = np.take_along_axis(piece[live], np.minimum(column + (column > k[:, None]), wide), 1)
            p[row, k] = low
            r = np.take_along_axis(r, np.minimum(column[:-1] + (column[:-1] >= k[:, None]), wide - 1), 1)
            r[:, -1] = _NONE
            left = np.flatnonzero(k > 0)
            r[left, k[left] - 1] = self._ranks_of(p[left, k[left] - 1], low[left])
            after = p[row, k + 1]
            r[row, k] = np.where(after >= 0, self._ranks_of(low, after), _NONE)
            piece[live], rank[live] = p, r
        return piece[piece >= 0].astype("<u4").tobytes(), (piece >= 0).sum(1)


def _folded_long(parts: list[bytes], ranks: dict[bytes, int]) -> bytes:
    """The fold of one long word, with a heap of pairs."""
    n = len(parts)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], live[j], after[i] = a + b, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left, parts[left], parts[right]))
    return struct.pack(f"<{sum(live)}I", *(ranks[p] for p, ok in zip(parts, live, strict=True) if ok))


_held: list = []  # of this Python worker: the words it has folded, kept from task to task


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Texts -> the ids of each as little-endian unsigned 32-bit numbers."""
    if not _held or _held[0].ranks is not ranks and _held[0].ranks != ranks:
        _held[:] = [Words(ranks)]
    words, split = _held[0], splitter(pattern)
    return lambda texts: words.encode([split(t) for t in texts])


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of at most 512 rows and about a megabyte of text, with their texts."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        lo, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(values[i].as_py() or "")
            size += len(texts[-1])
            if size > 1 << 20 or len(texts) == 512 or i + 1 == batch.num_rows:
                yield batch.slice(lo, i + 1 - lo), texts
                lo, size, texts = i + 1, 0, []


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit numbers in a binary) of the whole ``text``; null reads as empty."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    plain = docs.drop("ids")

    def rows(batches):
        encode = encoder(held.value, pattern)
        for part, texts in _texts(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(encode(texts), pa.binary())], names=[*part.schema.names, "ids"])

    return plain.mapInArrow(rows, T.StructType([*plain.schema.fields, T.StructField("ids", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256; without ``text`` unless ``keep``.

    Encodes every whole text, then decodes those ids: the digests are of the ids as
    little-endian unsigned 32-bit numbers and of the decoded bytes. Null reads as empty (no
    ids). Columns of these names are replaced; rows come back one for one.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    plain = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    fields = [f for f in plain.schema.fields if keep or f.name != "text"]
    little = sys.byteorder == "little"

    def rows(batches):
        encode = encoder(held.value, pattern)
        pieces = {rank: piece for piece, rank in held.value.items()}.__getitem__
        for part, texts in _texts(batches, "text"):
            n, a, b = [], [], []
            for ids in encode(texts):
                numbers = np.frombuffer(ids, dtype="<u4")
                n.append(len(numbers))
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(b"".join(map(pieces, memoryview(ids).cast("I") if little else numbers.tolist()))).hexdigest())
            columns = [part.column(part.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[*(f.name for f in fields), "n_tokens", "ids_sha256", "decoded_sha256"])

    more = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string").fields
    return plain.mapInArrow(rows, T.StructType([*fields, *more]))
