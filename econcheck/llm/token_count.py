"""Token counts of a piece vocabulary by heap-and-linked-list pair merging, without ids.

A text is cut where no piece of the vocabulary can reach across; each distinct stretch is
merged once: the adjacent pair of lowest rank is popped, again and again, and the count is
the number of symbols at the start minus the merges.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: characters of the stretches whose counts a worker keeps; beyond that it starts anew
HELD_CHARS = 1 << 24
#: longer stretches are counted but not kept
LONGEST_HELD = 256
SPACE = "▁"


class Vocabulary:
    """Pieces and their ranks of a ``.model`` file, and the normal form of texts as that file asks for it."""

    def __init__(self, model: bytes):
        self.model = model
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, every = self.library, range(self.library.get_piece_size())
        if any(map(lib.is_unused, every)):
            raise ValueError("vocabularies with unused pieces are cut again after merging; not supported")
        plain = [i for i in every if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i))]
        places = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        #: pieces of equal score share a rank; of equal ranks the leftmost pair is merged first
        self.rank = {lib.id_to_piece(i): places[lib.get_score(i)] for i in plain}
        self.in_bytes = any(map(lib.is_byte, every))
        joined = set("".join(p for p in self.rank if len(p) > 1)) - {SPACE}
        letters = "".join(map(re.escape, sorted(joined)))
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            letters += SPACE  # some piece reaches over a space: only characters of no longer piece part stretches
        #: a stretch with the spaces before it, or a run of characters that no longer piece holds
        self.stretches = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|[^{SPACE}{letters}]+" if letters else f"{SPACE}+|[^{SPACE}]+").findall
        self.held: dict[str, int] = {}
        self.held_chars = 0

    def count(self, text: str) -> int:
        """The number of tokens of a whole text; the empty text has none."""
        words = self.stretches(self.library.normalize(text))
        try:
            return sum(map(self.held.__getitem__, words))
        except KeyError:
            return sum(map(self._stretch, words))

    def _stretch(self, word: str) -> int:
        n = self.held.get(word)
        if n is None:
            n = self.merged(word)
            if len(word) <= LONGEST_HELD:
                if self.held_chars + len(word) > HELD_CHARS:
                    self.held.clear()
                    self.held_chars = 0
                self.held[word] = n
                self.held_chars += len(word)
        return n

    def merged(self, word: str) -> int:
        """Symbols minus merges; a character that is no piece counts once for each of its bytes."""
        rank, part, n = self.rank, list(word), len(word)
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
        merges = 0
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                r, i = heapq.heappop(heap)
                j = after[i]
                if j == n or not part[i] or rank.get(part[i] + part[j]) != r:
                    continue  # one of the two has been merged since
                part[i] += part[j]
                part[j] = ""
                merges += 1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := rank.get(part[i] + part[k])) is not None:
                        heapq.heappush(heap, (r, i))
                if (h := before[i]) >= 0 and (r := rank.get(part[h] + part[i])) is not None:
                    heapq.heappush(heap, (r, h))
        odd = [p for p in part if p and p not in rank]
        if not odd:
            return n - merges
        if self.in_bytes:
            return n - merges + sum(len(p.encode()) - 1 for p in odd)
        # without byte pieces neighbours that are no pieces make one unknown token
        return sum(1 if unknown else sum(1 for _ in run) for unknown, run in groupby(p not in rank for p in part if p))


_known: list[Vocabulary] = []  # of this Python worker: kept from task to task


def vocabulary(model: bytes) -> Vocabulary:
    if not _known or _known[0].model != model:
        _known[:] = [Vocabulary(model)]
    return _known[0]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``docs`` without ``text``, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    ``model_path`` is a pair-merging ``.model`` file without user-defined or unused pieces. Texts
    are counted whole, without begin or end marks; strings that look like special pieces are
    ordinary text. Null reads as empty, which has no tokens. Rows come back one for one, repeated
    rows and null ids included; columns with the names of the new ones are replaced. Memory in a
    task is one text, its stretches and a bounded store of counts.
    """
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    plain = docs.drop("n_bytes", "n_tokens", "over_limit")
    fields = [f for f in plain.schema.fields if f.name != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabulary(held.value).count
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            n = pa.array([count(t.as_py()) for t in texts], pa.int64())
            new = [pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)]
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*(f.name for f in fields), "n_bytes", "n_tokens", "over_limit"])

    more = T._parse_datatype_string("n_bytes long, n_tokens long, over_limit boolean").fields
    return plain.mapInArrow(rows, T.StructType([*fields, *more]))
