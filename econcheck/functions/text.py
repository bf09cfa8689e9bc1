"""Text helpers: name keys, one-edit neighbourhoods, number and latency labels."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folds(form: str, lower: bool) -> tuple[str, str]:
    """Characters that a Unicode normal form turns into one character (marks left out), and that character."""
    pairs = []
    for c in map(chr, range(0x80, 0x30000)):
        shown = "".join(x for x in unicodedata.normalize(form, c) if form != "NFD" or not unicodedata.combining(x))
        shown = shown.lower() if lower else shown
        if len(shown) == 1 and shown != c:
            pairs.append((c, shown))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache
def _tables() -> tuple[tuple[str, str], tuple[str, str]]:
    return _folds("NFD", lower=True), _folds("NFKC", lower=False)


def plain_forms(text: Column) -> Column:
    """Compatibility characters of one letter (full-width and styled forms) as their plain form."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_tables()[1])).otherwise(text)


def name_key(name: Column) -> Column:
    """Lower case, marks stripped (canonical decomposition), punctuation to blanks, blanks collapsed."""
    s = F.lower(name)
    s = F.when(s.rlike(r"[^\x00-\x7F]"), F.translate(s, *_tables()[0])).otherwise(s)
    s = F.regexp_replace(s, r"\p{M}", "")
    s = F.regexp_replace(s, r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def short_name(name: Column) -> Column:
    """Part before the first comma or opening bracket."""
    return F.regexp_extract(name, r"^([^,(]*)", 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or adjacent swap apart (or equal)."""
    near = F.levenshtein(a, b, 1) >= 0
    same_length = F.length(a) == F.length(b)
    # first position where the two differ, then compare with that pair swapped
    i = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
        F.lit(0),
        lambda acc, k: F.when((acc == 0) & (F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))), k).otherwise(acc),
    )
    swapped = F.concat(
        F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)
    )
    return near | (same_length & (i > 0) & (swapped == b))


def deletion_keys(s: Column) -> Column:
    """The string and every version with one character removed.

    Two strings within one edit or swap always share a key, so one-edit matching
    becomes an equi-join.
    """
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
        lambda k: F.concat(F.substr(s, F.lit(1), k - 1), F.substr(s, k + 1)),
    )
    return F.array_distinct(F.concat(F.array(s), cuts))


def grams(s: Column, k: Column) -> Column:
    """Distinct substrings of length ``k``; empty array when the string is shorter."""
    n = F.length(s) - k + 1
    seq = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(seq, lambda i: F.substr(s, i, k)))


def format_figure(v: Column) -> Column:
    """Thousands separators; up to four decimals, none from a million on."""
    small = F.regexp_replace(F.regexp_replace(F.format_number(v, 4), r"0+$", ""), r"\.$", "")
    return F.when(F.abs(v) >= 1e6, F.format_number(v, 0)).otherwise(small)


def round_half_up(v: Column, digits: int) -> Column:
    """Report rounding with a 1e-9 nudge away from zero before rounding."""
    scale = 10.0**digits
    nudge = F.when(v >= 0, F.lit(1e-9)).otherwise(F.lit(-1e-9))
    return F.floor((v + nudge) * scale + 0.5) / scale


def latency_bucket(ms: Column) -> Column:
    # Bucket edges and labels.
    return (
        F.when(ms.isNull() | F.isnan(ms) | (ms < 0), F.lit("unknown"))
        .when(ms < 50, F.lit("lt50ms"))
        .when(ms < 200, F.lit("lt200ms"))
        .when(ms < 500, F.lit("lt500ms"))
        .when(ms < 1000, F.lit("lt1s"))
        .when(ms < 3000, F.lit("lt3s"))
        .otherwise(F.lit("gte3s"))
    )


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace every ``{NAME}`` placeholder; a NULL value becomes the empty string."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
