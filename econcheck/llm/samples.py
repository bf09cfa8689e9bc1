"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def by_class(rows: DataFrame, label: str, cap: int) -> DataFrame:
    """About ``cap`` rows of each value of ``label``, chosen by a hash of doc_id; never more than twice that in all.

    The values of ``label`` are few (languages, 0 and 1). Counts come from all rows; the
    sample does not depend on how they are partitioned.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    at = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, cap * 1_000_000 // n))])
    chosen = rows.where(at < share[F.col(label)])
    return chosen.orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id").limit(2 * cap * len(counts)) if sum(counts.values()) > 2 * cap * len(counts) else chosen
