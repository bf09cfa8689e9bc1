"""Verdicts on a claimed figure, as one nested ``when`` expression.

Two callers share it: claim checking (service bands, optional caller tolerance)
and benchmark scoring (bands by revision class, optional sweep multiplier).
Comparisons use the raw doubles; rounding is a reporting concern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerance bands.
MATCH_PP = 0.06
MATCH_REL = 0.005
CLOSE_PP = {"A": 0.3, "B": 0.5, "C": 1.0}
CLOSE_REL_PERCENT = {"A": 0.02, "B": 0.03, "C": 0.05}
CLOSE_REL_LEVEL = 0.05
ZERO_OFFICIAL_CLOSE_ABS = 0.05
SWEEP_MULTIPLIERS = (0.5, 1.0, 2.0, 4.0)
SCALE_FACTORS = ((100.0, "percent_vs_decimal"), (1e3, "thousands"), (1e6, "millions"), (1e9, "billions"), (1e12, "trillions"))
SCALE_WINDOW = 0.02


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _bands(abs_diff, rel_diff, percent_kind, close_pp, close_rel_pct, mult):
    """Band ladder for a non-zero official value; ``mult`` scales every threshold."""
    m = _col(mult)
    match_rel = rel_diff <= F.lit(MATCH_REL) * m
    return (
        F.when(
            percent_kind,
            F.when((abs_diff <= F.lit(MATCH_PP) * m) | match_rel, F.lit("match"))
            .when((abs_diff <= close_pp * m) | (rel_diff <= close_rel_pct * m), F.lit("close"))
            .otherwise(F.lit("mismatch")),
        )
        .when(match_rel, F.lit("match"))
        .when(rel_diff <= F.lit(CLOSE_REL_LEVEL) * m, F.lit("close"))
        .otherwise(F.lit("mismatch"))
    )


def _ladder(claimed, official, when_nonzero, mult):
    """Rules that come before any band: equality, then a zero official value."""
    abs_diff = F.abs(claimed - official)
    return (
        F.when(claimed.isNull() | official.isNull(), F.lit(None).cast("string"))
        .when(abs_diff == 0, F.lit("match"))
        .when(
            official == 0,
            F.when(abs_diff <= F.lit(ZERO_OFFICIAL_CLOSE_ABS) * _col(mult), F.lit("close")).otherwise(F.lit("mismatch")),
        )
        .otherwise(when_nonzero)
    )


def judge(claimed, official, percent_kind, tolerance_abs=None, tolerance_pct=None) -> Column:
    """Service verdict: ``match`` / ``close`` / ``mismatch`` (NULL when either side is NULL)."""
    claimed, official, percent_kind = _col(claimed), _col(official), _col(percent_kind)
    abs_diff = F.abs(claimed - official)
    rel_diff = F.try_divide(abs_diff, F.abs(official))
    banded = _bands(abs_diff, rel_diff, percent_kind, F.lit(CLOSE_PP["A"]), F.lit(CLOSE_REL_PERCENT["A"]), 1.0)
    if tolerance_abs is not None or tolerance_pct is not None:
        t_abs = _col(tolerance_abs).cast("double")
        t_pct = _col(tolerance_pct).cast("double")

        def inside(k):
            return F.coalesce(abs_diff <= t_abs * k, F.lit(False)) | F.coalesce(rel_diff * 100 <= t_pct * k, F.lit(False))

        own = F.when(inside(1), F.lit("match")).when(inside(3), F.lit("close")).otherwise(F.lit("mismatch"))
        banded = F.when(t_abs.isNotNull() | t_pct.isNotNull(), own).otherwise(banded)
    return _ladder(claimed, official, banded, 1.0)


def judge_by_class(claimed, official, kind, revision_class, multiplier=1.0) -> Column:
    """Benchmark verdict; classes B and C only ever relax the close band of class A."""
    claimed, official, kind, cls = _col(claimed), _col(official), _col(kind), _col(revision_class)
    abs_diff = F.abs(claimed - official)
    rel_diff = F.try_divide(abs_diff, F.abs(official))

    def by_class(table):
        return F.when(cls == "A", F.lit(table["A"])).when(cls == "B", F.lit(table["B"])).when(cls == "C", F.lit(table["C"]))

    banded = _bands(abs_diff, rel_diff, kind == "percent", by_class(CLOSE_PP), by_class(CLOSE_REL_PERCENT), multiplier)
    return _ladder(claimed, official, banded, multiplier)


def is_within(verdict: Column) -> Column:
    return F.coalesce(verdict.isin("match", "close"), F.lit(False))


def is_percent_kind(registry_kind: Column, *texts: Column) -> Column:
    """Registry kind when known, else a ``%``/percent/pcent mark in unit, id or name."""
    text = F.concat_ws(" ", *texts) if texts else F.lit("")
    return F.when(registry_kind.isNotNull(), registry_kind == "percent").otherwise(text.rlike("(?i)%|percent|pcent"))


def ratio_to(claimed: Column, official: Column) -> Column:
    return F.when(official != 0, claimed / official)


def scale_hits(ratio: Column) -> Column:
    """Every scale factor (or its reciprocal) the ratio is within 2% of, as array<struct>."""
    factors = F.array(
        *[F.struct(F.lit(f).alias("factor"), F.lit(label).alias("label")) for f, label in SCALE_FACTORS]
    )

    def near(x, target):
        return F.abs(x - target) / target <= SCALE_WINDOW

    hits = F.filter(factors, lambda s: near(ratio, s["factor"]) | near(ratio, F.lit(1.0) / s["factor"]))
    return F.when(ratio > 0, hits).otherwise(F.filter(factors, lambda s: F.lit(False)))


def scale_diagnostics(ratio: Column) -> Column:
    """array<string> such as ``scale:1000:larger``."""
    side = F.when(ratio > 1, F.lit("larger")).otherwise(F.lit("smaller"))
    return F.transform(
        scale_hits(ratio),
        lambda s: F.concat(F.lit("scale:"), s["label"], F.lit(":"), side),
    )


def is_sign_flip(ratio: Column) -> Column:
    return F.coalesce((ratio < 0) & (F.abs(-ratio - 1) <= SCALE_WINDOW), F.lit(False))


def scale_slip(ratio: Column) -> Column:
    """First scale factor hit, as a factor above 1 or its reciprocal; NULL when none."""
    hit = F.element_at(scale_hits(ratio), 1)["factor"]
    return F.when(F.size(scale_hits(ratio)) > 0, F.when(ratio > 1, hit).otherwise(F.lit(1.0) / hit))


def signed_relative_error(claimed: Column, official: Column) -> Column:
    return F.when(official != 0, (claimed - official) / F.abs(official))
