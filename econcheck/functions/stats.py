"""Interval and significance expressions (Wilson, exact McNemar)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column) -> Column:
    """struct(rate, lo, hi): Wilson 95% interval clamped to 0..1, NULL when n = 0."""
    n_ = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n_
    z2 = Z95 * Z95
    denom = 1 + z2 / n_
    center = (p + z2 / (2 * n_)) / denom
    half = (Z95 * F.sqrt((p * (1 - p)) / n_ + z2 / (4 * n_ * n_))) / denom
    return F.struct(
        p.alias("rate"),
        F.when(n_.isNotNull(), F.greatest(F.lit(0.0), center - half)).alias("lo"),
        F.when(n_.isNotNull(), F.least(F.lit(1.0), center + half)).alias("hi"),
    )


def rate_columns(k: Column, n: Column, name: str) -> list[Column]:
    """Reported rate and interval as four columns, 4 dp."""
    w = wilson(k, n)
    return [
        k.alias(f"{name}_k"),
        F.round(w["rate"], 4).alias(f"{name}_rate"),
        F.round(w["lo"], 4).alias(f"{name}_lo"),
        F.round(w["hi"], 4).alias(f"{name}_hi"),
    ]


def _log_factorial(n: Column) -> Column:
    """ln(n!), exact product up to 20, Stirling series beyond (error under 1e-13)."""
    x = n.cast("double")
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])
    xs = F.greatest(x, F.lit(1.0))
    stirling = (
        xs * F.ln(xs) - xs + 0.5 * F.ln(2 * math.pi * xs)
        + 1 / (12 * xs) - 1 / (360 * xs * xs * xs) + 1 / (1260 * xs * xs * xs * xs * xs)
    )
    return F.when(x <= 20, F.get(table, F.least(x, F.lit(20.0)).cast("int"))).otherwise(stirling)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided binomial p-value on the discordant counts.

    Works in log space, so it does not underflow for large counts.  The lower
    tail is summed downwards from min(b, c); terms further than 12 sqrt(n) + 60
    away are below 1e-100 of the total, so the sum is complete in double
    precision while the sequence stays short.
    """
    n = (b + c).cast("long")
    k = F.least(b, c).cast("long")
    log_pmf = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2.0)
    reach = F.least(k, (12 * F.sqrt(n.cast("double"))).cast("long") + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, j):
        i = k - j + 1  # going from P(X=i) to P(X=i-1)
        term = acc["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.when(
        reach >= 1,
        F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(reach, F.lit(1))), start, step)["total"],
    ).otherwise(F.lit(1.0))
    pmf = F.exp(log_pmf)
    p = 2 * pmf * tail - F.when(b == c, pmf).otherwise(F.lit(0.0))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))
