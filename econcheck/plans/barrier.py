"""Compute an expensive struct once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, struct: Column) -> DataFrame:
    """Append the fields of ``struct`` as columns.

    Going through a one-element ``inline`` keeps the optimizer from copying the
    expression into every later filter and projection that mentions a field.
    """
    return df.select("*", F.inline(F.array(struct)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
