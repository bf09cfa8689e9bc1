"""Exact index quantiles per group, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 32


def _range_of(v):
    """Non-decreasing range number of a value: signed steps of log2(1 + |v| * 1e6)."""
    return (F.signum(v) * F.floor(F.log2(F.abs(v) * 1e6 + 1) * STEPS_PER_OCTAVE)).cast("long")


def index_quantiles(df: DataFrame, group: list[str], value: str, probs: tuple[float, ...]) -> DataFrame:
    """Per group and probability the sorted value at ``min(n - 1, floor(p * n))``.

    Values are counted per distinct value first.  Range counts (a few thousand per
    group) locate the range holding each index; only those ranges are then ordered.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_r", _range_of(F.col("_v")))
    )
    ranges = counted.groupBy(*group, "_r").agg(F.sum("_c").alias("_c"))
    ordered = Window.partitionBy(*group).orderBy("_r")
    ranges = ranges.select(
        *group,
        "_r",
        F.coalesce(F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"),
        F.sum("_c").over(Window.partitionBy(*group)).alias("n"),
    )
    wanted = ranges.withColumn("p", F.explode(F.array(*[F.lit(p) for p in probs]))).withColumn(
        "_i", F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n")))
    ).filter((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to")))
    inside = Window.partitionBy(*group, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.join(wanted, [*group, "_r"])
        .withColumn("_upto", F.col("_from") + F.sum("_c").over(inside))
        .filter(F.col("_upto") > F.col("_i"))
        .groupBy(*group, "n", "p")
        .agg(F.min("_v").alias("value"))
    )
