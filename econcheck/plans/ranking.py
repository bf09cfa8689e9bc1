"""Exact row numbers without sorting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.plans.durable import cut_lineage

_IN_PARTITION = (1 << 33) - 1  # a row's own number within its partition in monotonically_increasing_id


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row numbers over all rows in ``order``, from 1; rows equal in all of ``order`` come in any order.

    Spark samples the ordering keys and deals rows out by range, as many ranges as the
    session shuffles to, so ranges are even whatever the keys look like; only a run of
    rows that are equal in the whole order stays together.  Ranges are sorted and numbered
    by themselves, written once, and shifted by the sizes of the ranges before: one count
    per range is all that meets in one task.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the cut makes sizes and numbers come from the same ranges, also after a lost executor
    placed = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per range
    numbered = placed.join(F.broadcast(offsets), "_range").withColumn(out, (F.col("_at") + F.col("_offset") + 1).cast("long"))
    return numbered.drop("_range", "_at", "_offset")


def rank_descending(df: DataFrame, value: str, tie: str, out: str = "rank") -> DataFrame:
    """Row number over all rows: ``value`` descending, NULLs last, ties by ``tie``."""
    return number_rows(df, [F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_first()], out)


def row_number_by_hash(df: DataFrame, key: Column, out: str = "position") -> DataFrame:
    """Row number over all rows in the order of a hex hash key."""
    return number_rows(df.withColumn("_key", key), [F.col("_key").asc()], out).drop("_key")
