"""Benchmark frame: ranked economies, eligible cells, exclusions and attrition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from econcheck.dims import benchmark as B
from econcheck.plans.joins import dim_join
from econcheck.plans.ranking import rank_descending


def tier_of_rank(rank: Column) -> Column:
    tier = F.lit(B.LAST_TIER)
    for name, upper in reversed(B.TIER_UPPER_RANK):
        tier = F.when(rank <= upper, F.lit(name)).otherwise(tier)
    return tier


def tiers(economies: DataFrame, latest: DataFrame) -> DataFrame:
    """Rank economies by latest level (descending, NULLs last, ties by code) and cut into tiers."""
    valued = economies.join(latest, "iso3", "left")
    return rank_descending(valued, "gdp", "iso3").withColumn("tier", tier_of_rank(F.col("rank")))


def complete_grid(economies: DataFrame, indicators: list[str], years: list[int]) -> DataFrame:
    """economy x indicator x year; indicators and years are short constant lists."""
    return economies.withColumn("indicator", F.explode(F.array(*[F.lit(i) for i in indicators]))).withColumn(
        "year", F.explode(F.array(*[F.lit(y) for y in years]))
    )


def map_constant(keys: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), keys)


def enumerate_frame(
    grid: DataFrame,
    obs: DataFrame,
    fetches: DataFrame,
    probe_indicators: list[str] = B.PROBE_INDICATORS,
    revision_class: dict[str, str] = B.REVISION_CLASS,
) -> DataFrame:
    """Eligibility and reason per cell.

    ``obs``: iso3, indicator, year, value, note, source.  ``fetches``: iso3,
    indicator, status (``ok``, ``transient``, or another failure code); a missing
    row means nothing was retrieved in the window.
    """
    side = obs.select("iso3", "indicator", "year", "value", "note", "source", F.lit(True).alias("_present"))
    cells = grid.join(fetches, ["iso3", "indicator"], "left").join(side, ["iso3", "indicator", "year"], "left")
    probe = F.col("indicator").isin(probe_indicators)
    loaded = F.coalesce(F.col("status") == "ok", F.lit(False))
    projected = F.coalesce(F.col("note"), F.lit("")).rlike("(?i)projection|estimate")
    reason = (
        F.when(F.col("status") == "transient", "fetch_failed_transient")
        .when(~loaded, F.coalesce("status", F.lit("no_series_in_window")))
        .when(F.col("_present").isNull(), "missing_year")
        .when(F.col("value").isNull(), "null_value")
        .when(projected, "projection")
        .when(probe, "null_probe_indicator")
    )
    usable = loaded & F.col("value").isNotNull()
    return (
        cells.withColumn("reason", reason)
        .withColumn("eligible", reason.isNull())
        .withColumn("value", F.when(usable, F.col("value")))
        .withColumn("source", F.when(usable & ~projected, F.col("source")))
        .withColumn("null_probe_indicator", probe)
        .withColumn("revision_class", map_constant(F.col("indicator"), revision_class))
        .drop("_present", "status", "note")
    )


def derived_exclusions(cells: DataFrame, world_source: str, imf_sources: list[str]) -> DataFrame:
    """Economies covered by the dated IMF sources only: excluded for every indicator."""
    headline = cells.filter(~F.col("null_probe_indicator"))
    seen = headline.groupBy("iso3").agg(
        F.bool_or(F.col("source") == world_source).alias("world"), F.bool_or(F.col("source").isin(imf_sources)).alias("imf")
    )
    only = seen.filter(~F.coalesce("world", F.lit(False)) & F.coalesce("imf", F.lit(False)))
    return only.select("iso3", F.lit("weo_only_entity").alias("derived_reason"))


def apply_exclusions(cells: DataFrame, stated: DataFrame, derived: DataFrame) -> DataFrame:
    """Mark excluded cells.

    ``stated``: iso3, indicators (NULL = all), years, reason and optionally ordinal - a
    hand-kept list of a few rows; of several that match, the last by ordinal (without one,
    by reason) gives the reason.  ``derived`` has one row per economy.
    """
    place = F.col("ordinal") if "ordinal" in stated.columns else F.lit(0)
    rules = stated.withColumn("_o", place.cast("long")).select("_o", "iso3", F.col("indicators").alias("_i"), F.col("years").alias("_y"), F.col("reason").alias("_r"))
    rules = rules.groupBy("iso3").agg(F.array_sort(F.collect_list(F.struct("_o", "_r", "_y", "_i"))).alias("_rules"))
    out = dim_join(cells, rules, ["iso3"], "left").join(derived, "iso3", "left")
    ind, year = F.col("indicator"), F.col("year")
    hits = F.filter(
        F.coalesce("_rules", F.array().cast("array<struct<_o:bigint,_r:string,_y:array<int>,_i:array<string>>>")),
        lambda r: (r["_i"].isNull() | F.array_contains(r["_i"], ind)) & F.array_contains(r["_y"], year),
    )
    stated_reason = F.when(F.size(hits) > 0, F.element_at(hits, -1)["_r"])
    reason = F.coalesce("derived_reason", stated_reason)
    return out.withColumn("exclusion_reason", reason).withColumn("excluded", reason.isNotNull()).drop("_rules", "derived_reason")


def attrition(cells: DataFrame, reasons: list[str]) -> DataFrame:
    """Counts per tier, indicator and reason, one column per reason plus the total."""
    shown = F.when(F.col("excluded"), F.concat(F.lit("excluded_"), F.col("exclusion_reason"))).otherwise(
        F.when(F.col("eligible"), F.lit("eligible")).otherwise(F.col("reason"))
    )
    counted = cells.filter(~F.col("null_probe_indicator")).withColumn("_r", shown)
    return counted.groupBy("tier", "indicator").agg(
        *[F.count_if(F.col("_r") == r).alias(r) for r in reasons], F.count("*").alias("total")
    )


def missing_cells(grid: DataFrame, obs: DataFrame, on: list[str]) -> DataFrame:
    """Grid cells without a value."""
    return grid.join(obs.filter(F.col("value").isNotNull()).select(*on), on, "left_anti")
