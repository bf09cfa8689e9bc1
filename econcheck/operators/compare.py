"""One indicator from every source side by side, and country snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from econcheck.dims import registry
from econcheck.functions import periods as P
from econcheck.operators import transforms as X
from econcheck.operators.chain import choose_source, series_attempts, series_stats
from econcheck.plans.joins import dim_join, lookup_join

RECENT_PERIODS = 12
SNAPSHOT_RECENT = 8


def shared_periods(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Periods that every source with data for a key has a value for."""
    valued = obs.filter(F.col("value").isNotNull()).select(*keys, "source", "period").distinct()
    sources = valued.select(*keys, "source").distinct().groupBy(*keys).agg(F.count("*").alias("n_sources"))
    return (
        valued.groupBy(*keys, "period")
        .agg(F.count("*").alias("n"))
        .join(sources, keys)
        .filter(F.col("n") == F.col("n_sources"))
        .select(*keys, "period", "n_sources")
    )


def spread(low: Column, high: Column) -> Column:
    """Spread in percent of the mid-point of absolutes; NULL when the mid-point is about zero."""
    mid = (F.abs(low) + F.abs(high)) / 2
    return F.when(mid > 1e-9, F.round((high - low) / mid * 100, 2))


def compared(asks: DataFrame, obs: DataFrame, chain: DataFrame, availability: DataFrame | None = None) -> DataFrame:
    """One row per distinct ``asks(indicator, iso3, year)``: ``sources``, an array in source order, and ``comparison``.

    A year asked for reads that year and one either side of each series; without a year
    the last twelve valued periods of the series are read once, whoever asks.
    """
    series = ["source", "indicator", "iso3"]
    tried = dim_join(asks.withColumn("ask", F.struct("indicator", "iso3", "year")), chain.select("indicator", "source", "priority"), ["indicator"], "inner")
    if availability is None:
        tried = tried.withColumn("down", F.lit(False))
    else:
        failed = availability.where("status = 'transient'").select(*series, F.lit(True).alias("down")).distinct()
        tried = tried.join(failed, series, "left").withColumn("down", F.coalesce("down", F.lit(False)))
    asked = F.col("year").isNotNull()
    side = obs.select(*series, "period", "value", "note").withColumn("_year", P.period_year(F.col("period")))
    wanted = tried.where(~F.col("down"))
    keys = ["ask", "source"]
    years = wanted.where(asked).withColumn("_year", F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1)))
    near = years.join(side, [*series, "_year"]).select(*keys, "period", "value", "note")
    latest = wanted.where(~asked)
    listed = side.join(latest.select(*series).distinct(), series, "left_semi").select(*series, "period", "value", "note")
    recent = X.last_n(X.trim_null_edges(listed, series), series, RECENT_PERIODS)
    recent = latest.join(recent, series).select(*keys, "period", "value", "note")
    window = near.unionByName(recent).filter(F.col("value").isNotNull())

    asked = F.col("ask.year").isNotNull()
    n_sources = window.select(*keys).distinct().groupBy("ask").agg(F.count("*").alias("n_ok"))
    shared = (
        window.filter(~asked)
        .groupBy("ask", "period")
        .agg(F.count_distinct("source").alias("n"))
        .join(n_sources, "ask")
        .filter((F.col("n") == F.col("n_ok")) & (F.col("n_ok") >= 2))
        .groupBy("ask")
        .agg(F.max("period").alias("shared_period"))
    )
    at = F.struct("period", "value", "note")
    picks = (
        window.join(shared, "ask", "left")
        .groupBy(*keys)
        .agg(
            F.min(F.when(asked & F.col("period").startswith(F.col("ask.year").cast("string")), at)).alias("_year"),
            F.max(F.when(F.col("period") == F.col("shared_period"), at)).alias("_shared"),
            F.max(F.when(~asked, at)).alias("_last"),
            F.count("*").alias("n_window"),
            F.max("shared_period").alias("shared_period"),
        )
        .withColumn("_pick", F.coalesce("_year", "_shared", "_last"))
    )
    # a series without any value anywhere is told apart from one whose window is empty
    published = side.join(tried.select(*series).distinct(), series, "left_semi").where("value is not null").select(*series, F.lit(True).alias("published")).distinct()
    told = tried.drop("year").join(picks, keys, "left").join(published, series, "left")
    ok = F.col("n_window").isNotNull()
    error = F.when(F.col("down"), "transient_failure").when(F.col("published").isNull(), "no_published_data").when(~ok, "outside_window")
    one = F.struct(
        "priority", "source", ok.alias("ok"), F.col("_pick.period").alias("period"), F.col("_pick.value").alias("value"), F.col("_pick.note").alias("note"), error.alias("error"),
    )
    # the compared period of an ask, known to its failed sources as well
    per_ask = told.groupBy("ask").agg(F.array_sort(F.collect_list(one)).alias("sources"), F.max("shared_period").alias("_shared"))
    period = F.coalesce(F.col("ask.year").cast("string"), F.col("_shared"))
    per_ask = per_ask.withColumn("compared_period", period)
    usable = F.filter("sources", lambda s: s["ok"] & (s["period"] == F.col("compared_period")) & s["value"].isNotNull())
    values = F.transform(usable, lambda s: s["value"])
    low, high = F.array_min(values), F.array_max(values)
    comparison = F.when(
        F.size(values) >= 2,
        F.struct(F.col("compared_period").alias("period"), F.size(values).cast("long").alias("n_sources"), low.alias("low"), high.alias("high"),
                 (high - low).alias("spread_abs"), spread(low, high).alias("spread_pct")),
    )
    return per_ask.withColumn("comparison", comparison).drop("_shared")


def compare_sources(requests: DataFrame, obs: DataFrame, chain: DataFrame, availability: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per_source, comparison) for ``requests(request_id, indicator, iso3, year)``; ``year`` may be NULL.

    With a year: the first observation inside it, from a window of one year either
    side.  Without: the latest period all responding sources share among their last
    twelve.  Only sources whose label equals the compared period enter the spread.
    ``per_source`` keeps every source of the chain in place; one that failed or has
    nothing says why in ``error`` and the others are compared without it.  Equal
    requests are worked out once.
    """
    asks = requests.select("indicator", "iso3", "year").distinct()
    named = requests.select("request_id", "indicator", "iso3", F.struct("indicator", "iso3", "year").alias("ask"))
    found = lookup_join(named, compared(asks, obs, chain, availability), ["ask"], "request_id", "inner")
    per_source = found.select("request_id", "indicator", "iso3", F.explode("sources").alias("s"), "compared_period").select(
        "request_id", "indicator", "iso3", "s.priority", "s.source", "s.ok", "s.period", "s.value", "s.note", "compared_period", "s.error"
    )
    return per_source, found.where("comparison is not null").select("request_id", "comparison.*")


def country_snapshot(
    economies: DataFrame,
    obs: DataFrame,
    chain: DataFrame,
    keys: list[str] = registry.SNAPSHOT_KEYS,
    debt_key: str | None = registry.SNAPSHOT_DEBT_KEY,
    primary: str = registry.WDI,
    availability: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(values, missing) of the headline indicators for every economy.

    The latest non-NULL observation within the eight most recent ones of the
    primary source; debt comes from its own chain and prefers an outturn.
    """
    wanted = economies.select("iso3", F.explode(F.array(*[F.lit(k) for k in keys + ([debt_key] if debt_key else [])])).alias("indicator"))
    series = ["indicator", "iso3"]
    own = obs.filter((F.col("source") == primary) & F.col("indicator").isin(keys))
    recent = X.last_n(own, series, SNAPSHOT_RECENT)
    values = X.latest_non_null(recent, series).withColumn("source", F.lit(primary))
    if debt_key:
        debt = obs.filter(F.col("indicator") == debt_key)
        requests = wanted.filter(F.col("indicator") == debt_key).withColumn("strict", F.lit(False))
        chosen = choose_source(series_attempts(requests, chain, series_stats(debt), availability), ["indicator", "iso3"])
        served = debt.join(chosen.select("indicator", "iso3", "source"), ["source", "indicator", "iso3"])
        latest = X.latest_outturn(served, ["source", "indicator", "iso3"])
        values = values.unionByName(latest.select("indicator", "iso3", "period", "value", "source"))
    found = wanted.join(values, series)
    missing = wanted.join(values.select(*series), series, "left_anti")
    return found, missing
