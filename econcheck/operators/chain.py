"""Source chains: which publisher answers a request.

A request falls back as a whole series and window, never period by period:
mixing two definitions in one series is the error the chain exists to prevent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.operators.retrieval import TRANSFORMS, get_series, with_citation
from econcheck.plans.joins import dim_join

__all__ = [
    "TRANSFORMS", "choose_source", "covered", "get_series", "registry_listing", "route_series_id", "series_attempts", "series_stats", "servable_chain",
    "substitute_codes", "with_citation",
]


def servable_chain(indicator_sources: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Chain rows whose source is not refused; with no row left a key is inactive."""
    if ledger is None:
        return indicator_sources
    refused = ledger.filter(F.col("license_verdict") == "refused").select("source")
    return indicator_sources.join(refused, "source", "left_anti")


def registry_listing(indicators: DataFrame, indicator_sources: DataFrame) -> DataFrame:
    """Key, unit, active flag and sources in resolution order (a chain has at most a few entries)."""
    chains = indicator_sources.groupBy("indicator").agg(
        F.array_sort(F.collect_list(F.struct("priority", "source"))).alias("c")
    )
    listed = indicators.join(chains, "indicator", "left")
    return listed.select(
        *indicators.columns,
        F.coalesce(F.array_join(F.transform("c", lambda x: x["source"]), ";"), F.lit("")).alias("sources"),
        F.col("c").isNotNull().alias("servable"),
    )


def choose_source(attempts: DataFrame, request: list[str], *also: Column) -> DataFrame:
    """First usable attempt per request.

    ``attempts``: request columns, ``priority``, ``source``, ``usable``,
    ``transient``.  A fallback is ``transient`` when any attempt skipped before it
    failed transiently, since that source may come back and change the answer.
    """
    usable_at = F.when(F.col("usable"), F.col("priority"))
    transient_at = F.when(~F.col("usable") & F.col("transient"), F.col("priority"))
    picked = attempts.groupBy(*request).agg(
        F.min_by("source", usable_at).alias("source"),
        F.min(usable_at).alias("priority"),
        F.min("priority").alias("_first"),
        F.min(transient_at).alias("_transient"),
        F.min_by("source", "priority").alias("primary_source"),
        *also,
    )
    fallback = F.col("priority") > F.col("_first")
    reason = F.when(F.col("_transient") < F.col("priority"), F.lit("transient")).otherwise(F.lit("definitive"))
    return picked.select(
        *request,
        "source",
        "priority",
        "primary_source",
        F.coalesce(fallback, F.lit(False)).alias("fallback_used"),
        F.when(fallback, reason).alias("fallback_reason"),
        (F.col("source").isNull() & F.col("_transient").isNotNull()).alias("failed_transiently"),
        *[c for c in picked.columns if c not in {*request, "source", "priority", "primary_source", "_first", "_transient"}],
    )


def series_attempts(requests: DataFrame, chain: DataFrame, stats: DataFrame, availability: DataFrame | None) -> DataFrame:
    """One row per request and chain entry with ``usable`` / ``transient``.

    ``requests``: indicator, iso3, strict.  ``stats``: source, indicator, iso3,
    n_values.  ``availability``: source, indicator, iso3, status with
    ``transient`` for failed loads; a series that is simply absent is definitive.
    """
    tried = dim_join(requests, chain.select("indicator", "source", "priority"), ["indicator"], "inner")
    first = F.min("priority").over(Window.partitionBy("indicator", "iso3", "strict"))
    tried = tried.withColumn("_first", first).filter(~F.col("strict") | (F.col("priority") == F.col("_first"))).drop("_first")
    out = tried.join(stats, ["source", "indicator", "iso3"], "left")
    if availability is None:
        out = out.withColumn("status", F.lit(None).cast("string"))
    else:
        out = out.join(availability.select("source", "indicator", "iso3", "status"), ["source", "indicator", "iso3"], "left")
    down = F.coalesce(F.col("status") == "transient", F.lit(False))
    return out.withColumn("transient", down).withColumn("usable", F.coalesce(F.col("n_values") > 0, F.lit(False)) & ~down)


def series_stats(obs: DataFrame) -> DataFrame:
    """Counts and value range per source, indicator and economy."""
    has = F.col("value").isNotNull()
    return obs.groupBy("source", "indicator", "iso3").agg(
        F.count_if(has).alias("n_values"),
        F.min(F.when(has, F.col("period"))).alias("first_period"),
        F.max(F.when(has, F.col("period"))).alias("last_period"),
    )


def covered(requests: DataFrame, areas: DataFrame, fixed_to: dict[str, str]) -> DataFrame:
    """Coverage of area-coded series: ``area`` when published, else ``absence`` says why.

    ``fixed_to`` maps a single-economy series to the only code it answers for;
    every other request needs its economy in the ``areas`` allowlist, never a guess
    from the two-letter code.
    """
    only = F.create_map(*[F.lit(x) for kv in fixed_to.items() for x in kv])
    fixed = F.try_element_at(only, F.col("indicator"))
    joined = dim_join(requests, areas, ["iso3"], "left")
    absence = F.when(
        fixed.isNotNull(), F.when(fixed != F.col("iso3"), F.lit("only_published_for_" + "|".join(sorted(set(fixed_to.values())))))
    ).when(F.col("area").isNull(), F.lit("area_not_published"))
    return joined.withColumn("absence", absence).withColumn("area", F.when(absence.isNull(), F.col("area")))


def substitute_codes(df: DataFrame, edition: str | None = None) -> DataFrame:
    """Fill ``{ISO3}`` / ``{ISO2}`` in series codes and pin ``:latest`` datasets to an edition."""
    code = F.replace(F.replace(F.col("code"), F.lit("{ISO3}"), F.col("iso3")), F.lit("{ISO2}"), F.coalesce(F.col("iso2"), F.lit("")))
    out = df.withColumn("code", code)
    if edition is not None:
        out = out.withColumn("dataset", F.regexp_replace("dataset", r":latest$", f":{edition}"))
    return out


def route_series_id(df: DataFrame, column: str, known_keys: list[str], known_imf_codes: list[str]) -> DataFrame:
    """Split an explicit series id into route, provider, dataset and code, or name what is wrong with it.

    Adds ``route``, ``provider``, ``dataset``, ``code``, ``route_error``.  Expects a
    nullable ``country`` column.
    """
    s = F.trim(F.col(column))
    low = F.lower(s)
    parts = F.split(s, "/")
    is_wdi = low.startswith("worldbank/") | low.startswith("wb/")
    is_imf, is_dbn, is_fred = low.startswith("imf/"), low.startswith("dbnomics/"), low.startswith("fred/")
    is_key = F.lower(s).isin(known_keys)
    route = (
        F.when(is_wdi, "wdi").when(is_imf, "imf_datamapper").when(is_fred, "fred").when(is_dbn, "dbnomics").when(is_key, "registry")
    )
    tail = F.regexp_extract(s, r"^[^/]*/(.*)$", 1)
    code = (
        F.when(is_wdi | is_imf | is_fred, tail)
        .when(is_dbn & (F.size(parts) >= 4), F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/"))
        .when(is_key, F.lower(s))
    )
    needs_country = (is_wdi | is_imf | is_key) & F.col("country").isNull()
    error = (
        F.when(route.isNull(), "unrecognized_series_id")
        .when(is_fred, "source_refused")
        .when(is_dbn & (F.size(parts) < 4), "malformed_series_id")
        .when(is_imf & ~code.isin(known_imf_codes), "unknown_imf_code")
        .when(needs_country, "country_required")
    )
    return (
        df.withColumn("route", route)
        .withColumn("provider", F.when(is_dbn, F.get(parts, 1)))
        .withColumn("dataset", F.when(is_dbn, F.get(parts, 2)))
        .withColumn("code", code)
        .withColumn("route_error", error)
    )
