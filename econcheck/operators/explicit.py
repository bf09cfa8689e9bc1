"""Series addressed by an explicit id instead of a registry key.

An id names a route, a provider, a dataset and a code; some routes need an economy
beside it, others have it inside the code.  Observations are stored once under that
long key (parts a route does not have are NULL) and matched null-safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from econcheck.dims import registry
from econcheck.functions.judge import is_percent_kind

KEY = ["route", "provider", "dataset", "code"]
#: routes that need an economy beside the id
BY_ECONOMY = ("wdi", "imf_datamapper")
ANYWHERE = ""  # economy of a series whose id already says which one
# Datasets whose projections are told by a vintage-year boundary.
HEURISTIC_ID = r"(?i)^(imf/|dbnomics/IMF/(WEO|FM):)"


def series_key(code: Column, route: Column) -> Column:
    """Codes of the publisher that ignores case, in one spelling."""
    return F.when(route == "wdi", F.upper(code)).otherwise(code)


def series_id(route: Column, provider: Column, dataset: Column, code: Column) -> Column:
    """Canonical spelling of an id."""
    return (
        F.when(route == "wdi", F.concat(F.lit("worldbank/"), code))
        .when(route == "imf_datamapper", F.concat(F.lit("imf/"), code))
        .when(route == "dbnomics", F.concat_ws("/", F.lit("dbnomics"), provider, dataset, code))
    )


def addressable(obs: DataFrame, sources: DataFrame) -> DataFrame:
    """Registry observations under the explicit ids they are published by.

    ``sources``: indicator, source, dataset, code as in the registry's source table;
    dataset is ``provider/dataset`` for the aggregator, whose codes carry the economy
    as ``{ISO3}``.  Sources without explicit ids are left out.
    """
    known = sources.where(F.col("source").isin(*BY_ECONOMY, "dbnomics")).select("indicator", "source", F.col("dataset").alias("_d"), F.col("code").alias("_c"))
    inside = F.col("source") == "dbnomics"
    rows = obs.join(known, ["indicator", "source"])
    return rows.select(
        F.col("source").alias("route"),
        F.when(inside, F.split_part("_d", F.lit("/"), F.lit(1))).alias("provider"),
        F.when(inside, F.split_part("_d", F.lit("/"), F.lit(2))).alias("dataset"),
        F.when(inside, F.replace(F.col("_c"), F.lit("{ISO3}"), F.col("iso3"))).otherwise(F.col("_c")).alias("code"),
        F.when(~inside, F.col("iso3")).alias("iso3"),
        "period", "year", "value", "note",
    )


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def pinned_ids(asked: DataFrame, series: DataFrame) -> DataFrame:
    """``asked(series, route, provider, dataset, code)`` with every ``:latest`` dataset at its newest stored edition.

    An edition counts for a series only if that series is in it.  Only the asked series
    are looked at; a series in no edition keeps ``:latest`` and finds nothing.
    """
    latest = asked.where(F.col("dataset").endswith(":latest")).select("series", "provider", "code", F.split_part("dataset", F.lit(":"), F.lit(1)).alias("base"))
    stored = series.where("route = 'dbnomics' and value is not null").select("provider", "code", "dataset", F.split_part("dataset", F.lit(":"), F.lit(1)).alias("base"))
    newest = latest.join(stored, ["provider", "code", "base"]).groupBy("series").agg(F.max("dataset").alias("_newest"))
    pinned = asked.join(newest, "series", "left")
    return pinned.withColumn("dataset", F.coalesce("_newest", "dataset")).drop("_newest")


def asked_series(claims: DataFrame, series: DataFrame, names: DataFrame | None) -> DataFrame:
    """One row per id asked for: its key, canonical spelling, whether it counts in percent, and how its status is told.

    ``claims``: series (the id as asked for) and the key columns, NULL for registry keys.
    ``names``: key columns, name, unit (optional).
    """
    asked = claims.where(F.col("route").isNotNull()).select("series", *KEY).distinct()
    pinned = pinned_ids(asked, series)
    if names is None:
        told = pinned.select("*", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("unit"))
    else:
        side = names.select("route", "provider", "dataset", series_key(F.col("code"), F.col("route")).alias("code"), "name", "unit").dropDuplicates(KEY)
        told = pinned.join(side, _same(pinned, side, KEY), "left").select(*[pinned[c] for c in pinned.columns], side["name"], side["unit"])
    sid = series_id(*[F.col(c) for c in KEY])
    return told.select(
        "series", *KEY, sid.alias("series_id"),
        is_percent_kind(F.lit(None).cast("string"), F.col("unit"), sid, F.col("name")).alias("text_percent"),
        F.when(sid.rlike(HEURISTIC_ID), "heuristic").when(F.col("route") == "wdi", "actual").otherwise("unknown").alias("status_class"),
    )


def asked_observations(asked: DataFrame, series: DataFrame) -> DataFrame:
    """Observations of the asked series in the shape of registry observations, the id in place of the key.

    One null-safe join on the long key keeps everything that nobody asked for out of the
    plan above.  ``iso3`` is ``ANYWHERE`` where the id says which economy.
    """
    side = series.select("route", "provider", "dataset", series_key(F.col("code"), F.col("route")).alias("code"), "iso3", "period", "year", "value", "note")
    found = side.join(asked.select("series", *KEY), _same(side, asked, KEY))
    by_economy = side["route"].isin(*BY_ECONOMY)
    return found.select(
        side["route"].alias("source"), asked["series"].alias("indicator"), F.when(by_economy, side["iso3"]).otherwise(F.lit(ANYWHERE)).alias("iso3"),
        side["period"], side["year"], side["value"], side["note"],
    )


def registry_imf_codes() -> list[str]:
    """Codes of the publisher's own endpoint that the registry knows."""
    return sorted({d["imf"][0] for d in registry.INDICATORS if "imf" in d})
