"""Ground truth: freeze, audit, drift, and the older vintage it is checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.dims import benchmark as B
from econcheck.functions import judge as J
from econcheck.plans.joins import lookup_join

VINTAGE_AGE_MONTHS = 18
NEAR_TIE_DAYS = 60


def freeze(questions: DataFrame, obs: DataFrame, retrieved_on: str) -> DataFrame:
    """Value of each question's cell with the years either side.

    ``obs``: iso3, indicator, year, value, note, series_id.  One equi-join per
    question and year offset, one grouping.
    """
    offsets = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    cells = questions.select("iso3", "indicator", "year").distinct()
    probes = cells.withColumn("_off", offsets).withColumn("_year", F.col("year") + F.col("_off"))
    side = obs.select("iso3", "indicator", F.col("year").alias("_year"), "value", "note", "series_id")
    projected = F.coalesce(F.col("note"), F.lit("")).rlike("(?i)projection|estimate")
    o = F.struct("value", projected.alias("is_projection"), "series_id")
    joined = probes.join(side, ["iso3", "indicator", "_year"], "left")
    found = joined.groupBy("iso3", "indicator", "year").agg(
        *[F.max(F.when((F.col("_off") == k) & F.col("series_id").isNotNull(), o)).alias(n) for k, n in ((0, "here"), (-1, "prev"), (1, "next"))]
    )
    out = questions.join(found, ["iso3", "indicator", "year"], "left")
    return out.select(
        *questions.columns,
        F.col("here.value").alias("value"), F.col("here.series_id").alias("series_id"),
        F.coalesce("here.is_projection", F.lit(False)).alias("is_projection"),
        F.col("prev.value").alias("prev_value"), F.coalesce("prev.is_projection", F.lit(False)).alias("prev_is_projection"),
        F.col("next.value").alias("next_value"), F.coalesce("next.is_projection", F.lit(False)).alias("next_is_projection"),
        F.lit(retrieved_on).alias("retrieved_on"),
    )


def integrity_flag(segment: Column, value: Column, is_projection: Column, retrieved_on: Column, expected_on: Column) -> Column:
    """Why a frozen row must not be used as is; NULL when it may."""
    headline = segment == "headline"
    return (
        F.when(headline & value.isNull(), F.lit("headline_value_null_at_snapshot"))
        .when(headline & is_projection, F.lit("headline_projection_at_snapshot"))
        .when(retrieved_on != expected_on, F.concat(F.lit("stale_cached_response:"), retrieved_on))
    )


def vintage_candidates(editions: DataFrame, on_day: str, current_edition: str | None) -> DataFrame:
    """Editions before ``on_day`` and before the current one, best instrument first.

    Ranked by 60-day steps of distance to eighteen months before ``on_day``, older
    first inside a step.  ``editions(edition)`` is a calendar list of a few rows.
    """
    day = F.to_date(F.lit(on_day))
    start = F.to_date(F.concat(F.col("edition"), F.lit("-01")))
    y = F.substring("edition", 1, 4).cast("int")
    usable = (start < day) & (y >= F.year(day) - 4)
    if current_edition is not None:
        usable = usable & (F.col("edition") < current_edition)
    step = F.floor(F.abs(F.datediff(start, F.add_months(day, -VINTAGE_AGE_MONTHS))) / NEAR_TIE_DAYS)
    order = Window.orderBy("step", "edition")
    return editions.select("edition").distinct().filter(usable).withColumn("step", step).withColumn("preference", F.row_number().over(order))


def pick_vintage(candidates: DataFrame, available: DataFrame) -> DataFrame:
    """First preferred edition that exists."""
    present = candidates.join(available.select("edition").distinct(), "edition", "left_semi")
    return present.agg(F.min_by("edition", "preference").alias("edition"))


def revision_check(truth: DataFrame, vintage: DataFrame, edition: str, capable: list[str], years: list[int] = B.RECENCY_YEARS) -> DataFrame:
    """Older-edition value per question served from, or asked on, a dated series.

    ``vintage``: iso3, indicator, year, value, note of that edition.
    """
    imf_served = F.col("series_id").rlike("(?i)^dbnomics/IMF/WEO|^imf/")
    in_scope = F.col("indicator").isin(capable) & (F.coalesce(imf_served, F.lit(False)) | (F.col("segment") == "recency"))
    targets = truth.filter(in_scope).select("qid", "segment", "indicator", "iso3", "year")
    projected = F.coalesce(F.col("note"), F.lit("")).rlike("(?i)projection|estimate")
    o = F.struct("value", projected.alias("is_projection"))
    cells = vintage.groupBy("iso3", "indicator").agg(
        F.map_from_entries(F.collect_list(F.struct("year", o.alias("o")))).alias("by_year")  # one edition: at most a century of years
    )
    out = lookup_join(targets, cells, ["iso3", "indicator"], "qid")
    here = F.try_element_at("by_year", F.col("year"))
    wanted = F.array(*[F.lit(y) for y in years])
    projections = F.map_filter("by_year", lambda y, v: F.array_contains(wanted, y))
    return out.select(
        "qid", "indicator", "iso3", "year", F.lit(edition).alias("vintage_edition"),
        F.when(F.col("by_year").isNull(), F.lit("cell_missing_in_vintage")).otherwise(F.lit("ok")).alias("status"),
        here["value"].alias("vintage_value"), F.coalesce(here["is_projection"], F.lit(False)).alias("vintage_is_projection"),
        F.when(F.col("segment") == "recency", projections).alias("vintage_projections"),
    )


def audit(snapshot: DataFrame, primary: DataFrame) -> DataFrame:
    """Compare frozen values with an independent reading of the primary source.

    ``primary``: qid, primary_value, read_error.  Both NULL is agreement; one NULL,
    a relative gap above 1e-9 or an unreadable primary is divergence.
    """
    j = snapshot.select("qid", F.col("value").alias("snapshot_value"), "series_id").join(primary, "qid", "full_outer")
    a, b = F.col("snapshot_value"), F.col("primary_value")
    gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))
    differs = F.when(a.isNull() & b.isNull(), F.lit(False)).when(a.isNull() | b.isNull(), F.lit(True)).when(a == b, F.lit(False)).otherwise(
        gap > B.AUDIT_REL_TOLERANCE
    )
    status = (
        F.when(F.col("series_id").isNull(), F.lit("no_series_in_snapshot"))
        .when(F.col("read_error").isNotNull(), F.concat(F.lit("primary_fetch_error:"), F.col("read_error")))
        .when(differs, F.lit("DIVERGENT"))
        .otherwise(F.lit("ok"))
    )
    divergent = F.when(F.col("series_id").isNull(), a.isNotNull()).when(F.col("read_error").isNotNull(), F.lit(True)).otherwise(differs)
    return j.select("qid", "snapshot_value", "primary_value", status.alias("status"), divergent.alias("divergent"))


def drift(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """Rows whose live value differs from the frozen one.

    Both sides: qid, value; ``frozen`` also kind and revision_class.
    """
    f, v = F.col("frozen_value"), F.col("live_value")
    j = frozen.select("qid", "kind", F.col("value").alias("frozen_value")).join(live.select("qid", F.col("value").alias("live_value")), "qid")
    return j.filter(f.isNotNull() & v.isNotNull() & (f != v)).select(
        "qid", "frozen_value", "live_value", F.abs(v - f).alias("abs_drift"),
        F.when(f != 0, F.abs((v - f) / f) * 100).alias("rel_drift_pct"),
        J.is_within(J.judge(f, v, F.col("kind") == "percent")).alias("still_within_tolerance"),
    )


def economy_weights(economies: DataFrame, obs: DataFrame, gdp_key: str = "gdp_current_usd", pop_key: str = "population") -> DataFrame:
    """Latest GDP and population per economy, NULL when never published."""
    latest = obs.filter(F.col("value").isNotNull() & F.col("indicator").isin(gdp_key, pop_key)).groupBy("iso3").agg(
        F.max_by("value", F.when(F.col("indicator") == gdp_key, F.col("year"))).alias("gdp"),
        F.max_by("value", F.when(F.col("indicator") == pop_key, F.col("year"))).alias("population"),
    )
    return economies.select("iso3").join(latest, "iso3", "left")
