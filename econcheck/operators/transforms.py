"""Sequence transforms on long series tables, aware of gaps in the calendar.

``keys`` name one series.  A series has one row per period label, so its length
is bounded by the calendar and a series key cannot run hot; nothing here depends on
the number of series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.functions import periods as P

SERIES_KEYS = ["source", "indicator", "iso3", "edition"]


def filter_years(obs: DataFrame, start: Column | int | None = None, end: Column | int | None = None) -> DataFrame:
    """Inclusive range on the leading year; a NULL bound is open, an unreadable label fails any bound."""
    year = P.period_year(F.col("period"))
    lo = start if isinstance(start, Column) else F.lit(start)
    hi = end if isinstance(end, Column) else F.lit(end)
    unbounded = lo.isNull() & hi.isNull()
    inside = year.isNotNull() & F.coalesce(year >= lo, F.lit(True)) & F.coalesce(year <= hi, F.lit(True))
    return obs.filter(unbounded | inside)


def trim_null_edges(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Drop leading and trailing NULL runs per series, keep interior NULLs."""
    series = Window.partitionBy(*keys)
    known = F.when(F.col("value").isNotNull(), F.col("period"))
    edges = obs.withColumn("_first", F.min(known).over(series)).withColumn("_last", F.max(known).over(series))
    return edges.filter(F.col("period").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def _change(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, (current - previous) / F.abs(previous) * 100)


def _shifted_change(obs: DataFrame, keys: list[str], one_year: bool) -> DataFrame:
    """Pair each period with the one a fixed calendar step earlier.

    Every row is emitted at its own calendar index and at the index it is the
    predecessor of; one grouping brings the two together.  A missing predecessor
    leaves no pair, which is how a gap drops a row.
    """
    label = F.col("period")
    placed = obs.withColumn("_freq", P.period_frequency(label)).withColumn("_i", P.period_index(label))
    step = P.periods_per_year(F.col("_freq")) if one_year else F.lit(1)
    row = F.struct("period", "value")
    emitted = placed.filter(F.col("_i").isNotNull()).select(
        *keys,
        "_freq",
        F.explode(
            F.array(
                F.struct(F.col("_i").alias("at"), row.alias("row"), F.lit(True).alias("own")),
                F.struct((F.col("_i") + step).alias("at"), row.alias("row"), F.lit(False).alias("own")),
            )
        ).alias("e"),
    )
    paired = emitted.groupBy(*keys, "_freq", F.col("e.at").alias("_at")).agg(
        F.max(F.when(F.col("e.own"), F.col("e.row"))).alias("cur"),
        F.max(F.when(~F.col("e.own"), F.col("e.row"))).alias("prev"),
    )
    return paired.filter(F.col("cur").isNotNull() & F.col("prev").isNotNull()).select(
        *keys, F.col("cur.period").alias("period"), _change(F.col("cur.value"), F.col("prev.value")).alias("value")
    )


def year_over_year(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Percent change on the same period one year earlier; labels off the calendar grid give no rows."""
    return _shifted_change(obs, keys, one_year=True)


def period_change(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Percent change on the previous calendar period; daily labels use the previous observation."""
    daily = obs.filter(P.period_index(F.col("period")).isNull())
    before = Window.partitionBy(*keys).orderBy("period")
    by_position = (
        daily.select(*keys, "period", "value")
        .withColumn("_prev", F.lag(F.struct("value")).over(before))
        .filter(F.col("_prev").isNotNull())
        .select(*keys, "period", _change(F.col("value"), F.col("_prev.value")).alias("value"))
    )
    return _shifted_change(obs, keys, one_year=False).unionByName(by_position)


def rebase_index(obs: DataFrame, keys: list[str], base_period: str | None = None) -> DataFrame:
    """Values with the base period set to 100.

    The base is the requested period when the series has it, else the first
    non-NULL one.  Series whose base is NULL or zero keep their rows with a NULL
    value and ``usable_base = false``.
    """
    series = Window.partitionBy(*keys)
    has_value = F.col("value").isNotNull()
    first = F.min_by(F.struct("period", "value"), F.when(has_value, F.col("period"))).over(series)
    if base_period is not None:
        asked = F.max(F.when(F.col("period") == base_period, F.struct("period", "value"))).over(series)
        first = F.coalesce(asked, first)
    base = F.col("_base.value")
    usable = F.coalesce(base != 0, F.lit(False))
    return (
        obs.withColumn("_base", first)
        .withColumn("value", F.when(usable, F.col("value") / base * 100))
        .withColumn("base_period", F.col("_base.period"))
        .withColumn("usable_base", usable)
        .drop("_base")
    )


def latest_non_null(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Last period with a value, one row per series."""
    valued = obs.filter(F.col("value").isNotNull())
    return valued.groupBy(*keys).agg(F.max(F.struct("period", "value")).alias("o")).select(*keys, "o.*")


def latest_outturn(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Last value not marked as a projection, else the last value; flags skipped projections."""
    valued = obs.filter(F.col("value").isNotNull())
    projected = F.lower(F.coalesce(F.col("note"), F.lit(""))).contains("projection")
    o = F.struct("period", "value", "note")
    picked = valued.groupBy(*keys).agg(
        F.max(F.when(~projected, o)).alias("outturn"), F.max(o).alias("any"), F.count_if(projected).alias("n_projected")
    )
    chosen = F.coalesce(F.col("outturn"), F.col("any"))
    return picked.select(
        *keys,
        chosen["period"].alias("period"),
        chosen["value"].alias("value"),
        chosen["note"].alias("note"),
        (F.col("outturn").isNotNull() & (F.col("n_projected") > 0)).alias("projections_skipped"),
    )


def last_n(obs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Most recent ``n`` rows per series, interior NULLs included."""
    newest = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    return obs.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def mark_projections(obs: DataFrame, tag: Column) -> DataFrame:
    """Note observations at or after the boundary year carried by a vintage tag."""
    note = P.projection_note(P.tag_kind(tag), P.period_year(F.col("period")), P.boundary_from_tag(tag))
    kept = F.col("note") if "note" in obs.columns else F.lit(None).cast("string")
    return obs.withColumn("note", F.coalesce(note, kept))


def payload_boundaries(obs: DataFrame, today: Column, payload: list[str], edition_year: Column) -> DataFrame:
    """Projection boundary per payload from its own furthest year, over all economies in it."""
    horizons = obs.groupBy(*payload).agg(
        F.max(P.period_year(F.col("period"))).alias("horizon_year"), F.max(edition_year).alias("edition_year")
    )
    b = P.projection_boundary(F.col("horizon_year"), today, F.col("edition_year"))
    return horizons.withColumn("_b", b).select(
        *payload, "horizon_year", "edition_year", F.col("_b.boundary_year").alias("boundary_year"), F.col("_b.clamped").alias("clamped")
    )


def freshness(obs: DataFrame, keys: list[str], freq_letter: Column, today: Column) -> DataFrame:
    """Months between the newest non-NULL period and ``today`` against the frequency's budget."""
    newest = obs.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.max("period").alias("newest_period"), F.max(freq_letter).alias("_f")
    )
    lag = P.months_behind(F.col("newest_period"), today)
    budget = P.staleness_budget_months(F.col("_f"))
    return newest.select(*keys, "newest_period", lag.alias("lag_months"), budget.alias("budget_months"), (lag > budget).alias("stale"))


def edition_sentinels(
    horizon_year: Column,
    edition_year: Column,
    edition_month: Column,
    last_modified: Column,
    other_edition_year: Column,
    other_edition_month: Column,
    series_last_year: Column,
    boundary_year: Column,
    clamped: Column,
    database: Column,
) -> Column:
    """array<string> of disclosure codes for one edition-served series."""
    dated = edition_year.isNotNull() & edition_month.isNotNull()
    loaded = F.try_to_date(F.substring(last_modified, 1, 10), "yyyy-MM-dd")
    days = F.datediff(loaded, F.make_date(edition_year, edition_month, F.lit(1)))
    other_differs = (other_edition_year != edition_year) | (other_edition_month != edition_month)

    def code(when, name):
        return F.when(F.coalesce(when, F.lit(False)), F.lit(name))

    return F.array_compact(
        F.array(
            code(~dated, "edition_metadata_missing"),
            code(dated & (horizon_year - edition_year != P.PROJECTION_HORIZON_YEARS), "horizon_off_pattern"),
            code(dated & (days > 40), "reloaded_after_release"),
            code(clamped, "boundary_clamped"),
            code(dated & other_differs, "databases_at_different_editions"),
            code(database == "WEO", "rounded_to_one_decimal"),
            code((series_last_year > 0) & (series_last_year < boundary_year), "series_ends_before_boundary"),
        )
    )
