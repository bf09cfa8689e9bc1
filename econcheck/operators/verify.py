"""Claim verification as a set operation.

The expensive part (which source answers, which observation matches, what the
neighbouring years and the previous edition say) depends only on the looked-up
cell.  It is computed once per distinct (indicator, economy, period, vintage) and
joined back to the claims on a salted key; judging a claim is then a row-local
expression.  A cell that a third of all claims refer to costs one lookup row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from econcheck.functions import judge as J
from econcheck.functions import periods as P
from econcheck.functions.text import format_figure
from econcheck.operators import explicit as E
from econcheck.operators.chain import choose_source, route_series_id, series_stats
from econcheck.operators.resolve import resolve_names
from econcheck.plans.joins import dim_join, lookup_join

MAX_TEXT = 200
NEARBY_YEARS = 2
NEARBY_SHOWN = 6
LIVE = ""  # edition of the series a source serves today


def validate_claims(claims: DataFrame, indicators: DataFrame, imf_codes: list[str] | None = None) -> DataFrame:
    """Normalise period and vintage date, attach the registry row, name the first fault.

    A faulty claim gets ``claim_error`` and the others proceed.  With ``imf_codes`` (the
    known codes of that route) an indicator outside the registry may be an explicit
    series id; ``series`` and ``place`` then say what is looked up and for which economy.
    """
    out = (
        claims.withColumn("claimed_value", F.col("claimed_value").try_cast("double"))
        .withColumn("period", P.normalize_period(F.col("period")))
        .withColumn("year", P.period_year(F.col("period")))
        .withColumn("as_of_day", P.as_of_date(F.col("as_of")))
        .withColumn("_key", F.lower(F.trim("indicator")))
    )
    known = indicators.select(F.col("indicator").alias("_key"), "kind", "modeled", "active", "has_editions")
    out = route_series_id(dim_join(out, known, ["_key"]), "indicator", [], imf_codes or [])
    listed = F.col("kind").isNotNull()
    by_id = ~listed & F.col("route").isNotNull() if imf_codes is not None else F.lit(False)
    # a refused route stays known, so that its claims say why
    for c in E.KEY:
        out = out.withColumn(c, F.when(by_id, F.col(c)))
    out = out.withColumn("code", E.series_key(F.col("code"), F.col("route")))
    v = F.col("claimed_value")
    too_long = F.greatest(*[F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("indicator", "country", "period", "as_of")]) > MAX_TEXT
    placed = listed | F.col("route").isin(*E.BY_ECONOMY)
    fault = (
        F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "claimed_value_not_a_number")
        .when(too_long, "text_too_long")
        .when(~F.coalesce(P.is_valid_period(F.col("period")), F.lit(False)), "malformed_period")
        .when(~listed & F.col("route").isNull(), "unknown_indicator")
        .when(listed & F.col("country").isNull(), "country_required")
        .when(~listed & F.col("as_of").isNotNull(), "as_of_not_supported")
        .when(~listed & F.col("route_error").isNotNull(), F.col("route_error"))
        .when(placed & F.col("iso3").isNull(), "country_not_resolved")
        .when(F.col("as_of").isNotNull() & F.col("as_of_day").isNull(), "malformed_as_of")
        .when(F.col("as_of").isNotNull() & ~F.col("has_editions"), "as_of_not_supported")
    )
    spelled = E.series_id(*[F.col(c) for c in E.KEY])
    return (
        out.withColumn("claim_error", fault)
        .withColumn("edition", F.coalesce(P.edition_at(F.col("as_of_day")), F.lit(LIVE)))
        .withColumn("series", F.when(listed, F.col("_key")).otherwise(spelled))
        .withColumn("place", F.when(placed, F.col("iso3")).otherwise(F.lit(E.ANYWHERE)))
        .drop("_key")
    )


def match_cells(cells: DataFrame, obs: DataFrame, series: list[str], carry: list[str] = [], previous: str | None = None) -> DataFrame:
    """Find each cell's observation and what surrounds it.

    ``cells``: the ``series`` columns plus ``period``, ``year`` and ``carry``,
    distinct.  Adds ``official``, ``matched_period``, ``note``, neighbouring annual
    values ``y_m2 y_m1 y_p1 y_p2``, up to six nearby observations and whether the
    series has sub-annual labels.  One equi-join on (series, year) over the five
    years around the cell, then one grouping.  With ``previous`` (needs ``vintage``
    among the series columns) the same pass also reads the cell in that edition.
    """
    look = [F.struct(F.lit(k).alias("off"), F.lit(None).cast("string").alias("vintage")) for k in range(-NEARBY_YEARS, NEARBY_YEARS + 1)]
    if previous is not None:
        look.append(F.struct(F.lit(0).alias("off"), F.lit(previous).alias("vintage")))
    probes = cells.withColumn("_l", F.explode(F.array(*look))).withColumn("_year", F.col("year") + F.col("_l.off"))
    if previous is not None:
        probes = probes.withColumn("_own", F.col("vintage")).withColumn("vintage", F.coalesce("_l.vintage", "vintage"))
    side = obs.select(
        *series, F.col("year").alias("_year"), F.col("period").alias("_p"), F.col("value").alias("_v"), F.col("note").alias("_n")
    )
    joined = probes.join(side, [*series, "_year"], "left")
    if previous is not None:
        joined = joined.withColumn("vintage", F.col("_own"))
    own = F.col("_l.vintage").isNull()
    has = F.col("_v").isNotNull()
    o = F.struct(F.col("_p").alias("period"), F.col("_v").alias("value"), F.col("_n").alias("note"))
    here = own & has & (F.col("_l.off") == 0)
    exact = F.max(F.when(here & (F.col("_p") == F.col("period")), o))
    prefix = F.min(F.when(here & (F.length("period") >= 6) & F.col("_p").startswith(F.col("period")), o))
    neighbours = [
        F.max(F.when(own & (F.col("_l.off") == k) & (F.col("_p") == F.col("_year").cast("string")), F.col("_v"))).alias(name)
        for k, name in ((-2, "y_m2"), (-1, "y_m1"), (1, "y_p1"), (2, "y_p2"))
    ]
    # at most five calendar years of one series
    valued = F.collect_list(F.when(own & has, F.struct(F.col("_p").alias("period"), F.col("_v").alias("value"))))
    near = F.reverse(F.slice(F.reverse(F.array_sort(valued)), 1, NEARBY_SHOWN))
    earlier = F.max(F.when(~own & has & (F.col("_p") == F.col("period")), F.col("_v")))
    grouped = joined.groupBy(*series, "period", "year", *carry).agg(
        F.coalesce(exact, prefix).alias("_m"), *neighbours, near.alias("nearby"), F.bool_or(own & (F.length("_p") > 4)).alias("sub_annual"),
        earlier.alias("previous_value"),
    )
    return grouped.select(
        *series, "period", "year", *carry,
        F.col("_m.value").alias("official"), F.col("_m.period").alias("matched_period"), F.col("_m.note").alias("note"),
        "y_m2", "y_m1", "y_p1", "y_p2", "nearby", "sub_annual", "previous_value",
    )


def served_series(obs: DataFrame, chain: DataFrame, editions: DataFrame | None, availability: DataFrame | None, strict: bool, previous: str | None) -> DataFrame:
    """One row per (edition, indicator, iso3) that can answer: which source, fallback disclosure and value range.

    Small next to the claims: it has as many rows as there are official series.
    """
    if strict:
        first = chain.groupBy("indicator").agg(F.min("priority").alias("priority"))
        chain = chain.join(first, ["indicator", "priority"], "left_semi")
    stats = series_stats(obs)
    series = ["source", "indicator", "iso3"]
    known = stats if availability is None else stats.join(availability.select(*series, "status"), series, "full_outer")
    if availability is None:
        known = known.withColumn("status", F.lit(None).cast("string"))
    down = F.coalesce(F.col("status") == "transient", F.lit(False))
    # a chain entry without statistics or status is definitively absent, so it can be left out
    tried = dim_join(known, chain.select("indicator", "source", "priority"), ["indicator", "source"], "inner")
    full = chain.groupBy("indicator").agg(F.min("priority").alias("_chain_first"))
    tried = dim_join(tried, full, ["indicator"])
    tried = tried.withColumn("transient", down).withColumn("usable", ~down & F.coalesce(F.col("n_values") > 0, F.lit(False)))
    span = F.when(F.col("usable"), F.struct("priority", "first_period", "last_period"))
    chosen = choose_source(tried.withColumn("_s", span), ["indicator", "iso3"], F.min("_s").alias("_s"), F.max("_chain_first").alias("_cf"))
    below_first = F.col("priority") > F.col("_cf")
    live = chosen.select(
        F.lit(LIVE).alias("edition"), "indicator", "iso3", "source", F.coalesce(below_first, F.lit(False)).alias("fallback_used"),
        F.when(below_first, F.coalesce("fallback_reason", F.lit("definitive"))).alias("fallback_reason"), "failed_transiently",
        F.col("_s.first_period").alias("first_period"), F.col("_s.last_period").alias("last_period"),
    )
    if editions is None:
        return live.withColumn("previous_exists", F.lit(False))
    dated = editions.filter(F.col("value").isNotNull()).groupBy("edition", "indicator", "iso3").agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period")
    )
    archive = dated.select(
        "edition", "indicator", "iso3", F.lit("archive").alias("source"), F.lit(False).alias("fallback_used"),
        F.lit(None).cast("string").alias("fallback_reason"), F.lit(False).alias("failed_transiently"), "first_period", "last_period",
        F.lit(False).alias("previous_exists"),
    )
    if previous is None:
        return live.withColumn("previous_exists", F.lit(False)).unionByName(archive)
    earlier = dated.filter(F.col("edition") == previous).select("indicator", "iso3", F.lit(True).alias("previous_exists"))
    live = live.join(earlier, ["indicator", "iso3"], "left").withColumn("previous_exists", F.coalesce("previous_exists", F.lit(False)))
    return live.unionByName(archive)


def resolve_cells(
    cells: DataFrame,
    obs: DataFrame,
    chain: DataFrame,
    editions: DataFrame | None,
    availability: DataFrame | None,
    strict: bool,
    previous: str | None,
    about: DataFrame | None = None,
) -> DataFrame:
    """Lookup table for distinct cells (indicator, iso3, period, year, edition).

    ``about`` adds columns by indicator.

    Live series and dated editions sit in one long table told apart by ``vintage``
    (a source id or an edition label), so a single join reads today's value, the
    pinned edition and the previous one.
    """
    served = served_series(obs, chain, editions, availability, strict, previous)
    columns = ["vintage", "indicator", "iso3", "period", "year", "value", "note"]
    long = obs.withColumn("vintage", F.col("source")).select(*columns)
    if editions is not None:
        long = long.unionByName(editions.withColumn("vintage", F.col("edition")).select(*columns))
    pinned = cells.join(served, ["edition", "indicator", "iso3"], "left")
    pinned = pinned.withColumn("vintage", F.when(F.col("edition") == LIVE, F.col("source")).otherwise(F.col("edition")))
    if about is not None:
        pinned = dim_join(pinned, about, ["indicator"])
    carry = [c for c in pinned.columns if c not in {"vintage", "indicator", "iso3", "period", "year"}]
    return match_cells(pinned, long, ["vintage", "indicator", "iso3"], carry, previous).drop("vintage")


def observation_status(source: Column, is_projection: Column, modeled: Column, in_registry: Column) -> Column:
    """Outturn, model estimate, projection or unknown, by what the source is known to publish."""
    heuristic = source.isin("imf_datamapper", "dbnomics", "archive")
    return (
        F.when(source.isNull(), F.lit("unknown"))
        .when(heuristic, F.when(is_projection, F.lit("projection")).otherwise(F.lit("estimate_or_actual")))
        .when(modeled, F.lit("modeled_estimate"))
        .when(in_registry | (source == "wdi"), F.lit("actual"))
        .otherwise(F.lit("unknown"))
    )


def year_diagnostics(claimed, percent_kind, year, tolerance_abs, tolerance_pct, values: dict[int, Column]) -> Column:
    """array<string> ``year:1999`` for neighbouring years the claim would fit."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    J.judge(claimed, v, percent_kind, tolerance_abs, tolerance_pct).isin("match", "close"),
                    F.concat(F.lit("year:"), (year + off).cast("string")),
                )
                for off, v in values.items()
            ]
        )
    )


def verify_claims(
    claims: DataFrame,
    indicators: DataFrame,
    chain: DataFrame,
    obs: DataFrame,
    editions: DataFrame | None = None,
    availability: DataFrame | None = None,
    today: str | None = None,
    strict: bool = False,
    series: DataFrame | None = None,
    series_names: DataFrame | None = None,
    imf_codes: list[str] | None = None,
    economies: DataFrame | None = None,
) -> DataFrame:
    """Verdict and explanation per claim.

    ``claims``: claim_id, indicator, country, iso3, period, claimed_value,
    tolerance_abs, tolerance_pct, as_of.  ``obs``: source, indicator, iso3, period,
    year, value, note.  ``editions``: edition, indicator, iso3, period, year, value,
    note.  ``today`` (``YYYY-MM-DD``) sets the edition calendar for the revision
    probe; without it mismatches are not re-judged.

    With ``series`` (route, provider, dataset, code, iso3, period, year, value, note)
    an indicator may be an explicit id; ``series_names`` (key, name, unit) helps to tell
    whether it counts in percent, ``imf_codes`` are the codes its route knows (the
    registry's by default).  With ``economies`` iso3 is resolved from ``country``.
    """
    day = F.to_date(F.lit(today)) if today else None
    if economies is not None:
        claims = resolve_names(claims.drop("iso3"), "country", economies, "claim_id")
    if series is not None and imf_codes is None:
        imf_codes = E.registry_imf_codes()
    checked = validate_claims(claims, indicators, imf_codes if series is not None else None)
    checked = checked.withColumnsRenamed({"indicator": "_indicator", "iso3": "_iso3"}).withColumnsRenamed({"series": "indicator", "place": "iso3"})
    about = None
    if series is not None:
        asked = E.asked_series(checked.filter(F.col("claim_error").isNull()).withColumnRenamed("indicator", "series"), series, series_names)
        # an explicit series is a chain of one source, so that one lookup answers both kinds of claims
        chain = chain.select("indicator", "source", "priority").unionByName(asked.select(F.col("series").alias("indicator"), F.col("route").alias("source"), F.lit(1).alias("priority")))
        obs = obs.select("source", "indicator", "iso3", "period", "year", "value", "note").unionByName(E.asked_observations(asked, series))
        about = asked.select(F.col("series").alias("indicator"), "series_id", "text_percent", "status_class")
    cell = ["edition", "indicator", "iso3", "period", "year"]
    cells = checked.filter(F.col("claim_error").isNull()).select(*cell).distinct()
    previous = _previous_edition_of(today) if today and editions is not None and not strict else None
    lookup = resolve_cells(cells, obs, chain, editions, availability, strict, previous, about)
    c = lookup_join(checked, lookup, cell, "claim_id")
    if about is None:
        c = c.withColumns({"series_id": F.lit(None).cast("string"), "text_percent": F.lit(None).cast("boolean"), "status_class": F.lit(None).cast("string")})

    claimed, official = F.col("claimed_value"), F.col("official")
    percent = F.when(F.col("kind").isNotNull(), J.is_percent_kind(F.col("kind"))).otherwise(F.coalesce("text_percent", F.lit(False)))
    tol = (F.col("tolerance_abs"), F.col("tolerance_pct"))
    ok = F.col("claim_error").isNull()
    no_source = ok & F.col("source").isNull()
    demoted = F.col("fallback_used") & (F.col("fallback_reason") != "definitive")
    judged = ok & official.isNotNull() & ~F.coalesce(demoted, F.lit(False))
    verdict = F.when(judged, J.judge(claimed, official, percent, *tol)).when(ok & ~no_source, F.lit("cannot_verify"))
    ratio = J.ratio_to(claimed, official)
    neighbours = {-2: F.col("y_m2"), -1: F.col("y_m1"), 1: F.col("y_p1"), 2: F.col("y_p2")}
    diagnostics = F.when(
        official.isNotNull(),
        F.concat(
            J.scale_diagnostics(ratio),
            F.when(J.is_sign_flip(ratio), F.array(F.lit("opposite_sign"))).otherwise(F.array().cast("array<string>")),
            year_diagnostics(claimed, percent, F.col("year"), *tol, neighbours),
        ),
    ).otherwise(F.array().cast("array<string>"))
    is_projection = official.isNotNull() & P.is_projection_note(F.col("note"))
    reason = F.coalesce(
        F.col("claim_error"),
        F.when(no_source & F.col("failed_transiently"), F.lit("source_unavailable")).when(no_source, F.lit("no_published_data")),
    )
    nearby = F.array_join(F.transform("nearby", lambda o: F.concat(o["period"], F.lit(": "), format_figure(o["value"]))), ", ")
    explanation = F.when(
        ok & official.isNull() & ~no_source,
        F.concat(
            F.lit("No official observation for "), F.col("period"), F.lit(". Available range: "),
            F.coalesce("first_period", F.lit("none")), F.lit("–"), F.coalesce("last_period", F.lit("none")), F.lit("."),
            F.when(F.size("nearby") > 0, F.concat(F.lit(" Nearby values: "), nearby, F.lit("."))).otherwise(F.lit("")),
            F.when(F.col("sub_annual") & (F.length("period") == 4), F.lit(" Specify the period as YYYY-MM.")).otherwise(F.lit("")),
        ),
    )
    out = (
        c.withColumn("status", F.when(reason.isNotNull(), F.lit("error")).otherwise(F.lit("ok")))
        .withColumn("error", reason)
        .withColumn("verdict", verdict)
        .withColumn("official_value", F.when(ok, official))
        .withColumn("difference", F.when(judged, F.round(claimed - official, 6)))
        .withColumn("relative_difference_pct", F.when(judged & (official != 0), F.round((claimed - official) / F.abs(official) * 100, 3)))
        .withColumn("is_projection", F.coalesce(is_projection, F.lit(False)))
        .withColumn(
            "observation_status",
            F.when(official.isNull(), F.lit("unknown"))
            .when(F.col("status_class") == "heuristic", F.when(is_projection, F.lit("projection")).otherwise(F.lit("estimate_or_actual")))
            .when(F.col("status_class").isNotNull(), F.col("status_class"))
            .otherwise(observation_status(F.col("source"), is_projection, F.coalesce("modeled", F.lit(False)), F.col("kind").isNotNull())),
        )
        .withColumn("diagnostics", diagnostics)
        .withColumn("explanation", explanation)
    )
    return out.withColumn("revision_check", _revision_check(day, percent, tol, previous)).select(
        "claim_id", F.col("_indicator").alias("indicator"), F.col("_iso3").alias("iso3"), "period", "claimed_value", "status", "error", "verdict",
        "official_value", "matched_period",
        "difference", "relative_difference_pct", "is_projection", "observation_status", "diagnostics", "explanation", "source",
        "fallback_used", "fallback_reason",
        F.when(
            F.col("edition") != LIVE,
            F.struct(
                F.col("as_of").alias("requested"), F.col("edition").alias("resolved_edition"),
                F.month("as_of_day").isin(4, 10).alias("inside_release_month"),
            ),
        ).alias("as_of"),
        "revision_check",
        "series_id",
    )


def _previous_edition_of(today: str) -> str:
    """Edition before the one expected on a fixed day (calendar arithmetic on a parameter)."""
    year, month = int(today[:4]), int(today[5:7])
    if month >= 11:
        return f"{year}-04"
    return f"{year - 1}-10" if month >= 5 else f"{year - 1}-04"


def _revision_check(day, percent, tol, previous) -> Column:
    shape = "struct<status:string,previous_edition:string,previous_value:double,matches_previous:boolean,next_edition:string>"
    if previous is None:
        return F.lit(None).cast(shape)
    applies = (F.col("verdict") == "mismatch") & (F.col("edition") == LIVE) & F.col("has_editions")
    matches = J.judge(F.col("claimed_value"), F.col("previous_value"), percent, *tol).isin("match", "close")
    return F.when(
        applies,
        F.struct(
            F.when(F.col("previous_exists"), F.lit("checked")).otherwise(F.lit("unavailable")).alias("status"),
            F.lit(previous).alias("previous_edition"),
            F.col("previous_value").alias("previous_value"),
            F.when(F.col("previous_exists"), F.coalesce(matches, F.lit(False))).alias("matches_previous"),
            P.next_edition_label(P.edition_at(day)).alias("next_edition"),
        ).cast(shape),
    )


def summarize(results: DataFrame) -> DataFrame:
    """Counts per verdict, plus judged claims that rest on projections."""
    ok = F.col("status") == "ok"
    v = F.col("verdict")
    return results.agg(
        F.count("*").alias("total"),
        *[F.count_if(ok & (v == name)).alias(name) for name in ("match", "close", "mismatch", "cannot_verify")],
        F.count_if(~ok).alias("error"),
        F.count_if(ok & F.col("is_projection") & (v != "cannot_verify")).alias("against_projections"),
    )
