"""Queries on claims that name their series by an explicit id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from econcheck.operators import explicit as E
from econcheck.operators import verify as V
from econcheck.queries.cte import judge_sql, sql
from econcheck.queries.inputs import TODAY, Tables
from econcheck.queries.registry import query
from econcheck.queries.verify import _SCALE, _VERDICT9, _VERIFY

IMF_CODES = {"order_value": "ORDERS", "order_count": "COUNTS"}
ROUTES = 12


def _wdi_code(indicator: Column) -> Column:
    return F.upper(F.replace(indicator, F.lit("_"), F.lit(".")))


def _source_codes(t: Tables) -> DataFrame:
    """Where the registry's series are published: codes as in the registry's source table."""
    rows = t.chain().select("indicator", "source")
    imf = F.create_map(*[F.lit(x) for kv in IMF_CODES.items() for x in kv])
    return rows.select("indicator", "source", F.lit(None).cast("string").alias("dataset"), F.when(F.col("source") == "wdi", _wdi_code(F.col("indicator"))).otherwise(imf[F.col("indicator")]).alias("code"))


def _stored_series(t: Tables) -> DataFrame:
    """Everything that has an explicit id: registry series, the dated archive, and one provider outside the registry."""
    own = E.addressable(t.observations(), _source_codes(t))
    archive = t.editions().select(
        F.lit("dbnomics").alias("route"), F.lit("IMF").alias("provider"), F.concat(F.lit("WEO:"), "edition").alias("dataset"), F.concat_ws(".", "iso3", "indicator").alias("code"),
        F.lit(None).cast("string").alias("iso3"), "period", "year", "value", F.when(F.col("year") >= F.substring("edition", 1, 4).cast("int"), F.lit("IMF WEO estimate/projection")).alias("note"),
    )
    share = t.annual().where("indicator = 'urgent_share'")
    outside = share.select(
        F.lit("dbnomics").alias("route"), F.lit("OECD").alias("provider"), F.lit("EO").alias("dataset"), F.concat("iso3", F.lit(".SHARE_pcent")).alias("code"),
        F.lit(None).cast("string").alias("iso3"), "period", "year", "value", F.lit(None).cast("string").alias("note"),
    )
    return own.unionByName(archive).unionByName(outside)


def _names(t: Tables) -> DataFrame:
    wdi = t.indicators().select(
        F.lit("wdi").alias("route"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("dataset"), _wdi_code(F.col("indicator")).alias("code"),
        F.concat(F.lit("Series "), "indicator").alias("name"), F.when(F.col("kind") == "percent", F.lit("% of orders")).otherwise(F.lit("units")).alias("unit"),
    )
    return wdi


def explicit_claims(t: Tables) -> DataFrame:
    """The claims with their series named by id: every route, and every way to get it wrong."""
    k, i, c = F.col("claim_id") % ROUTES, F.col("indicator"), F.col("iso3")
    code = F.replace(i, F.lit("_"), F.lit("."))
    imf = F.create_map(*[F.lit(x) for kv in IMF_CODES.items() for x in kv])
    inside = F.concat_ws(".", c, i)
    sid = (
        F.when(k == 0, F.concat(F.lit(" WorldBank/"), code)).when(k == 1, F.concat(F.lit("wb/"), code))
        .when(k == 2, F.concat(F.lit("IMF/"), F.coalesce(imf[i], F.lit("NOPE")))).when(k == 3, F.concat(F.lit("dbnomics/IMF/WEO:latest/"), inside))
        .when(k == 4, F.concat(F.lit("dbnomics/IMF/"), inside)).when(k == 5, F.concat(F.lit("fred/"), i)).when(k == 6, F.concat(F.lit("dbnomics/OECD/EO/"), c, F.lit(".SHARE_pcent")))
        .when(k == 7, F.concat(F.lit(" "), F.upper(i))).when(k == 8, F.concat(F.lit("worldbank/"), code)).when(k == 9, F.concat(F.lit("about "), i))
        .when(k == 10, F.concat(F.lit("dbnomics/IMF/WEO:1999-04/"), inside)).otherwise(F.concat(F.lit("worldbank/"), code))
    )
    placed = ~k.isin(1, 3, 6, 10)
    return t.claims().select(
        "claim_id", sid.alias("indicator"), F.when(placed, F.when(k == 11, F.lit("Atlantis")).otherwise(c)).alias("country"), F.when(placed & (k != 11), c).alias("iso3"),
        "period", "claimed_value", "tolerance_abs", "tolerance_pct", F.when(k == 8, F.lit("1999-06")).when(k == 7, F.col("as_of")).alias("as_of"),
    )


_DATED = "indicator IN ('order_value', 'order_count')"
# one row per series that an id can name, written from the tables up
_XSERIES = f"""
    SELECT 'w' || indicator AS sid, iso3, year, value, NULL::VARCHAR AS note FROM annual WHERE nk % 7 <> 0
    UNION ALL SELECT 'i' || indicator, iso3, year, value * 1.01::DOUBLE, CASE WHEN year >= 2000 THEN 'p' END FROM annual WHERE {_DATED}
    UNION ALL SELECT 'l' || indicator, iso3, year, value, CASE WHEN year >= 2001 THEN 'p' END FROM editions WHERE edition = '2001-10'
    UNION ALL SELECT 'd' || indicator, iso3, year, value, CASE WHEN year >= 1999 THEN 'p' END FROM editions WHERE edition = '1999-04'
    UNION ALL SELECT 'o', iso3, year, value, NULL FROM annual WHERE indicator = 'urgent_share'"""
_XCLAIMS = f"""
    SELECT c.claim_id, c.claim_id % {ROUTES} AS k, c.indicator, c.iso3, c.year, c.period, c.claimed_value, c.tolerance_abs, c.tolerance_pct,
           CASE c.claim_id % {ROUTES} WHEN 0 THEN 'w' || indicator WHEN 2 THEN 'i' || indicator WHEN 3 THEN 'l' || indicator WHEN 6 THEN 'o' WHEN 10 THEN 'd' || indicator END AS sid,
           CASE c.claim_id % {ROUTES} WHEN 0 THEN 'worldbank/' || upper(replace(indicator, '_', '.')) WHEN 2 THEN CASE indicator WHEN 'order_value' THEN 'imf/ORDERS' WHEN 'order_count' THEN 'imf/COUNTS' END
             WHEN 3 THEN 'dbnomics/IMF/WEO:' || (CASE WHEN {_DATED} THEN '2001-10' ELSE 'latest' END) || '/' || iso3 || '.' || indicator WHEN 6 THEN 'dbnomics/OECD/EO/' || iso3 || '.SHARE_pcent'
             WHEN 10 THEN 'dbnomics/IMF/WEO:1999-04/' || iso3 || '.' || indicator END AS series_id,
           CASE c.claim_id % {ROUTES} WHEN 1 THEN 'country_required' WHEN 2 THEN CASE WHEN NOT ({_DATED}) THEN 'unknown_imf_code' END WHEN 4 THEN 'malformed_series_id' WHEN 5 THEN 'source_refused'
             WHEN 8 THEN 'as_of_not_supported' WHEN 9 THEN 'unknown_indicator' WHEN 11 THEN 'country_not_resolved' END AS fault,
           (c.claim_id % {ROUTES} = 6 OR (c.claim_id % {ROUTES} = 0 AND indicator = 'urgent_share')) AS pct
    FROM claims c WHERE c.claim_id % {ROUTES} <> 7"""
_XVERDICT = judge_sql("claimed_value", "official", "pct", "tolerance_abs", "tolerance_pct")
_XYEAR = judge_sql("x.claimed_value", "s.value", "x.pct", "x.tolerance_abs", "x.tolerance_pct")


@query(
    "v9_explicit_series",
    sql(
        f"""SELECT claim_id, CASE WHEN fault IS NULL THEN series_id END AS series_id, error, CASE WHEN error IS NULL THEN CASE WHEN official IS NULL THEN 'cannot_verify' ELSE verdict END END AS verdict,
               round(official, 4) AS official_value, coalesce(note IS NOT NULL, FALSE) AS is_projection,
               CASE WHEN official IS NULL THEN 'unknown' WHEN k IN (2, 3, 10) THEN CASE WHEN note IS NOT NULL THEN 'projection' ELSE 'estimate_or_actual' END WHEN k = 0 THEN 'actual' ELSE 'unknown' END AS observation_status,
               CASE WHEN official IS NULL THEN '' ELSE array_to_string(list_concat(list_filter([{_SCALE}], lambda z: z IS NOT NULL),
                   CASE WHEN ratio < 0 AND abs(-ratio - 1) <= 0.02::DOUBLE THEN ['opposite_sign'] ELSE [] END, coalesce(years, [])), ';') END AS diagnostics
        FROM (SELECT *, coalesce(fault, CASE WHEN n IS NULL THEN 'no_published_data' END) AS error, {_XVERDICT} AS verdict, CASE WHEN official <> 0 THEN claimed_value / official END AS ratio
              FROM (SELECT x.*, s.value AS official, s.note, a.n, y.years FROM xclaims x
                    LEFT JOIN xseries s ON x.fault IS NULL AND s.sid = x.sid AND s.iso3 = x.iso3 AND s.year = x.year
                    LEFT JOIN (SELECT sid, iso3, count(*) AS n FROM xseries GROUP BY sid, iso3) a ON x.fault IS NULL AND a.sid = x.sid AND a.iso3 = x.iso3
                    LEFT JOIN (SELECT x.claim_id, list('year:' || CAST(s.year AS VARCHAR) ORDER BY s.year) AS years FROM xclaims x JOIN xseries s ON s.sid = x.sid AND s.iso3 = x.iso3 AND abs(s.year - x.year) BETWEEN 1 AND 2
                               WHERE {_XYEAR} <> 'mismatch' GROUP BY x.claim_id) y ON y.claim_id = x.claim_id))
        UNION ALL
        SELECT claim_id, NULL, CASE WHEN source IS NULL THEN CASE WHEN down AND NOT dated THEN 'source_unavailable' ELSE 'no_published_data' END END, {_VERDICT9}, round(official, 4),
               coalesce(official IS NOT NULL AND note IS NOT NULL, FALSE),
               CASE WHEN official IS NULL THEN 'unknown' WHEN source IN ('imf_datamapper', 'archive') THEN CASE WHEN note IS NOT NULL THEN 'projection' ELSE 'estimate_or_actual' END
                    WHEN indicator = 'price_index' THEN 'modeled_estimate' ELSE 'actual' END, NULL
        FROM v9 WHERE claim_id % {ROUTES} = 7""",
        v9=_VERIFY, xseries=_XSERIES, xclaims=_XCLAIMS,
    ),
)
def v9_explicit(t: Tables):
    out = V.verify_claims(
        explicit_claims(t), t.indicators(), t.chain(), t.observations(), t.editions(), t.availability(), TODAY,
        series=_stored_series(t), series_names=_names(t), imf_codes=list(IMF_CODES.values()),
    )
    listed = F.col("claim_id") % ROUTES == 7  # registry claims have their diagnostics checked by v9_verify_claims
    return out.select(
        "claim_id", "series_id", "error", "verdict", F.round("official_value", 4).alias("official_value"), "is_projection", "observation_status",
        F.when(~listed, F.array_join("diagnostics", ";")).alias("diagnostics"),
    )
