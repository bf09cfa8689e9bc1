"""Queries on claim verification and source chains."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from econcheck.functions import citations as C
from econcheck.functions import judge as J
from econcheck.functions import periods as P
from econcheck.operators import chain as S
from econcheck.operators import verify as V
from econcheck.plans.durable import ensure_checkpoint_dir
from econcheck.plans.joins import lookup_join
from econcheck.sources import landed as L
from econcheck.queries.cte import judge_sql, sql
from econcheck.queries.inputs import INDICATORS, KINDS, TODAY, Tables, nation_code
from econcheck.queries.registry import query


def percent_kind() -> F.Column:
    return F.col("indicator") == "urgent_share"



def _with_official(t: Tables):
    official = t.annual().select("indicator", "iso3", "period", F.col("value").alias("official"))
    return lookup_join(t.claims(), official, ["indicator", "iso3", "period"], "claim_id")


_CO = "(SELECT c.*, a.value AS official FROM claims c LEFT JOIN annual a ON a.indicator = c.indicator AND a.iso3 = c.iso3 AND a.period = c.period) x"
_VERDICT = judge_sql("claimed_value", "official", "(indicator = 'urgent_share')", "tolerance_abs", "tolerance_pct")


@query("j1_claim_observation", sql(f"SELECT claim_id, indicator, iso3, period, round(official, 4) AS official FROM {_CO}"))
def j1(t: Tables):
    return _with_official(t).select("claim_id", "indicator", "iso3", "period", F.round("official", 4).alias("official"))


@query("v1_judge", sql(f"SELECT claim_id, {_VERDICT} AS verdict FROM {_CO}"))
def v1(t: Tables):
    verdict = J.judge(F.col("claimed_value"), F.col("official"), percent_kind(), F.col("tolerance_abs"), F.col("tolerance_pct"))
    return _with_official(t).select("claim_id", verdict.alias("verdict"))


@query("v2_percent_kind", sql(r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN TRUE WHEN p_partkey % 4 = 1 THEN FALSE
      ELSE regexp_matches(CASE WHEN p_partkey % 4 = 2 THEN p_type || ' ' || p_name ELSE 'X.pcent_gdp ' || p_name END, '%|percent|pcent', 'i') END AS percent FROM part"""))
def v2(t: Tables):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, F.lit("percent")).when(k == 1, F.lit("level"))
    text = F.when(k == 2, F.col("p_type")).otherwise(F.lit("X.pcent_gdp"))
    return t.part.select("p_partkey", J.is_percent_kind(kind, text, F.col("p_name")).alias("percent"))


_NEAR = "abs(ratio - {f}) / {f} <= 0.02::DOUBLE OR abs(ratio - 1.0::DOUBLE / {f}) / (1.0::DOUBLE / {f}) <= 0.02::DOUBLE"
_SCALE = ", ".join(
    f"CASE WHEN ratio > 0 AND ({_NEAR.format(f=f'{f}::DOUBLE')}) THEN 'scale:{n}:' || (CASE WHEN ratio > 1 THEN 'larger' ELSE 'smaller' END) END"
    for f, n in (("100.0", "percent_vs_decimal"), ("1e3", "thousands"), ("1e6", "millions"), ("1e9", "billions"), ("1e12", "trillions"))
)


@query(
    "v3_scale_diagnostics",
    sql(f"""SELECT claim_id, array_to_string(list_filter([{_SCALE}], lambda x: x IS NOT NULL), ';') AS diagnostics
        FROM (SELECT claim_id, CASE WHEN official <> 0 THEN claimed_value / official END AS ratio FROM {_CO}) WHERE ratio IS NOT NULL"""),
)
def v3(t: Tables):
    ratio = J.ratio_to(F.col("claimed_value"), F.col("official"))
    d = _with_official(t).withColumn("ratio", ratio).filter("ratio IS NOT NULL")
    return d.select("claim_id", F.array_join(J.scale_diagnostics(F.col("ratio")), ";").alias("diagnostics"))


@query(
    "v4_sign_diagnostic",
    sql(f"""SELECT claim_id, coalesce(ratio < 0 AND abs(-ratio - 1) <= 0.02::DOUBLE, FALSE) AS opposite_sign
        FROM (SELECT claim_id, CASE WHEN official <> 0 THEN claimed_value / official END AS ratio FROM {_CO})"""),
)
def v4(t: Tables):
    ratio = J.ratio_to(F.col("claimed_value"), F.col("official"))
    return _with_official(t).select("claim_id", J.is_sign_flip(ratio).alias("opposite_sign"))


_ADJ = """SELECT c.claim_id, c.claimed_value, c.indicator, c.tolerance_abs, c.tolerance_pct, c.year, o.off, a.value AS v FROM claims c
    CROSS JOIN (VALUES (-2), (-1), (1), (2)) o(off)
    JOIN annual a ON a.indicator = c.indicator AND a.iso3 = c.iso3 AND a.year = c.year + o.off"""
_ADJ_VERDICT = judge_sql("claimed_value", "v", "(indicator = 'urgent_share')", "tolerance_abs", "tolerance_pct")


@query("j3_adjacent_years", sql(f"SELECT claim_id, CAST(off AS INTEGER) AS year_offset, round(v, 4) AS value FROM ({_ADJ})"))
def j3(t: Tables):
    cells = t.claims().withColumn("year", F.col("period").cast("int")).select("indicator", "iso3", "period", "year").distinct()
    found = V.match_cells(cells, t.annual().withColumn("note", F.lit(None).cast("string")), ["indicator", "iso3"])
    out = lookup_join(t.claims(), found, ["indicator", "iso3", "period"], "claim_id", "inner")
    names = {-2: "y_m2", -1: "y_m1", 1: "y_p1", 2: "y_p2"}
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("year_offset"), F.col(c).alias("v")) for k, c in names.items()]))
    return out.select("claim_id", sides.alias("s")).filter("s.v IS NOT NULL").select("claim_id", "s.year_offset", F.round("s.v", 4).alias("value"))


@query(
    "v5_year_misattribution",
    sql(f"""SELECT claim_id, string_agg('year:' || CAST(year + off AS VARCHAR), ';' ORDER BY off) AS years
        FROM (SELECT *, {_ADJ_VERDICT} AS verdict FROM ({_ADJ})) WHERE verdict <> 'mismatch' GROUP BY claim_id"""),
)
def v5(t: Tables):
    claims = t.claims().withColumn("year", F.col("period").cast("int"))
    found = V.match_cells(
        claims.select("indicator", "iso3", "period", "year").distinct(), t.annual().withColumn("note", F.lit(None).cast("string")), ["indicator", "iso3"]
    ).drop("year")
    out = lookup_join(claims, found, ["indicator", "iso3", "period"], "claim_id", "inner")
    values = {-2: F.col("y_m2"), -1: F.col("y_m1"), 1: F.col("y_p1"), 2: F.col("y_p2")}
    d = V.year_diagnostics(F.col("claimed_value"), percent_kind(), F.col("year"), F.col("tolerance_abs"), F.col("tolerance_pct"), values)
    return out.select("claim_id", d.alias("d")).filter(F.size("d") > 0).select("claim_id", F.array_join("d", ";").alias("years"))


@query(
    "j2_prefix_period",
    sql("""SELECT o.o_orderkey, m.period AS matched_period, round(m.value, 4) AS value
        FROM (SELECT o_orderkey, 'C' || CAST(o_custkey AS VARCHAR) AS iso3, strftime(o_orderdate, '%Y-%m') AS p FROM orders) o
        JOIN (SELECT iso3, min(period) AS period, arg_min(value, period) AS value, left(period, 7) AS ym FROM daily_spend WHERE value IS NOT NULL GROUP BY iso3, ym) m
        ON m.iso3 = o.iso3 AND m.ym = o.p""",
        daily_spend="""SELECT 'C' || CAST(o_custkey AS VARCHAR) AS iso3, strftime(o_orderdate, '%Y-%m-%d') AS period,
            CASE WHEN day(o_orderdate) % 10 <> 0 THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS value
            FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m-%d'), day(o_orderdate)"""),
)
def j2(t: Tables):
    # daily labels asked for by month: the first non-NULL day of the month answers
    from econcheck.queries.inputs import customer_code, money

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    daily = t.orders.groupBy(customer_code(F.col("o_custkey")).alias("iso3"), day.alias("period")).agg(money("o_totalprice").alias("v"))
    daily = daily.select(
        "iso3", "period", P.period_year(F.col("period")).alias("year"),
        F.when(F.substring("period", 9, 2).cast("int") % 10 != 0, F.col("v")).alias("value"), F.lit(None).cast("string").alias("note"),
    )
    asked = t.orders.select(
        "o_orderkey", customer_code(F.col("o_custkey")).alias("iso3"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.year("o_orderdate").alias("year")
    )
    found = V.match_cells(asked.select("iso3", "period", "year").distinct(), daily, ["iso3"]).drop("year")
    out = lookup_join(asked, found.filter("official IS NOT NULL"), ["iso3", "period"], "o_orderkey", "inner")
    return out.select("o_orderkey", "matched_period", F.round("official", 4).alias("value"))


_RESOLVE = """SELECT i.indicator, n.iso3, n.nk,
        CASE WHEN n.nk % 7 <> 0 AND n.nk % 5 <> 3 THEN 'wdi' WHEN i.indicator IN ('order_value', 'order_count') THEN 'imf_datamapper' END AS source,
        n.nk % 5 = 3 AS down
    FROM (SELECT DISTINCT nk, iso3 FROM annual) n CROSS JOIN (VALUES ('order_value'), ('order_count'), ('urgent_share'), ('price_index')) i(indicator)"""


@query(
    "j4_source_chain",
    sql(f"""SELECT r.claim_id, x.source, coalesce(x.source = 'imf_datamapper', FALSE) AS fallback_used,
            CASE WHEN x.source = 'imf_datamapper' THEN CASE WHEN x.down THEN 'transient' ELSE 'definitive' END END AS fallback_reason
        FROM claims r JOIN ({_RESOLVE}) x ON x.indicator = r.indicator AND x.iso3 = r.iso3"""),
)
def j4(t: Tables):
    requests = t.claims().select("indicator", "iso3", F.lit(False).alias("strict")).distinct()
    tried = S.series_attempts(requests, t.chain(), S.series_stats(t.observations()), t.availability())
    chosen = S.choose_source(tried, ["indicator", "iso3"])
    out = lookup_join(t.claims(), chosen, ["indicator", "iso3"], "claim_id", "inner")
    return out.select("claim_id", "source", "fallback_used", "fallback_reason")


@query(
    "j5_vintage_as_of",
    sql("""SELECT c.claim_id, CAST(c.year0 AS VARCHAR) || '-04' AS edition, round(e.value, 4) AS edition_value
        FROM (SELECT *, CAST(left(as_of, 4) AS INTEGER) AS year0 FROM claims WHERE as_of IS NOT NULL) c
        LEFT JOIN editions e ON e.edition = CAST(c.year0 AS VARCHAR) || '-04' AND e.indicator = c.indicator AND e.iso3 = c.iso3 AND e.period = c.period"""),
)
def j5(t: Tables):
    asked = t.claims().filter("as_of IS NOT NULL").withColumn("edition", P.edition_at(P.as_of_date(F.col("as_of"))))
    dated = t.editions().select("edition", "indicator", "iso3", "period", F.col("value").alias("edition_value"))
    out = lookup_join(asked, dated, ["edition", "indicator", "iso3", "period"], "claim_id")
    return out.select("claim_id", "edition", F.round("edition_value", 4).alias("edition_value"))


@query(
    "j5_from_archive",
    sql("""SELECT c.claim_id, c.as_of, CAST(c.year0 AS VARCHAR) || '-04' AS edition, round(e.value, 4) AS edition_value
        FROM (SELECT *, CAST(left(as_of, 4) AS INTEGER) AS year0 FROM claims WHERE as_of IS NOT NULL AND left(as_of, 4) >= '1999') c
        LEFT JOIN editions e ON e.edition = CAST(c.year0 AS VARCHAR) || '-04' AND e.indicator = c.indicator AND e.iso3 = c.iso3 AND e.period = c.period"""),
)
def j5_from_archive(t: Tables):
    """Claims pinned from 1999 on against the archive on disk, of which only their editions are read."""
    path = f"{ensure_checkpoint_dir(t.spark)}/editions-{uuid.uuid4().hex}"
    t.editions().repartition("edition").write.partitionBy("edition").parquet(path)
    asked = t.claims().filter("left(as_of, 4) >= '1999'").withColumn("edition", P.edition_at(P.as_of_date(F.col("as_of"))))
    dated = L.asked_editions(L.read_editions(t.spark, path).withColumn("edition", F.col("edition").cast("string")), asked)
    dated = dated.select("edition", "indicator", "iso3", "period", F.col("value").alias("edition_value"))
    out = lookup_join(asked, dated, ["edition", "indicator", "iso3", "period"], "claim_id")
    return out.select("claim_id", "as_of", "edition", F.round("edition_value", 4).alias("edition_value"))


# what verification should say, written independently from the claims up
_VERIFY = f"""
    SELECT b.*, {judge_sql("claimed_value", "official", "(indicator = 'urgent_share')", "tolerance_abs", "tolerance_pct")} AS judged,
           {judge_sql("claimed_value", "prev", "(indicator = 'urgent_share')", "tolerance_abs", "tolerance_pct")} AS prev_judged
    FROM (SELECT c.*, (c.as_of IS NOT NULL) AS dated,
             CASE WHEN c.as_of IS NOT NULL THEN (CASE WHEN ed.iso3 IS NOT NULL THEN 'archive' END) ELSE x.source END AS source,
             CASE WHEN c.as_of IS NOT NULL THEN e.value ELSE o.value END AS official,
             CASE WHEN c.as_of IS NOT NULL THEN NULL ELSE o.note END AS note,
             (c.as_of IS NULL AND x.source = 'imf_datamapper') AS fb, x.down, p.value AS prev, (pe.iso3 IS NOT NULL) AS prev_exists
          FROM claims c
          JOIN ({_RESOLVE}) x ON x.indicator = c.indicator AND x.iso3 = c.iso3
          LEFT JOIN obs o ON o.source = x.source AND o.indicator = c.indicator AND o.iso3 = c.iso3 AND o.period = c.period
          LEFT JOIN editions e ON e.edition = left(c.as_of, 4) || '-04' AND e.indicator = c.indicator AND e.iso3 = c.iso3 AND e.period = c.period
          LEFT JOIN (SELECT DISTINCT edition, indicator, iso3 FROM editions) ed ON ed.edition = left(c.as_of, 4) || '-04' AND ed.indicator = c.indicator AND ed.iso3 = c.iso3
          LEFT JOIN editions p ON p.edition = '2001-04' AND p.indicator = c.indicator AND p.iso3 = c.iso3 AND p.period = c.period
          LEFT JOIN (SELECT DISTINCT indicator, iso3 FROM editions WHERE edition = '2001-04') pe ON pe.indicator = c.indicator AND pe.iso3 = c.iso3) b"""
_VERDICT9 = """CASE WHEN source IS NULL THEN NULL WHEN official IS NULL OR (fb AND down) THEN 'cannot_verify' ELSE judged END"""


def _verified(t: Tables):
    return V.verify_claims(t.claims(), t.indicators(), t.chain(), t.observations(), t.editions(), t.availability(), TODAY)


# every vintage of every series in one table, as far as claims look at it
_VINTAGES = """SELECT source AS vintage, indicator, iso3, year, period, value FROM obs WHERE value IS NOT NULL
    UNION ALL SELECT edition, indicator, iso3, year, period, value FROM editions WHERE value IS NOT NULL"""
_BESIDE = """SELECT c.claim_id, c.claimed_value, c.indicator, c.tolerance_abs, c.tolerance_pct, s.year - c.year AS off, s.year, s.period, s.value AS v
    FROM v9 c JOIN vintages s ON s.vintage = CASE WHEN c.dated THEN left(c.as_of, 4) || '-04' ELSE c.source END AND s.indicator = c.indicator AND s.iso3 = c.iso3 AND abs(s.year - c.year) <= 2"""
_SHOWN = r"""CASE WHEN abs(v) >= 1e6 THEN format('{:,.0f}', v) ELSE regexp_replace(regexp_replace(format('{:,.4f}', v), '0+$', ''), '\.$', '') END"""


@query(
    "v9_verify_claims",
    sql(f"""SELECT claim_id, indicator, iso3, period, source, CASE WHEN source IS NULL THEN 'error' ELSE 'ok' END AS status,
            CASE WHEN source IS NULL THEN CASE WHEN down AND NOT dated THEN 'source_unavailable' ELSE 'no_published_data' END END AS error,
            {_VERDICT9} AS verdict, round(official, 4) AS official_value, CASE WHEN official IS NOT NULL THEN period END AS matched_period,
            CASE WHEN {_VERDICT9} <> 'cannot_verify' THEN round(claimed_value - official, 6) + 0.0::DOUBLE END AS difference,
            CASE WHEN {_VERDICT9} <> 'cannot_verify' AND official <> 0 THEN round((claimed_value - official) / abs(official) * 100, 3) + 0.0::DOUBLE END AS relative_difference_pct,
            coalesce(official IS NOT NULL AND note IS NOT NULL, FALSE) AS is_projection,
            CASE WHEN official IS NULL THEN 'unknown' WHEN source IN ('imf_datamapper', 'archive') THEN
                CASE WHEN note IS NOT NULL THEN 'projection' ELSE 'estimate_or_actual' END
                WHEN indicator = 'price_index' THEN 'modeled_estimate' ELSE 'actual' END AS observation_status,
            coalesce(fb, FALSE) AS fallback_used, CASE WHEN fb THEN CASE WHEN down THEN 'transient' ELSE 'definitive' END END AS fallback_reason,
            CASE WHEN official IS NULL THEN '' ELSE array_to_string(list_concat(list_filter([{_SCALE}], lambda z: z IS NOT NULL),
                CASE WHEN ratio < 0 AND abs(-ratio - 1) <= 0.02::DOUBLE THEN ['opposite_sign'] ELSE [] END, coalesce(years, [])), ';') END AS diagnostics,
            CASE WHEN source IS NOT NULL AND official IS NULL THEN 'No official observation for ' || period || '. Available range: ' || first_period || '–' || last_period || '.'
                || coalesce(' Nearby values: ' || nearby || '.', '') END AS explanation,
            CASE WHEN dated THEN as_of END AS as_of_requested, CASE WHEN dated THEN left(as_of, 4) || '-04' END AS as_of_edition, CASE WHEN dated THEN FALSE END AS as_of_inside_release_month,
            CASE WHEN probed THEN CASE WHEN prev_exists THEN 'checked' ELSE 'unavailable' END END AS revision_status, CASE WHEN probed THEN round(prev, 4) END AS revision_previous_value,
            CASE WHEN probed AND prev_exists THEN coalesce(prev_judged <> 'mismatch', FALSE) END AS revision_matches_previous
        FROM (SELECT c.*, CASE WHEN official <> 0 THEN claimed_value / official END AS ratio, y.years, n.nearby, r.first_period, r.last_period,
                 (coalesce({_VERDICT9}, '') = 'mismatch' AND NOT dated AND c.indicator IN ('order_value', 'order_count')) AS probed
              FROM v9 c
              LEFT JOIN (SELECT claim_id, list('year:' || CAST(year AS VARCHAR) ORDER BY year) AS years FROM beside WHERE off <> 0 AND {_ADJ_VERDICT} <> 'mismatch' GROUP BY claim_id) y ON y.claim_id = c.claim_id
              LEFT JOIN (SELECT claim_id, string_agg(period || ': ' || {_SHOWN}, ', ' ORDER BY period) AS nearby FROM beside GROUP BY claim_id) n ON n.claim_id = c.claim_id
              LEFT JOIN (SELECT vintage, indicator, iso3, min(period) AS first_period, max(period) AS last_period FROM vintages GROUP BY ALL) r
                ON r.vintage = CASE WHEN c.dated THEN left(c.as_of, 4) || '-04' ELSE c.source END AND r.indicator = c.indicator AND r.iso3 = c.iso3)""",
        v9=_VERIFY, vintages=_VINTAGES, beside=_BESIDE),
)
def v9(t: Tables):
    return _verified(t).select(
        "claim_id", "indicator", "iso3", "period", "source", "status", "error", "verdict", F.round("official_value", 4).alias("official_value"), "matched_period",
        "difference", "relative_difference_pct", "is_projection", "observation_status", F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), "fallback_reason",
        F.array_join("diagnostics", ";").alias("diagnostics"), "explanation", F.col("as_of.requested").alias("as_of_requested"), F.col("as_of.resolved_edition").alias("as_of_edition"),
        F.col("as_of.inside_release_month").alias("as_of_inside_release_month"), F.col("revision_check.status").alias("revision_status"),
        F.round("revision_check.previous_value", 4).alias("revision_previous_value"), F.col("revision_check.matches_previous").alias("revision_matches_previous"),
    )


@query(
    "v10_summary",
    sql(f"""SELECT count(*) AS total, count(*) FILTER (WHERE v = 'match') AS "match", count(*) FILTER (WHERE v = 'close') AS "close",
            count(*) FILTER (WHERE v = 'mismatch') AS mismatch, count(*) FILTER (WHERE v = 'cannot_verify') AS cannot_verify,
            count(*) FILTER (WHERE v IS NULL) AS error, count(*) FILTER (WHERE v <> 'cannot_verify' AND official IS NOT NULL AND note IS NOT NULL) AS against_projections
        FROM (SELECT *, {_VERDICT9} AS v FROM v9)""", v9=_VERIFY),
)
def v10(t: Tables):
    return V.summarize(_verified(t))


@query(
    "j6_revision_probe",
    sql(f"""SELECT claim_id, CASE WHEN prev_exists THEN 'checked' ELSE 'unavailable' END AS status, '2001-04' AS previous_edition,
            round(prev, 4) AS previous_value, CASE WHEN prev_exists THEN coalesce(prev_judged <> 'mismatch', FALSE) END AS matches_previous, 'April 2002' AS next_edition
        FROM (SELECT *, {_VERDICT9} AS v FROM v9) WHERE v = 'mismatch' AND NOT dated AND indicator IN ('order_value', 'order_count')""", v9=_VERIFY),
)
def j6(t: Tables):
    r = _verified(t).filter("revision_check IS NOT NULL").select("claim_id", "revision_check.*")
    return r.withColumn("previous_value", F.round("previous_value", 4))


@query("v6_observation_status", sql("""SELECT source, indicator, iso3, period, CASE WHEN source = 'imf_datamapper' THEN
      CASE WHEN note IS NOT NULL THEN 'projection' ELSE 'estimate_or_actual' END WHEN indicator = 'price_index' THEN 'modeled_estimate' ELSE 'actual' END AS status FROM obs"""))
def v6(t: Tables):
    s = V.observation_status(F.col("source"), P.is_projection_note(F.col("note")), F.col("indicator") == "price_index", F.lit(True))
    return t.observations().select("source", "indicator", "iso3", "period", s.alias("status"))


@query(
    "v7_transient_demotion",
    sql(f"""SELECT claim_id, 'cannot_verify' AS verdict, round(official, 4) AS indicative_value FROM v9 WHERE source IS NOT NULL AND official IS NOT NULL AND fb AND down""", v9=_VERIFY),
)
def v7(t: Tables):
    r = _verified(t).filter("fallback_reason = 'transient' AND official_value IS NOT NULL")
    return r.select("claim_id", "verdict", F.round("official_value", 4).alias("indicative_value"))


@query(
    "v8_cannot_verify_nearby",
    sql("""SELECT indicator, iso3, CAST(y AS VARCHAR) AS period, string_agg(period, ';' ORDER BY period) AS nearby
        FROM (SELECT DISTINCT a.indicator, a.iso3, c.y, a.period, row_number() OVER (PARTITION BY a.indicator, a.iso3, c.y ORDER BY a.period DESC) AS rn
              FROM annual a JOIN (SELECT DISTINCT year + k AS y FROM annual CROSS JOIN (VALUES (1), (2)) s(k)) c ON abs(a.year - c.y) <= 2
              WHERE c.y > 2001)
        WHERE rn <= 6 GROUP BY 1, 2, 3"""),
)
def v8(t: Tables):
    obs = t.annual().withColumn("note", F.lit(None).cast("string"))
    beyond = obs.withColumn("year", F.explode(F.array(F.col("year") + 1, F.col("year") + 2))).filter("year > 2001")
    cells = beyond.select("indicator", "iso3", F.col("year").cast("string").alias("period"), "year").distinct()
    found = V.match_cells(cells, obs, ["indicator", "iso3"]).filter("official IS NULL AND size(nearby) > 0")
    return found.select("indicator", "iso3", "period", F.array_join(F.transform("nearby", lambda o: o["period"]), ";").alias("nearby"))


@query(
    "f9_claim_validation",
    sql("""SELECT claim_id, CASE claim_id % 8 WHEN 0 THEN 'claimed_value_not_a_number' WHEN 1 THEN 'malformed_period' WHEN 2 THEN 'unknown_indicator'
            WHEN 3 THEN 'country_required' WHEN 4 THEN 'malformed_as_of' WHEN 5 THEN CASE WHEN indicator IN ('order_value', 'order_count') THEN NULL ELSE 'as_of_not_supported' END
            WHEN 6 THEN 'text_too_long' END AS claim_error FROM claims"""),
)
def f9(t: Tables):
    k, c = F.col("claim_id") % 8, t.claims()
    c = (
        c.withColumn("claimed_value", F.when(k != 0, F.col("claimed_value")))
        .withColumn("period", F.when(k == 1, F.lit("20x4")).otherwise(F.col("period")))
        .withColumn("indicator", F.when(k == 2, F.lit("no_such_key")).when(k == 6, F.repeat(F.col("indicator"), 30)).otherwise(F.col("indicator")))
        .withColumn("country", F.when(k != 3, F.col("country")))
        .withColumn("as_of", F.when(k == 4, F.lit("2019-02-31")).when(k == 5, F.lit("2019-04")))
    )
    return V.validate_claims(c, t.indicators()).select("claim_id", "claim_error")


def _spend_key(custkey) -> F.Column:
    return F.when(custkey % 2 == 0, F.lit("spend_even")).otherwise(F.lit("spend_odd"))


@query(
    "f12_absence_class",
    sql("""SELECT iso3, start_year, CASE WHEN n_all IS NULL THEN 'no_published_data' WHEN n_in = 0 THEN 'outside_window' END AS absence,
            CASE WHEN n_in = 0 OR n_all IS NULL THEN first_period END AS available_from, CASE WHEN n_in = 0 OR n_all IS NULL THEN last_period END AS available_to
        FROM (SELECT r.iso3, r.start_year, s.n_all, s.first_period, s.last_period, (SELECT count(*) FROM monthly m WHERE m.iso3 = r.iso3 AND m.value IS NOT NULL AND m.year BETWEEN r.start_year AND r.start_year + 1) AS n_in
              FROM (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS iso3, CAST(1995 + c_custkey % 12 AS INTEGER) AS start_year FROM customer) r
              LEFT JOIN (SELECT iso3, count(*) AS n_all, min(period) AS first_period, max(period) AS last_period FROM monthly WHERE value IS NOT NULL GROUP BY iso3) s ON s.iso3 = r.iso3)"""),
)
def f12(t: Tables):
    from econcheck.queries.inputs import customer_code

    start = (F.lit(1995) + F.col("c_custkey") % 12).cast("int")
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"), _spend_key(F.col("c_custkey")).alias("indicator"), customer_code(F.col("c_custkey")).alias("iso3"),
        start.alias("start_year"), (start + 1).alias("end_year"), F.lit("none").alias("transform"), F.lit(80).alias("limit"), F.lit(False).alias("strict"),
    )
    obs = t.monthly().withColumn("source", F.lit("wdi")).withColumn("indicator", _spend_key(F.substring("iso3", 2, 20).cast("long")))
    chain = t.spark.createDataFrame([("spend_even", "wdi", 1), ("spend_odd", "wdi", 1)], "indicator string, source string, priority int")
    _, outcomes = S.get_series(requests, obs, chain)
    return outcomes.join(requests.select("request_id", "start_year"), "request_id").select("iso3", "start_year", "absence", "available_from", "available_to")


@query(
    "v11_get_series",
    sql("""SELECT request_id, period, round(value, 4) AS value FROM (
          SELECT request_id, period, value, row_number() OVER (PARTITION BY request_id ORDER BY period DESC) AS rn, k FROM (
            SELECT m.*, min(CASE WHEN value IS NOT NULL THEN period END) OVER (PARTITION BY request_id) AS a, max(CASE WHEN value IS NOT NULL THEN period END) OVER (PARTITION BY request_id) AS b
            FROM (
              SELECT w.request_id, w.k, w.period, w.value FROM win w WHERE k = 0
              UNION ALL SELECT w.request_id, w.k, w.period, CASE WHEN p.value <> 0 THEN (w.value - p.value) / abs(p.value) * 100 END FROM win w JOIN win p ON p.request_id = w.request_id AND p.idx = w.idx - 12 WHERE w.k = 1
              UNION ALL SELECT w.request_id, w.k, w.period, CASE WHEN p.value <> 0 THEN (w.value - p.value) / abs(p.value) * 100 END FROM win w JOIN win p ON p.request_id = w.request_id AND p.idx = w.idx - 1 WHERE w.k = 2
              UNION ALL SELECT w.request_id, w.k, w.period, w.value / (SELECT arg_min(b.value, b.period) FROM win b WHERE b.request_id = w.request_id AND b.value IS NOT NULL) * 100 FROM win w WHERE w.k = 3) m)
          WHERE period BETWEEN a AND b) WHERE rn <= 6""",
        win="""SELECT c_custkey AS request_id, c_custkey % 4 AS k, m.period, m.value, m.idx FROM customer JOIN monthly m ON m.iso3 = 'C' || CAST(c_custkey AS VARCHAR)
               WHERE m.year BETWEEN 1996 AND 2000"""),
)
def v11(t: Tables):
    from econcheck.queries.inputs import customer_code

    name = F.element_at(F.array(*[F.lit(x) for x in S.TRANSFORMS]), (F.col("c_custkey") % 4 + 1).cast("int"))
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"), _spend_key(F.col("c_custkey")).alias("indicator"), customer_code(F.col("c_custkey")).alias("iso3"),
        F.lit(1996).alias("start_year"), F.lit(2000).alias("end_year"), name.alias("transform"), F.lit(6).alias("limit"), F.lit(False).alias("strict"),
    )
    obs = t.monthly().withColumn("source", F.lit("wdi")).withColumn("indicator", _spend_key(F.substring("iso3", 2, 20).cast("long")))
    chain = t.spark.createDataFrame([("spend_even", "wdi", 1), ("spend_odd", "wdi", 1)], "indicator string, source string, priority int")
    rows, _ = S.get_series(requests, obs, chain)
    return rows.select("request_id", "period", F.round("value", 4).alias("value"))


_OUTCOMES = """
    SELECT a.*, coalesce(w.n_in, 0) AS n_in, s.n_series, s.first_period, s.last_period, w.base,
           CASE WHEN k = 1 THEN coalesce(w.n_yoy, 0) ELSE coalesce(w.n_in, 0) END AS n_shown,
           CASE WHEN k = 1 THEN w.yoy_last ELSE w.last END AS last_shown, CASE WHEN k = 1 THEN w.yoy_proj ELSE w.proj END AS first_proj, CASE WHEN k = 1 THEN w.yoy_out ELSE w.out END AS last_out
    FROM (SELECT r.*, c.source, c.priority, (c.source = 'wdi' AND r.nk % 5 = 3) AS down FROM asked r JOIN chain c ON c.indicator = r.indicator WHERE NOT r.strict OR c.priority = 1) a
    LEFT JOIN (SELECT r.request_id, o.source, count(*) AS n_in, max(o.period) AS last, min(o.period) AS base,
                 min(CASE WHEN o.note IS NOT NULL THEN o.period END) AS proj, max(CASE WHEN o.note IS NULL THEN o.period END) AS out,
                 count(*) FILTER (WHERE p) AS n_yoy, max(CASE WHEN p THEN o.period END) AS yoy_last, min(CASE WHEN p AND o.note IS NOT NULL THEN o.period END) AS yoy_proj, max(CASE WHEN p AND o.note IS NULL THEN o.period END) AS yoy_out
               FROM asked r JOIN (SELECT x.*, b.year IS NOT NULL AS had FROM obs x LEFT JOIN obs b ON b.source = x.source AND b.indicator = x.indicator AND b.iso3 = x.iso3 AND b.year = x.year - 1) o
                 ON o.indicator = r.indicator AND o.iso3 = r.iso3 AND o.year BETWEEN r.s AND r.e, LATERAL (SELECT o.had AND o.year > r.s AS p) z
               GROUP BY r.request_id, o.source) w ON w.request_id = a.request_id AND w.source = a.source
    LEFT JOIN (SELECT source, indicator, iso3, count(*) AS n_series, min(period) AS first_period, max(period) AS last_period FROM obs GROUP BY ALL) s
      ON s.source = a.source AND s.indicator = a.indicator AND s.iso3 = a.iso3"""
_ASKED = """
    SELECT c_custkey AS request_id, c_nationkey AS nk, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS iso3, (['order_value', 'order_count', 'urgent_share', 'price_index'])[c_custkey % 4 + 1] AS indicator,
           CAST(1990 + c_custkey % 13 AS INTEGER) AS s, CAST(1990 + c_custkey % 13 + c_custkey // 13 % 5 AS INTEGER) AS e, c_custkey % 3 AS k, c_custkey % 5 = 0 AS one, c_custkey % 7 = 0 AS strict
    FROM customer"""


def shared_requests(t: Tables):
    """One request per customer about its nation: few shapes, each asked for by many."""
    key = F.col("c_custkey")
    start = (F.lit(1990) + key % 13).cast("int")
    return t.customer.select(
        key.alias("request_id"), F.element_at(F.array(*[F.lit(i) for i in INDICATORS]), (key % 4 + 1).cast("int")).alias("indicator"), nation_code(F.col("c_nationkey")).alias("iso3"),
        start.alias("start_year"), (start + F.floor(key / 13) % 5).cast("int").alias("end_year"), F.element_at(F.array(F.lit("none"), F.lit("yoy"), F.lit("index")), (key % 3 + 1).cast("int")).alias("transform"),
        F.when(key % 5 == 0, F.lit(1)).alias("limit"), (key % 7 == 0).alias("strict"),
    )


def series_citations(t: Tables):
    """Citation of every official series."""
    name, day = F.concat(F.lit("Series "), "indicator"), F.lit("2026-08-08")
    wdi = C.wdi_citation(F.col("indicator"), name, F.col("iso3"), day, F.lit("2026-07-01"))
    imf = C.imf_citation(F.col("indicator"), F.lit("World Economic Outlook (October 2001)"), name, F.col("iso3"), F.lit("WEO"), day)
    return t.observations().select("source", "indicator", "iso3").distinct().withColumn("citation", F.when(F.col("source") == "wdi", wdi).otherwise(imf))


@query(
    "v11_outcomes",
    sql("""SELECT f.request_id, v.source, (v.source IS NOT NULL AND v.priority > 1) AS fallback_used,
            CASE WHEN v.priority > 1 THEN CASE WHEN f.down THEN 'transient' ELSE 'definitive' END END AS fallback_reason,
            CASE WHEN v.source IS NULL THEN CASE WHEN f.down THEN 'transient_failure' WHEN f.k > 0 AND f.n_in > 0 THEN 'transform_emptied' WHEN f.n_series IS NULL THEN 'no_published_data' ELSE 'outside_window' END END AS absence,
            CASE WHEN v.source IS NULL THEN f.first_period END AS available_from, CASE WHEN v.source IS NULL THEN f.last_period END AS available_to,
            CASE WHEN v.source IS NOT NULL THEN concat_ws(';', CASE v.k WHEN 1 THEN 'computed:yoy:lag=1' WHEN 2 THEN 'computed:index:base=' || v.base END,
                CASE WHEN v.one THEN CASE WHEN v.last_out IS NULL THEN 'projections_from:' || v.last_shown END ELSE 'projections_from:' || v.first_proj END,
                CASE WHEN v.one AND v.last_out < v.last_shown THEN 'latest_without_projections' END) END AS notes,
            CASE v.source WHEN 'wdi' THEN 'World Bank, World Development Indicators, series ' || v.indicator || ' (Series ' || v.indicator || '), data last updated 2026-07-01. Retrieved 2026-08-08 via Econcheck. https://data.worldbank.org/indicator/' || v.indicator || '?locations=' || v.iso3
              WHEN 'imf_datamapper' THEN 'International Monetary Fund, World Economic Outlook (October 2001), series imf/' || v.indicator || ' (Series ' || v.indicator || '). Retrieved 2026-08-08 via Econcheck. https://www.imf.org/external/datamapper/' || v.indicator || '@WEO/' || v.iso3 END AS citation_text
        FROM outcomes f LEFT JOIN (SELECT * FROM outcomes WHERE NOT down AND n_shown > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY priority) = 1) v ON v.request_id = f.request_id
        WHERE f.priority = 1""", outcomes=_OUTCOMES, asked=_ASKED),
)
def v11_outcomes(t: Tables):
    _, out = S.get_series(shared_requests(t), t.observations(), t.chain(), t.availability(), series_citations(t))
    return out.select(
        "request_id", "source", "fallback_used", "fallback_reason", "absence", "available_from", "available_to", F.array_join("notes", ";").alias("notes"),
        F.col("citation.citation_text").alias("citation_text"),
    )


@query(
    "v11_shared_rows",
    sql("""SELECT v.request_id, v.source, o.period, round(CASE v.k WHEN 0 THEN o.value WHEN 1 THEN (o.value - b.value) / abs(b.value) * 100 ELSE o.value / i.value * 100 END, 4) AS value, o.note
        FROM (SELECT * FROM outcomes WHERE NOT down AND n_shown > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY priority) = 1) v
        JOIN obs o ON o.source = v.source AND o.indicator = v.indicator AND o.iso3 = v.iso3 AND o.year BETWEEN v.s AND v.e
        LEFT JOIN obs b ON b.source = v.source AND b.indicator = v.indicator AND b.iso3 = v.iso3 AND b.year = o.year - 1
        LEFT JOIN obs i ON i.source = v.source AND i.indicator = v.indicator AND i.iso3 = v.iso3 AND i.period = v.base
        WHERE (v.k <> 1 OR (b.year IS NOT NULL AND o.year > v.s)) AND (NOT v.one OR o.period = coalesce(v.last_out, v.last_shown))""", outcomes=_OUTCOMES, asked=_ASKED),
)
def v11_shared_rows(t: Tables):
    rows, _ = S.get_series(shared_requests(t), t.observations(), t.chain(), t.availability())
    return rows.select("request_id", "source", "period", F.round("value", 4).alias("value"), "note")


@query(
    "v12_series_routing",
    sql("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'wdi' WHEN 1 THEN 'imf_datamapper' WHEN 2 THEN 'dbnomics' WHEN 3 THEN 'dbnomics' WHEN 4 THEN 'registry' WHEN 5 THEN 'fred' END AS route,
            CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_brand || '/' || p_type WHEN 4 THEN 'order_value' WHEN 5 THEN p_brand END AS code,
            CASE p_partkey % 7 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'country_required' END
               WHEN 1 THEN CASE WHEN p_type <> 'ECONOMY' THEN 'unknown_imf_code' WHEN p_size % 2 = 0 THEN NULL ELSE 'country_required' END
               WHEN 3 THEN 'malformed_series_id' WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'country_required' END
               WHEN 5 THEN 'source_refused' WHEN 6 THEN 'unrecognized_series_id' END AS route_error FROM part"""),
)
def v12(t: Tables):
    k, brand, kind = F.col("p_partkey") % 7, F.col("p_brand"), F.col("p_type")
    sid = (
        F.when(k == 0, F.concat(F.lit("WorldBank/"), brand)).when(k == 1, F.concat(F.lit("imf/"), kind))
        .when(k == 2, F.concat(F.lit("dbnomics/IMF/WEO:latest/"), brand, F.lit("/"), kind)).when(k == 3, F.concat(F.lit("dbnomics/IMF/"), brand))
        .when(k == 4, F.lit("Order_Value")).when(k == 5, F.concat(F.lit("fred/"), brand)).otherwise(F.col("p_name"))
    )
    ids = t.part.select("p_partkey", sid.alias("series_id"), F.when(F.col("p_size") % 2 == 0, F.lit("N01")).alias("country"))
    return S.route_series_id(ids, "series_id", list(KINDS), ["ECONOMY"]).select("p_partkey", "route", "code", "route_error")


@query(
    "f13_area_coverage",
    sql("""SELECT r.iso3, r.indicator, CASE WHEN r.indicator = 'price_index' AND r.iso3 = 'N03' THEN a.area WHEN r.indicator = 'price_index' THEN NULL ELSE a.area END AS area,
            CASE WHEN r.indicator = 'price_index' THEN CASE WHEN r.iso3 <> 'N03' THEN 'only_published_for_N03' END WHEN a.area IS NULL THEN 'area_not_published' END AS absence
        FROM (SELECT DISTINCT iso3, indicator FROM claims) r
        LEFT JOIN (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3, n_name AS area FROM nation WHERE n_nationkey % 3 = 0) a ON a.iso3 = r.iso3"""),
)
def f13(t: Tables):
    areas = t.nation.filter(F.col("n_nationkey") % 3 == 0).select(nation_code(F.col("n_nationkey")).alias("iso3"), F.col("n_name").alias("area"))
    asked = t.claims().select("iso3", "indicator").distinct()
    return S.covered(asked, areas, {"price_index": "N03"}).select("iso3", "indicator", "area", "absence")


@query(
    "f14_refused_sources",
    sql("""SELECT CAST(p_partkey AS VARCHAR) AS indicator, p_brand AS source FROM part
        WHERE p_brand NOT IN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 4 = 0)"""),
)
def f14(t: Tables):
    sources = t.part.select(F.col("p_partkey").cast("string").alias("indicator"), F.col("p_brand").alias("source"))
    ledger = t.nation.select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("source"),
        F.when(F.col("n_nationkey") % 4 == 0, F.lit("refused")).otherwise(F.lit("served")).alias("license_verdict"),
    )
    return S.servable_chain(sources, ledger).select("indicator", "source")


@query(
    "f17_registry_listing",
    sql("""SELECT CAST(p.p_partkey AS VARCHAR) AS indicator, coalesce(s.sources, '') AS sources, s.sources IS NOT NULL AS servable FROM part p LEFT JOIN
        (SELECT l_partkey, string_agg(src, ';' ORDER BY prio, src) AS sources FROM
           (SELECT DISTINCT l_partkey, 'S' || CAST(l_suppkey AS VARCHAR) AS src, l_suppkey % 7 AS prio FROM lineitem) GROUP BY l_partkey) s ON s.l_partkey = p.p_partkey"""),
)
def f17(t: Tables):
    sources = t.lineitem.select(
        F.col("l_partkey").cast("string").alias("indicator"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"),
        (F.col("l_suppkey") % 7).alias("priority"),
    ).distinct()
    return S.registry_listing(t.part.select(F.col("p_partkey").cast("string").alias("indicator")), sources)


@query(
    "c15_code_templates",
    sql("""SELECT p_partkey, 'C' || CAST(p_size AS VARCHAR) || '.' || p_type || '.X' || CAST(p_size % 7 AS VARCHAR) AS code, 'IMF/' || p_brand || ':1998-10' AS dataset FROM part"""),
)
def c15(t: Tables):
    df = t.part.select(
        "p_partkey", F.concat(F.lit("{ISO3}."), "p_type", F.lit(".{ISO2}")).alias("code"), F.concat(F.lit("IMF/"), "p_brand", F.lit(":latest")).alias("dataset"),
        F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("iso3"), F.concat(F.lit("X"), (F.col("p_size") % 7).cast("string")).alias("iso2"),
    )
    return S.substitute_codes(df, "1998-10").select("p_partkey", "code", "dataset")


@query(
    "v16_citations",
    sql(r"""SELECT p_partkey, 'World Bank, World Development Indicators, series ' || p_brand || ' (' || p_name || '), data last updated 2026-07-01. Retrieved 2026-08-08 via Econcheck. https://data.worldbank.org/indicator/' || p_brand || '?locations=C' || p_size AS citation_text,
            'World Bank. (n.d.). ' || p_name || ' [Data set]. World Development Indicators. Retrieved 2026-08-08, from https://data.worldbank.org/indicator/' || p_brand || '?locations=C' || p_size AS apa,
            '@misc{world_' || regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g') || '_2026,' || chr(10) || '  author = {{World Bank}},' || chr(10) || '  title = {{World Development Indicators: ' || p_name || '}},' || chr(10)
              || '  year = {2026},' || chr(10) || '  url = {https://data.worldbank.org/indicator/' || p_brand || '?locations=C' || p_size || '},' || chr(10)
              || '  note = {Series ' || replace(p_brand, '#', '\#') || '. Retrieved 2026-08-08 via Econcheck. The World Bank: World Development Indicators: ' || p_name || '}' || chr(10) || '}' AS bibtex FROM part"""),
)
def v16(t: Tables):
    c = C.wdi_citation(F.col("p_brand"), F.col("p_name"), F.concat(F.lit("C"), F.col("p_size").cast("string")), F.lit("2026-08-08"), F.lit("2026-07-01"))
    return t.part.select("p_partkey", c.alias("c")).select("p_partkey", "c.citation_text", "c.apa", "c.bibtex")


_DAY = "2026-08-08"
_CITED = """SELECT p_partkey, p_partkey % 5 AS k,
    CASE p_partkey % 5 WHEN 0 THEN 'International Monetary Fund' WHEN 1 THEN 'International Monetary Fund' WHEN 2 THEN p_brand WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'Bank for International Settlements' ELSE 'European Central Bank' END ELSE 'European Central Bank' END AS publisher,
    CASE p_partkey % 5 WHEN 0 THEN 'World Economic Outlook (October 2001)' WHEN 1 THEN 'Outlook & data' WHEN 2 THEN 'Outlook & data' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'BIS FLOW' ELSE 'ECB Data Portal FLOW' END ELSE 'Euro foreign exchange reference rates' END AS dataset,
    CASE p_partkey % 5 WHEN 0 THEN 'imf/' || p_brand WHEN 1 THEN 'IMF/WEO:' || p_size || '/' || p_brand WHEN 2 THEN 'OECD/WEO:' || p_size || '/' || p_brand
      WHEN 3 THEN (CASE WHEN p_size % 2 = 0 THEN 'bis' ELSE 'ecb' END) || '/FLOW/' || p_brand ELSE 'ECB/EURX' || p_size END AS sid,
    CASE p_partkey % 5 WHEN 4 THEN 'EUR/X' || p_size || ' reference exchange rate' ELSE p_name END AS name,
    CASE p_partkey % 5 WHEN 0 THEN 'https://www.imf.org/external/datamapper/' || p_brand || '@WEO/C' || p_size WHEN 1 THEN 'https://db.nomics.world/IMF/' || url_encode('WEO:' || p_size) || '/' || url_encode(p_brand)
      WHEN 2 THEN 'https://db.nomics.world/OECD/' || url_encode('WEO:' || p_size) || '/' || url_encode(p_brand) WHEN 3 THEN 'https://data.example/' || p_brand
      ELSE 'https://www.ecb.europa.eu/stats/policy_and_exchange_rates/euro_reference_exchange_rates/html/index.en.html' END AS url,
    CASE p_partkey % 5 WHEN 0 THEN 'Source: International Monetary Fund' WHEN 1 THEN 'Source: International Monetary Fund' WHEN 2 THEN 'Source: ' || p_brand || ' (via DBnomics)'
      WHEN 3 THEN 'Source: ' || (CASE WHEN p_size % 2 = 0 THEN 'Bank for International Settlements' ELSE 'European Central Bank' END) ELSE 'Source: European Central Bank euro foreign exchange reference rates' END AS attribution
    FROM part"""


def _escaped(x: str) -> str:
    return rf"regexp_replace({x}, '([&%$#_])', '\\\1', 'g')"


@query(
    "v16_citation_forms",
    sql(rf"""SELECT p_partkey, publisher || ', ' || dataset || ', series ' || sid || ' (' || name || '). Retrieved {_DAY} via Econcheck. ' || url AS citation_text,
            publisher || '. (n.d.). ' || name || ' [Data set]. ' || dataset || '. Retrieved {_DAY}, from ' || url AS apa,
            '@misc{{' || lower(regexp_extract(publisher, '^([A-Za-z]*)', 1)) || '_' || regexp_replace(sid, '[^A-Za-z0-9]+', '_', 'g') || '_2026,' || chr(10) || '  author = {{{{' || publisher || '}}}},' || chr(10)
              || '  title = {{{{' || {_escaped('dataset')} || ': ' || {_escaped('name')} || '}}}},' || chr(10) || '  year = {{2026}},' || chr(10) || '  url = {{' || url || '}},' || chr(10)
              || '  note = {{Series ' || {_escaped('sid')} || '. Retrieved {_DAY} via Econcheck. ' || {_escaped('attribution')} || '}}' || chr(10) || '}}' AS bibtex, attribution FROM cited""", cited=_CITED),
)
def v16_forms(t: Tables):
    k, size, brand, name, day = F.col("p_partkey") % 5, F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_name"), F.lit(_DAY)
    imf = C.imf_citation(brand, F.lit("World Economic Outlook (October 2001)"), name, F.concat(F.lit("C"), size), F.lit("WEO"), day)
    provider = F.when(k == 1, F.lit("IMF")).otherwise(F.lit("OECD"))
    named = F.when(k == 1, F.lit("International Monetary Fund")).otherwise(brand)
    other = C.aggregator_citation(provider, named, F.concat(F.lit("WEO:"), size), F.lit("Outlook & data"), brand, name, day)
    sdmx = C.sdmx_citation(F.when(F.col("p_size") % 2 == 0, F.lit("BIS")).otherwise(F.lit("ECB")), F.lit("FLOW"), brand, name, F.concat(F.lit("https://data.example/"), brand), day)
    fx = C.ecb_fx_citation(F.lit("EUR"), F.concat(F.lit("X"), size), day)
    # the forms differ in nullability only
    text = "struct<" + ",".join(f"{f}:string" for f in ("source", "dataset", "series_id", "series_name", "source_url", "license", "attribution", "retrieved_at", "citation_text", "bibtex", "apa")) + ">"
    cited = F.when(k == 0, imf.cast(text)).when(k <= 2, other.cast(text)).when(k == 3, sdmx.cast(text)).otherwise(fx.cast(text))
    return t.part.select("p_partkey", cited.alias("c")).select("p_partkey", "c.citation_text", "c.apa", "c.bibtex", "c.attribution")
