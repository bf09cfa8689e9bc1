"""Queries on the benchmark frame and its ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from econcheck.operators import frame as B
from econcheck.operators import truth as G
from econcheck.plans.durable import cut_lineage
from econcheck.queries.cte import judge_sql, sql
from econcheck.queries.inputs import TODAY, Tables, customer_code
from econcheck.queries.registry import query

HEADLINE = ["order_value", "order_count"]
PROBES = ["survey_index"]
YEARS = [1996, 1997, 1998, 1999, 2000]
CLASSES = {"order_value": "A", "order_count": "C"}
REASONS = ["eligible", "missing_year", "null_value", "projection", "no_series_in_window", "fetch_failed_transient", "excluded_contested_official_data", "excluded_weo_only_entity"]


def economies(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("custkey"), customer_code(F.col("c_custkey")).alias("iso3"))


def latest_level(t: Tables):
    """Latest yearly total per customer, withheld for every fiftieth one."""
    g = t.frozen_customer_annual.groupBy("custkey", "iso3").agg(F.max_by("value", "year").alias("gdp"))
    return g.select("iso3", F.when(F.col("custkey") % 50 != 0, F.col("gdp")).alias("gdp"))


def tier_table(t: Tables):
    return B.tiers(economies(t), latest_level(t))


def frame_obs(t: Tables):
    a, k = t.frozen_customer_annual, F.col("custkey")
    entries = F.array(
        F.struct(F.lit("order_value").alias("indicator"), F.when((k + F.col("year")) % 7 != 0, F.col("value")).alias("value")),
        F.struct(F.lit("order_count").alias("indicator"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("survey_index").alias("indicator"), F.when(k % 4 == 0, F.col("n").cast("double")).alias("value")),
    )
    note = F.when((F.col("year") == 2000) & (k % 6 == 0), F.lit("IMF WEO estimate/projection"))
    source = F.when(k % 9 == 0, F.lit("dbnomics")).otherwise(F.lit("wdi"))
    return a.select("iso3", "year", note.alias("note"), source.alias("source"), F.explode(entries).alias("e")).select(
        "iso3", "e.indicator", "year", "e.value", "note", "source"
    )


def frame_cells(t: Tables):
    grid = B.complete_grid(tier_table(t).select("custkey", "iso3", "tier"), HEADLINE + PROBES, YEARS)
    k = F.col("custkey")
    loads = t.frozen_customer_annual.select("custkey", "iso3").distinct().select(
        "iso3", F.explode(F.array(*[F.lit(i) for i in HEADLINE + PROBES])).alias("indicator"), F.when(k % 23 == 0, F.lit("transient")).otherwise(F.lit("ok")).alias("status")
    )
    return B.enumerate_frame(grid, frame_obs(t), loads, PROBES, CLASSES)


def excluded_cells(t: Tables):
    # the frame is frozen before exclusions and draws read it
    cells = cut_lineage(frame_cells(t))
    stated = t.spark.createDataFrame(
        [("C5", ["order_count"], [1997, 1998], "contested_official_data"), ("C7", None, YEARS, "contested_official_data")],
        "iso3 string, indicators array<string>, years array<int>, reason string",
    )
    return B.apply_exclusions(cells, stated, B.derived_exclusions(cells, "wdi", ["dbnomics", "imf_datamapper"]))


_TIERS = """SELECT custkey, iso3, gdp, rank, CASE WHEN rank <= 20 THEN 'T1' WHEN rank <= 60 THEN 'T2' WHEN rank <= 120 THEN 'T3' ELSE 'T4' END AS tier
    FROM (SELECT *, row_number() OVER (ORDER BY gdp DESC NULLS LAST, iso3) AS rank FROM (
      SELECT c_custkey AS custkey, 'C' || CAST(c_custkey AS VARCHAR) AS iso3, (SELECT CASE WHEN c_custkey % 50 <> 0 THEN arg_max(value, year) END FROM customer_annual a WHERE a.custkey = c_custkey) AS gdp FROM customer))"""
_CELLS = """SELECT *, reason IS NULL AS eligible FROM (
      SELECT t.custkey, t.iso3, t.tier, i.indicator, i.probe, y.year, CASE WHEN i.indicator = 'order_value' THEN 'A' WHEN i.indicator = 'order_count' THEN 'C' END AS revision_class,
        CASE WHEN NOT EXISTS (SELECT 1 FROM customer_annual x WHERE x.custkey = t.custkey) THEN 'no_series_in_window' WHEN t.custkey % 23 = 0 THEN 'fetch_failed_transient' WHEN a.year IS NULL THEN 'missing_year'
             WHEN v IS NULL THEN 'null_value' WHEN y.year = 2000 AND t.custkey % 6 = 0 THEN 'projection' WHEN i.probe THEN 'null_probe_indicator' END AS reason,
        CASE WHEN t.custkey % 23 <> 0 THEN v END AS value, CASE WHEN t.custkey % 23 <> 0 AND v IS NOT NULL AND NOT (y.year = 2000 AND t.custkey % 6 = 0) THEN CASE WHEN t.custkey % 9 = 0 THEN 'dbnomics' ELSE 'wdi' END END AS source
      FROM tiers t CROSS JOIN (VALUES ('order_value', FALSE), ('order_count', FALSE), ('survey_index', TRUE)) i(indicator, probe) CROSS JOIN (VALUES (1996), (1997), (1998), (1999), (2000)) y(year)
      LEFT JOIN customer_annual a ON a.custkey = t.custkey AND a.year = y.year
      LEFT JOIN LATERAL (SELECT CASE i.indicator WHEN 'order_value' THEN CASE WHEN (t.custkey + a.year) % 7 <> 0 THEN a.value END WHEN 'order_count' THEN CAST(a.n AS DOUBLE) ELSE CASE WHEN t.custkey % 4 = 0 THEN CAST(a.n AS DOUBLE) END END AS v) l ON TRUE)"""
_MARKED = """SELECT c.*, CASE WHEN o.iso3 IS NOT NULL THEN 'weo_only_entity' WHEN c.iso3 = 'C7' OR (c.iso3 = 'C5' AND c.indicator = 'order_count' AND c.year IN (1997, 1998)) THEN 'contested_official_data' END AS exclusion_reason
    FROM cells c LEFT JOIN (SELECT iso3 FROM cells WHERE NOT probe GROUP BY iso3 HAVING bool_or(source = 'dbnomics') AND NOT coalesce(bool_or(source = 'wdi'), FALSE)) o ON o.iso3 = c.iso3"""
FVIEWS = dict(tiers=_TIERS, cells=_CELLS, marked=_MARKED)


def fsql(body: str, **extra: str) -> str:
    return sql(body, **FVIEWS, **extra)


@query("w5_gdp_tiers", fsql("SELECT iso3, rank, tier FROM tiers"))
def w5(t: Tables):
    return tier_table(t).select("iso3", "rank", "tier")


@query("f15_frame_eligibility", fsql("SELECT iso3, tier, indicator, CAST(year AS INTEGER) AS year, reason, eligible, round(value, 4) AS value, source, revision_class FROM cells"))
def f15(t: Tables):
    return frame_cells(t).select("iso3", "tier", "indicator", "year", "reason", "eligible", F.round("value", 4).alias("value"), "source", "revision_class")


@query("j11_exclusions", fsql("SELECT iso3, indicator, CAST(year AS INTEGER) AS year, exclusion_reason FROM marked WHERE exclusion_reason IS NOT NULL"))
def j11(t: Tables):
    return excluded_cells(t).filter("excluded").select("iso3", "indicator", "year", "exclusion_reason")


_SHOWN = "CASE WHEN exclusion_reason IS NOT NULL THEN 'excluded_' || exclusion_reason WHEN eligible THEN 'eligible' ELSE reason END"


@query(
    "a12_attrition",
    fsql("SELECT tier, indicator, " + ", ".join(f"count(*) FILTER (WHERE r = '{r}') AS {r}" for r in REASONS) + f", count(*) AS total FROM (SELECT *, {_SHOWN} AS r FROM marked WHERE NOT probe) GROUP BY 1, 2"),
)
def a12(t: Tables):
    return B.attrition(excluded_cells(t), REASONS)


def frozen(t: Tables):
    k = F.col("custkey")
    a = t.customer_annual()
    questions = a.select(
        F.concat(F.lit("Q"), k.cast("string"), F.lit("-"), F.col("year").cast("string")).alias("qid"), "iso3", F.lit("spend").alias("indicator"), "year",
        F.when(k % 10 == 8, F.lit("recency")).otherwise(F.lit("headline")).alias("segment"),
    )
    obs = a.filter(k % 13 != 0).select(
        "iso3", F.lit("spend").alias("indicator"), "year", F.when((k + F.col("year")) % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("year") >= 2001, F.lit("IMF WEO estimate/projection")).alias("note"), F.concat(F.lit("worldbank/"), "iso3").alias("series_id"),
    )
    return G.freeze(questions, obs, "2026-08-08")


_FOBS = "SELECT custkey, iso3, year, CASE WHEN (custkey + year) % 7 <> 0 THEN value END AS value, year >= 2001 AS proj FROM customer_annual WHERE custkey % 13 <> 0"
_FROZEN = """SELECT 'Q' || CAST(a.custkey AS VARCHAR) || '-' || CAST(a.year AS VARCHAR) AS qid, a.custkey, a.year, CASE WHEN a.custkey % 10 = 8 THEN 'recency' ELSE 'headline' END AS segment,
      h.value, h.iso3 IS NOT NULL AS has_series, coalesce(h.proj, FALSE) AS is_projection, p.value AS prev_value, coalesce(p.proj, FALSE) AS prev_is_projection, n.value AS next_value, coalesce(n.proj, FALSE) AS next_is_projection
    FROM customer_annual a LEFT JOIN fobs h ON h.custkey = a.custkey AND h.year = a.year LEFT JOIN fobs p ON p.custkey = a.custkey AND p.year = a.year - 1 LEFT JOIN fobs n ON n.custkey = a.custkey AND n.year = a.year + 1"""
TVIEWS = dict(fobs=_FOBS, frozen=_FROZEN)


@query("w8_ground_truth", sql("SELECT qid, segment, round(value, 4) AS value, is_projection, round(prev_value, 4) AS prev_value, prev_is_projection, round(next_value, 4) AS next_value, next_is_projection FROM frozen", **TVIEWS))
def w8(t: Tables):
    values = [F.round(c, 4).alias(c) for c in ("value", "prev_value", "next_value")]
    return frozen(t).select("qid", "segment", "is_projection", "prev_is_projection", "next_is_projection", *values)


@query(
    "c16_integrity_flags",
    sql("""SELECT qid, CASE WHEN segment = 'headline' AND value IS NULL THEN 'headline_value_null_at_snapshot' WHEN segment = 'headline' AND is_projection THEN 'headline_projection_at_snapshot'
            WHEN custkey % 3 = 0 THEN 'stale_cached_response:2026-08-08' END AS flag FROM frozen""", **TVIEWS),
)
def c16(t: Tables):
    key = F.regexp_extract("qid", r"^Q(\d+)-", 1).cast("long")
    expected = F.when(key % 3 == 0, F.lit("2026-08-09")).otherwise(F.lit("2026-08-08"))
    flag = G.integrity_flag(F.col("segment"), F.col("value"), F.col("is_projection"), F.col("retrieved_on"), expected)
    return frozen(t).select("qid", flag.alias("flag"))


@query(
    "w7_vintage_candidates",
    sql("""SELECT edition, CAST(step AS BIGINT) AS step, CAST(row_number() OVER (ORDER BY step, edition) AS INTEGER) AS preference FROM (
          SELECT edition, floor(abs(date_diff('day', DATE '2000-06-15', CAST(edition || '-01' AS DATE))) / 60) AS step FROM (SELECT DISTINCT edition FROM editions)
          WHERE edition < '2001-10' AND CAST(left(edition, 4) AS INTEGER) >= 1997)"""),
)
def w7(t: Tables):
    return G.vintage_candidates(t.editions(), TODAY, "2001-10")


@query(
    "w7_chosen_vintage",
    sql("""SELECT arg_min(edition, (floor(abs(date_diff('day', DATE '2000-06-15', CAST(edition || '-01' AS DATE))) / 60) * 1000000 + CAST(left(edition, 4) AS INTEGER) * 100 + CAST(right(edition, 2) AS INTEGER))) AS edition
        FROM editions WHERE edition < '2001-10' AND CAST(left(edition, 4) AS INTEGER) >= 1997 AND edition NOT LIKE '%-04'"""),
)
def w7_chosen(t: Tables):
    candidates = G.vintage_candidates(t.editions(), TODAY, "2001-10")
    return G.pick_vintage(candidates, t.editions().filter(~F.col("edition").endswith("-04")))


@query(
    "c9_revision_check",
    sql("""SELECT f.qid, CASE WHEN v.custkey IS NULL THEN 'cell_missing_in_vintage' ELSE 'ok' END AS status, round(c.value * 0.98::DOUBLE, 4) AS vintage_value, CASE WHEN f.segment = 'recency' AND v.custkey IS NOT NULL THEN v.n END AS n_projections
        FROM frozen f LEFT JOIN (SELECT custkey, count(*) FILTER (WHERE year >= 2000) AS n FROM customer_annual WHERE custkey % 3 <> 0 GROUP BY custkey) v ON v.custkey = f.custkey
        LEFT JOIN customer_annual c ON c.custkey = f.custkey AND c.year = f.year AND c.custkey % 3 <> 0 WHERE f.segment = 'recency' OR (f.has_series AND f.custkey % 2 = 0)""", **TVIEWS),
)
def c9_revision(t: Tables):
    key = F.regexp_extract("qid", r"^Q(\d+)-", 1).cast("long")
    truth = frozen(t).withColumn("series_id", F.when(F.col("series_id").isNotNull() & (key % 2 == 0), F.concat(F.lit("imf/"), "iso3")).otherwise(F.col("series_id")))
    vintage = t.customer_annual().filter("custkey % 3 <> 0").select(
        "iso3", F.lit("spend").alias("indicator"), "year", (F.col("value") * 0.98).alias("value"), F.lit(None).cast("string").alias("note")
    )
    out = G.revision_check(truth, vintage, "2000-04", ["spend"], [2000, 2001])
    return out.select("qid", "status", F.round("vintage_value", 4).alias("vintage_value"), F.size(F.map_keys("vintage_projections")).cast("long").alias("n_projections"))


@query(
    "j13_ground_truth_audit",
    sql("""SELECT qid, CASE WHEN NOT has_series THEN 'no_series_in_snapshot' WHEN custkey % 41 = 0 THEN 'primary_fetch_error:http_500' WHEN custkey % 5 = 0 AND value IS NOT NULL THEN 'DIVERGENT' WHEN custkey % 7 = 0 AND value IS NOT NULL THEN 'DIVERGENT' ELSE 'ok' END AS status,
            CASE WHEN NOT has_series THEN FALSE WHEN custkey % 41 = 0 THEN TRUE ELSE value IS NOT NULL AND (custkey % 5 = 0 OR custkey % 7 = 0) END AS divergent FROM frozen""", **TVIEWS),
)
def j13(t: Tables):
    snap = frozen(t)
    key = F.regexp_extract("qid", r"^Q(\d+)-", 1).cast("long")
    # an independent reading: a float's last digit apart, 1% off, missing, or unreadable
    read = F.when(key % 5 == 0, F.col("value") * 1.01).when(key % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value") * (1 + 1e-12))
    primary = snap.select("qid", read.alias("primary_value"), F.when(key % 41 == 0, F.lit("http_500")).alias("read_error"))
    return G.audit(snap, primary).select("qid", "status", "divergent")


@query(
    "j14_revision_drift",
    sql(f"""SELECT qid, round(abs(live - value), 4) AS abs_drift, CASE WHEN value <> 0 THEN round(abs((live - value) / value) * 100, 4) END AS rel_drift_pct, ({judge_sql('value', 'live', 'FALSE')}) <> 'mismatch' AS still_within_tolerance
        FROM (SELECT qid, value, value * (CASE custkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.01::DOUBLE ELSE 1.2::DOUBLE END) AS live FROM frozen) WHERE value IS NOT NULL AND live <> value""", **TVIEWS),
)
def j14(t: Tables):
    snap = frozen(t).withColumn("kind", F.lit("level"))
    key = F.regexp_extract("qid", r"^Q(\d+)-", 1).cast("long")
    factor = F.when(key % 3 == 0, F.lit(1.0)).when(key % 3 == 1, F.lit(1.01)).otherwise(F.lit(1.2))
    live = snap.select("qid", (F.col("value") * factor).alias("value"))
    d = G.drift(snap, live)
    return d.select("qid", F.round("abs_drift", 4).alias("abs_drift"), F.round("rel_drift_pct", 4).alias("rel_drift_pct"), "still_within_tolerance")


@query(
    "a5_economy_weights",
    sql("""SELECT 'C' || CAST(c_custkey AS VARCHAR) AS iso3, round(arg_max(a.value, a.year) FILTER (WHERE (a.custkey + a.year) % 7 <> 0), 4) AS gdp, CAST(arg_max(a.n, a.year) AS DOUBLE) AS population
        FROM customer LEFT JOIN customer_annual a ON a.custkey = c_custkey GROUP BY c_custkey"""),
)
def a5_weights(t: Tables):
    w = G.economy_weights(economies(t), frame_obs(t), "order_value", "order_count")
    return w.select("iso3", F.round("gdp", 4).alias("gdp"), "population")
