"""Queries on periods, transforms and projection flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from econcheck.functions import periods as P
from econcheck.operators import transforms as X
from econcheck.queries.cte import sql
from econcheck.queries.inputs import TODAY, Tables
from econcheck.queries.registry import query

KEY = ["iso3"]


@query("f1_period_range", sql("SELECT iso3, period, round(value, 4) AS value FROM monthly WHERE year BETWEEN 1997 AND 1999"))
def f1(t: Tables):
    return X.filter_years(t.monthly(), 1997, 1999).select("iso3", "period", F.round("value", 4).alias("value"))


@query(
    "f2_trim_null_edges",
    sql("""SELECT m.iso3, m.period, round(m.value, 4) AS value FROM monthly m
        JOIN (SELECT iso3, min(period) AS a, max(period) AS b FROM monthly WHERE value IS NOT NULL GROUP BY iso3) e
        ON m.iso3 = e.iso3 AND m.period BETWEEN e.a AND e.b"""),
)
def f2(t: Tables):
    return X.trim_null_edges(t.monthly(), KEY).select("iso3", "period", F.round("value", 4).alias("value"))


@query(
    "f3_projection_marks",
    sql("""SELECT edition, iso3, indicator, period,
        CASE WHEN year >= CAST(substr(edition, 1, 4) AS INTEGER) THEN 'IMF WEO estimate/projection' END AS note FROM editions"""),
)
def f3(t: Tables):
    tag = F.concat(F.lit("WEO:"), F.col("edition"))
    return X.mark_projections(t.editions(), tag).select("edition", "iso3", "indicator", "period", "note")


@query(
    "f4_projection_boundary",
    sql("""SELECT iso3, CAST(horizon AS INTEGER) AS horizon_year,
        CAST(CASE WHEN abs(horizon - 5 - 2001) > 1 THEN least(horizon - 3, 2001) ELSE horizon - 5 END AS INTEGER) AS boundary_year,
        abs(horizon - 5 - 2001) > 1 AS clamped
        FROM (SELECT iso3, max(year) + n AS horizon FROM (SELECT iso3, year, count(*) OVER (PARTITION BY iso3) % 9 AS n FROM monthly) GROUP BY iso3, n)"""),
)
def f4(t: Tables):
    # a payload per customer whose furthest year lies a few years beyond its last order
    per = t.monthly().groupBy("iso3").agg(F.max("year").alias("last"), F.count("*").alias("n"))
    payload = per.select("iso3", (F.col("last") + F.col("n") % 9).cast("string").alias("period"))
    edition_year = P.period_year(F.col("period")) - 3
    out = X.payload_boundaries(payload, F.to_date(F.lit(TODAY)), KEY, edition_year)
    return out.select("iso3", F.col("horizon_year").cast("int").alias("horizon_year"), "boundary_year", "clamped")


@query(
    "f5_edition_calendar",
    sql("""SELECT o_orderkey, edition, CASE WHEN right(edition, 2) = '10' THEN left(edition, 4) || '-04'
            ELSE CAST(CAST(left(edition, 4) AS INTEGER) - 1 AS VARCHAR) || '-10' END AS previous,
          CASE WHEN right(edition, 2) = '10' THEN 'April ' || CAST(CAST(left(edition, 4) AS INTEGER) + 1 AS VARCHAR)
            ELSE 'October ' || left(edition, 4) END AS next_label
        FROM (SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 11 THEN CAST(year(o_orderdate) AS VARCHAR) || '-10'
            WHEN month(o_orderdate) >= 5 THEN CAST(year(o_orderdate) AS VARCHAR) || '-04'
            ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) || '-10' END AS edition FROM orders)"""),
)
def f5(t: Tables):
    e = P.edition_at(F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", e.alias("edition"), P.previous_edition(e).alias("previous"), P.next_edition_label(e).alias("next_label"))


@query(
    "f6_stale_vintage",
    sql("""SELECT o_orderkey, ym AS resolved, '2001-10' AS expected, ym < '2001-10' AS stale
        FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders) WHERE o_orderkey % 3 <> 2"""),
)
def f6(t: Tables):
    # every third order carries a sibling dataset's tag, which is not a dated vintage
    prefix = F.element_at(F.array(F.lit("WEO:"), F.lit("FM:"), F.lit("WEOAGG:")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    tag = F.concat(prefix, F.date_format("o_orderdate", "yyyy-MM"))
    s = P.stale_vintage(tag, F.to_date(F.lit(TODAY)))
    return t.orders.select("o_orderkey", s.alias("s")).filter("s IS NOT NULL").select("o_orderkey", "s.*")


@query(
    "f7_freshness",
    sql("""SELECT iso3, newest_period, CAST(lag AS INTEGER) AS lag_months, CAST(budget AS INTEGER) AS budget_months, lag > budget AS stale
        FROM (SELECT iso3, max(period) AS newest_period,
                (2001 - CAST(left(max(period), 4) AS INTEGER)) * 12 + 12 - CAST(substr(max(period), 6, 2) AS INTEGER) AS lag,
                CASE right(iso3, 1) WHEN '1' THEN 2 WHEN '2' THEN 4 ELSE 18 END AS budget
              FROM monthly WHERE value IS NOT NULL GROUP BY iso3)"""),
)
def f7(t: Tables):
    freq = F.when(F.col("iso3").endswith("1"), F.lit("D")).when(F.col("iso3").endswith("2"), F.lit("M")).otherwise(F.lit("A"))
    return X.freshness(t.monthly(), KEY, freq, F.to_date(F.lit(TODAY)))


@query(
    "f8_edition_sentinels",
    sql("""SELECT p_partkey, array_to_string(list_filter([
            CASE WHEN p_size % 5 = 0 THEN 'edition_metadata_missing' END,
            CASE WHEN p_size % 5 <> 0 AND p_size % 4 <> 0 THEN 'horizon_off_pattern' END,
            CASE WHEN p_size % 5 <> 0 AND p_partkey % 80 > 40 THEN 'reloaded_after_release' END,
            CASE WHEN p_partkey % 6 = 0 THEN 'boundary_clamped' END,
            CASE WHEN p_size % 5 <> 0 AND p_partkey % 2 = 1 THEN 'databases_at_different_editions' END,
            CASE WHEN p_partkey % 3 = 0 THEN 'rounded_to_one_decimal' END,
            CASE WHEN 2000 + p_size % 30 < 2020 THEN 'series_ends_before_boundary' END], lambda x: x IS NOT NULL), ';') AS codes FROM part"""),
)
def f8(t: Tables):
    size, key = F.col("p_size"), F.col("p_partkey")
    dated = size % 5 != 0
    year, month = F.when(dated, F.lit(2020)), F.when(dated, F.lit(4))
    loaded = F.date_format(F.date_add(F.to_date(F.lit("2020-04-01")), (key % 80).cast("int")), "yyyy-MM-dd HH:mm:ss")
    codes = X.edition_sentinels(
        F.lit(2025) + size % 4, year, month, loaded, F.lit(2020), F.when(key % 2 == 1, F.lit(10)).otherwise(F.lit(4)),
        F.lit(2000) + size % 30, F.lit(2020), key % 6 == 0, F.when(key % 3 == 0, F.lit("WEO")).otherwise(F.lit("FM")),
    )
    return t.part.select("p_partkey", F.array_join(codes, ";").alias("codes"))


@query(
    "f10_period_spelling",
    sql("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN y || '-Q' || q WHEN 1 THEN y || '-Q' || q ELSE y || '-' || m END AS period
        FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, CAST(quarter(o_orderdate) AS VARCHAR) AS q, strftime(o_orderdate, '%m') AS m FROM orders)"""),
)
def f10(t: Tables):
    y, q = F.date_format("o_orderdate", "yyyy"), F.quarter("o_orderdate").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(y, F.lit("q"), q)).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), y, F.lit(" Q"), q)
    ).otherwise(F.date_format("o_orderdate", "yyyyMM"))
    return t.orders.select("o_orderkey", P.normalize_period(raw).alias("period"))


@query(
    "f11_as_of_dates",
    sql("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN y || '-12-31' WHEN 1 THEN y || '-' || m || '-01'
              WHEN 2 THEN CASE WHEN m IN ('04', '06', '09', '11', '02') THEN NULL ELSE y || '-' || m || '-31' END END AS as_of_day
        FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m FROM orders)"""),
)
def f11(t: Tables):
    k, y, ym = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yyyy-MM")
    raw = F.when(k == 0, y).when(k == 1, ym).when(k == 2, F.concat(ym, F.lit("-31"))).otherwise(F.concat(y, F.lit("-13-05")))
    return t.orders.select("o_orderkey", P.as_of_date(raw).cast("string").alias("as_of_day"))


_CHANGE = """SELECT c.iso3, c.period, CASE WHEN p.value <> 0 THEN round((c.value - p.value) / abs(p.value) * 100, 4) END AS value
    FROM monthly c JOIN monthly p ON c.iso3 = p.iso3 AND p.idx = c.idx - {step}"""


@query("w1_yoy", sql(_CHANGE.format(step=12)))
def w1(t: Tables):
    return X.year_over_year(t.monthly(), KEY).select("iso3", "period", F.round("value", 4).alias("value"))


@query("w2_pct_change", sql(_CHANGE.format(step=1)))
def w2(t: Tables):
    return X.period_change(t.monthly(), KEY).select("iso3", "period", F.round("value", 4).alias("value"))


@query(
    "w2_pct_change_daily",
    sql("""SELECT quote, CAST(day AS VARCHAR) AS period, CASE WHEN prev <> 0 THEN round((rate - prev) / abs(prev) * 100, 4) END AS value
        FROM (SELECT quote, day, rate, lag(rate) OVER (PARTITION BY quote ORDER BY day) AS prev, row_number() OVER (PARTITION BY quote ORDER BY day) AS rn
              FROM daily_quotes) WHERE rn > 1"""),
)
def w2_daily(t: Tables):
    daily = t.daily_quotes().select("quote", F.col("day").cast("string").alias("period"), F.col("rate").alias("value"))
    return X.period_change(daily, ["quote"]).select("quote", "period", F.round("value", 4).alias("value"))


@query(
    "w3_index_rebase",
    sql("""SELECT m.iso3, m.period, round(m.value / b.base * 100, 4) AS value, b.base_period
        FROM monthly m JOIN (SELECT iso3, min(period) AS base_period, arg_min(value, period) AS base FROM monthly WHERE value IS NOT NULL GROUP BY iso3) b
        ON m.iso3 = b.iso3"""),
)
def w3(t: Tables):
    out = X.rebase_index(t.monthly(), KEY).filter("usable_base")
    return out.select("iso3", "period", F.round("value", 4).alias("value"), "base_period")


@query(
    "w4_latest_non_null",
    sql("SELECT iso3, max(period) AS period, round(arg_max(value, period), 4) AS value FROM monthly WHERE value IS NOT NULL GROUP BY iso3"),
)
def w4(t: Tables):
    return X.latest_non_null(t.monthly(), KEY).select("iso3", "period", F.round("value", 4).alias("value"))


@query(
    "t1_latest_outturn",
    sql("""SELECT iso3, coalesce(a, b) AS period, round(CASE WHEN a IS NOT NULL THEN av ELSE bv END, 4) AS value, a IS NOT NULL AND n > 0 AS projections_skipped
        FROM (SELECT iso3, max(period) FILTER (WHERE note IS NULL) AS a, arg_max(value, period) FILTER (WHERE note IS NULL) AS av,
                max(period) AS b, arg_max(value, period) AS bv, count(note) AS n FROM monthly WHERE value IS NOT NULL GROUP BY iso3)"""),
)
def t1(t: Tables):
    return X.latest_outturn(t.monthly(), KEY).select("iso3", "period", F.round("value", 4).alias("value"), "projections_skipped")


@query(
    "t2_last_n",
    sql("""SELECT iso3, period, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY iso3 ORDER BY period DESC) AS rn FROM monthly) WHERE rn <= 5"""),
)
def t2(t: Tables):
    return X.last_n(t.monthly(), KEY, 5).select("iso3", "period", F.round("value", 4).alias("value"))
