"""Queries on source comparison, snapshots, currency and price adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from econcheck.operators import compare as K
from econcheck.operators import money as M
from econcheck.operators import transforms as X
from econcheck.operators.frame import missing_cells
from econcheck.plans.durable import cut_lineage
from econcheck.queries.cte import sql
from econcheck.queries.inputs import DATED, Tables, nation_code
from econcheck.queries.registry import query

DAILY = ["EUR", "USD", "CLI", "VIE", "PUR"]
OFFICIAL_CURRENCIES = {"SIG": "N01", "ERR": "N02", "CLI": "N03", "EUR": "N04"}
UNTIL = "2024-02-15"

_THREE = """SELECT source, indicator, iso3, period, year, value FROM obs
    UNION ALL SELECT 'dbnomics', 'order_value', iso3, period, year, value FROM shipments"""


def _three_sources(t: Tables):
    none = F.lit(None).cast("string")
    third = t.shipments().select(
        F.lit("dbnomics").alias("source"), F.lit("order_value").alias("indicator"), "iso3", "period", "year", "value", none.alias("note")
    )
    landed = t.observations().select("source", "indicator", "iso3", "period", "year", "value", "note").unionByName(third)
    return cut_lineage(landed)  # one row per nation, year and source


def _three_chain(t: Tables):
    rows = [(i, s, p) for i in DATED for p, s in enumerate(["wdi", "imf_datamapper", "dbnomics"], 1)]
    return t.spark.createDataFrame(rows, "indicator string, source string, priority int")


def _requests(t: Tables, year):
    n = t.nation.select(F.col("n_nationkey").alias("nk"), F.explode(F.array(*[F.lit(i) for i in DATED])).alias("indicator"))
    return n.select(
        F.concat_ws(":", "indicator", nation_code(F.col("nk"))).alias("request_id"), "indicator", nation_code(F.col("nk")).alias("iso3"),
        year.cast("int").alias("year"),
    )


def _every_year(t: Tables, landed):
    """One request per nation, indicator and year of the tables."""
    years = landed.select("year").distinct()
    return _requests(t, F.lit(None)).drop("year").join(F.broadcast(years), how="inner").withColumn("request_id", F.concat_ws(":", "request_id", "year"))


@query(
    "v13_compare_sources",
    sql("""SELECT indicator, iso3, period, count(*) AS n_sources, round(min(value), 4) AS low, round(max(value), 4) AS high,
            round(max(value) - min(value), 4) AS spread_abs,
            CASE WHEN (abs(min(value)) + abs(max(value))) / 2 > 1e-9 THEN round((max(value) - min(value)) / ((abs(min(value)) + abs(max(value))) / 2) * 100, 2) END AS spread_pct
        FROM three WHERE indicator IN ('order_value', 'order_count') AND value IS NOT NULL GROUP BY indicator, iso3, period HAVING count(*) >= 2""", three=_THREE),
)
def v13(t: Tables):
    landed = _three_sources(t)
    _, c = K.compare_sources(_every_year(t, landed), landed, _three_chain(t))
    parts = F.split("request_id", ":")
    return c.select(
        parts[0].alias("indicator"), parts[1].alias("iso3"), "period", "n_sources", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"),
        F.round("spread_abs", 4).alias("spread_abs"), "spread_pct",
    )


@query(
    "v13_per_source",
    sql("""SELECT r.indicator, r.iso3, CAST(r.year AS VARCHAR) AS compared_period, c.priority, c.source, (NOT c.down AND coalesce(n.n > 0, FALSE)) AS ok, CASE WHEN NOT c.down THEN v.period END AS period,
            CASE WHEN NOT c.down THEN round(v.value, 4) END AS value,
            CASE WHEN c.down THEN 'transient_failure' WHEN s.n IS NULL THEN 'no_published_data' WHEN n.n IS NULL THEN 'outside_window' END AS error
        FROM (SELECT DISTINCT year FROM three) y CROSS JOIN (SELECT n_nationkey AS nk, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3 FROM nation) a
        CROSS JOIN (VALUES ('order_value'), ('order_count')) i(indicator)
        CROSS JOIN LATERAL (SELECT i.indicator, a.iso3, a.nk, y.year) r
        CROSS JOIN LATERAL (SELECT p AS priority, src AS source, (src = 'wdi' AND r.nk % 5 = 3) AS down FROM (VALUES (1, 'wdi'), (2, 'imf_datamapper'), (3, 'dbnomics')) k(p, src)) c
        LEFT JOIN (SELECT source, indicator, iso3, count(*) AS n FROM three WHERE value IS NOT NULL GROUP BY ALL) s ON s.source = c.source AND s.indicator = r.indicator AND s.iso3 = r.iso3
        LEFT JOIN (SELECT t.source, t.indicator, t.iso3, y.year, count(*) AS n FROM three t JOIN (SELECT DISTINCT year FROM three) y ON abs(t.year - y.year) <= 1 WHERE t.value IS NOT NULL GROUP BY ALL) n
          ON n.source = c.source AND n.indicator = r.indicator AND n.iso3 = r.iso3 AND n.year = r.year
        LEFT JOIN three v ON v.source = c.source AND v.indicator = r.indicator AND v.iso3 = r.iso3 AND v.year = r.year""", three=_THREE),
)
def v13_per_source(t: Tables):
    landed = _three_sources(t)
    per, _ = K.compare_sources(_every_year(t, landed), landed, _three_chain(t), t.availability())
    return per.select("indicator", "iso3", "compared_period", "priority", "source", "ok", "period", F.round("value", 4).alias("value"), "error")


@query(
    "v13_compare_latest_shared",
    sql("""SELECT indicator, iso3, max(period) AS period, arg_max(n, period) AS n_sources FROM (
            SELECT indicator, iso3, period, count(*) AS n, (SELECT count(DISTINCT source) FROM three s WHERE s.indicator = three.indicator AND s.iso3 = three.iso3) AS total
            FROM three WHERE indicator IN ('order_value', 'order_count') GROUP BY indicator, iso3, period)
        WHERE n = total AND total >= 2 GROUP BY indicator, iso3""", three=_THREE),
)
def v13_latest(t: Tables):
    _, c = K.compare_sources(_requests(t, F.lit(None)), _three_sources(t), _three_chain(t))
    parts = F.split("request_id", ":")
    return c.select(parts[0].alias("indicator"), parts[1].alias("iso3"), "period", "n_sources")


@query(
    "x2_shared_periods",
    sql("""SELECT indicator, iso3, period, n AS n_sources FROM (
            SELECT indicator, iso3, period, count(DISTINCT source) AS n, (SELECT count(DISTINCT source) FROM three s WHERE s.indicator = three.indicator AND s.iso3 = three.iso3) AS total
            FROM three GROUP BY indicator, iso3, period) WHERE n = total""", three=_THREE),
)
def x2(t: Tables):
    return K.shared_periods(_three_sources(t), ["indicator", "iso3"])


@query(
    "v14_country_snapshot",
    sql("""SELECT iso3, indicator, max(period) AS period, round(arg_max(value, period), 4) AS value, 'wdi' AS source FROM obs
            WHERE source = 'wdi' AND indicator <> 'order_count' GROUP BY iso3, indicator
        UNION ALL SELECT iso3, indicator, CASE WHEN bool_or(nk % 7 <> 0 AND nk % 5 <> 3) THEN max(CASE WHEN source = 'wdi' THEN period END)
              ELSE max(CASE WHEN source = 'imf_datamapper' AND note IS NULL THEN period END) END,
            round(CASE WHEN bool_or(nk % 7 <> 0 AND nk % 5 <> 3) THEN arg_max(value, CASE WHEN source = 'wdi' THEN period END)
              ELSE arg_max(value, CASE WHEN source = 'imf_datamapper' AND note IS NULL THEN period END) END, 4),
            CASE WHEN bool_or(nk % 7 <> 0 AND nk % 5 <> 3) THEN 'wdi' ELSE 'imf_datamapper' END
          FROM obs WHERE indicator = 'order_count' GROUP BY iso3, indicator"""),
)
def v14(t: Tables):
    economies = t.nation.select(nation_code(F.col("n_nationkey")).alias("iso3"))
    keys = ["order_value", "urgent_share", "price_index"]
    found, _ = K.country_snapshot(economies, t.observations(), t.chain(), keys, "order_count", availability=t.availability())
    return found.select("iso3", "indicator", "period", F.round("value", 4).alias("value"), "source")


@query(
    "j10_missing_indicators",
    sql("""SELECT n.iso3, i.indicator FROM (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3 FROM nation) n
        CROSS JOIN (VALUES ('order_value'), ('order_count'), ('urgent_share'), ('price_index')) i(indicator)
        WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.source = 'wdi' AND o.iso3 = n.iso3 AND o.indicator = i.indicator)"""),
)
def j10(t: Tables):
    economies = t.nation.select(nation_code(F.col("n_nationkey")).alias("iso3"))
    keys = ["order_value", "order_count", "urgent_share", "price_index"]
    _, missing = K.country_snapshot(economies, t.observations(), t.chain(), keys, None)
    return missing.select("iso3", "indicator")


@query(
    "j10_missing_cells",
    sql("""SELECT 'C' || CAST(c_custkey AS VARCHAR) AS iso3, CAST(y.year AS INTEGER) AS year FROM customer CROSS JOIN (VALUES (1996), (1997), (1998), (1999), (2000)) y(year)
        WHERE NOT EXISTS (SELECT 1 FROM customer_annual a WHERE a.custkey = c_custkey AND a.year = y.year)"""),
)
def j10_cells(t: Tables):
    years = F.explode(F.sequence(F.lit(1996), F.lit(2000)))
    grid = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("iso3"), years.alias("year"))
    return missing_cells(grid, t.customer_annual().select("iso3", "year", "value"), ["iso3", "year"])


@query(
    "a4_annual_average",
    sql("SELECT base, quote, CAST(year(day) AS INTEGER) AS year, round(avg(rate), 6) AS average, count(*) AS days FROM daily_quotes GROUP BY 1, 2, 3"),
)
def a4(t: Tables):
    return M.annual_average(t.daily_quotes()).withColumn("average", F.round("average", 6))


@query(
    "j7_working_day_rate",
    sql("""SELECT e.event_id, CAST(q.day AS VARCHAR) AS rate_day, round(q.rate, 6) AS rate, coalesce(q.day < e.day, FALSE) AS shifted,
            CASE WHEN q.rate IS NULL THEN 'rate_unavailable' END AS error
        FROM (SELECT event_id, CAST(ts AS DATE) AS day, upper(substr(event_type, 1, 3)) AS quote FROM events) e
        ASOF LEFT JOIN daily_quotes q ON q.quote = e.quote AND q.day <= e.day"""),
)
def j7(t: Tables):
    asked = t.events.select("event_id", F.lit("EUR").alias("base"), F.upper(F.substring("event_type", 1, 3)).alias("quote"), F.to_date("ts").alias("day"))
    out = M.rate_on_day(asked, t.daily_quotes(), UNTIL, "event_id")
    return out.select("event_id", F.col("rate_day").cast("string").alias("rate_day"), F.round("rate", 6).alias("rate"), "shifted", "error")


def _conversions(t: Tables):
    """One conversion per event; currencies, date form and amount from the event itself."""
    names = F.array(*[F.lit(c) for c in ("USD", "EUR", "CLI", "VIE", "PUR", "SIG", "ERR")])
    k = F.col("event_id")
    form = k % 5
    date = (
        F.when(form == 0, F.lit(None).cast("string")).when(form == 1, F.lit("2024")).when(form == 2, F.lit("1998"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    return t.events.select(
        k.alias("request_id"), F.col("value").alias("amount"), F.element_at(names, (k % 7 + 1).cast("int")).alias("base"),
        F.element_at(names, (F.col("user_id") % 7 + 1).cast("int")).alias("quote"), date.alias("date"),
    )


def _fx_daily(t: Tables):
    q = t.daily_quotes()
    # the sign-up series stands in for the dollar leg
    return q.withColumn("quote", F.when(F.col("quote") == "SIG", F.lit("USD")).otherwise(F.col("quote")))


def _fx(t: Tables):
    official = t.annual().filter("indicator = 'price_index'").withColumn("year", F.col("year") + 23)
    official = official.unionByName(t.annual().filter("indicator = 'price_index'"))
    mapping = t.spark.createDataFrame(list(OFFICIAL_CURRENCIES.items()), "currency string, iso3 string")
    return M.fx_convert(_conversions(t), _fx_daily(t), official.select("iso3", "year", "value"), mapping, DAILY, UNTIL)


_FXD = """SELECT base, CASE WHEN quote = 'SIG' THEN 'USD' ELSE quote END AS quote, day, rate FROM daily_quotes
    UNION ALL SELECT DISTINCT 'EUR', 'EUR', day, 1.0::DOUBLE FROM daily_quotes"""
_FXY = """SELECT c.currency, a.year + s.k AS year, 1.0::DOUBLE / a.value AS upu FROM annual a
    JOIN (VALUES ('SIG', 'N01'), ('ERR', 'N02'), ('CLI', 'N03'), ('EUR', 'N04')) c(currency, iso3) ON c.iso3 = a.iso3
    CROSS JOIN (VALUES (0), (23)) s(k) WHERE a.indicator = 'price_index'"""
_CONV = """SELECT event_id AS request_id, value AS amount, (['USD', 'EUR', 'CLI', 'VIE', 'PUR', 'SIG', 'ERR'])[event_id % 7 + 1] AS base,
      (['USD', 'EUR', 'CLI', 'VIE', 'PUR', 'SIG', 'ERR'])[user_id % 7 + 1] AS quote,
      CASE event_id % 5 WHEN 1 THEN 2024 WHEN 2 THEN 1998 END AS fy, CASE WHEN event_id % 5 IN (3, 4) THEN CAST(ts AS DATE) END AS day FROM events"""
_LEGS = """SELECT c.*, base IN ('USD', 'EUR', 'CLI', 'VIE', 'PUR') AS bd, quote IN ('USD', 'EUR', 'CLI', 'VIE', 'PUR') AS qd,
      coalesce(day, DATE '2024-12-31') AS look, coalesce(fy, year(day)) AS by_year FROM conv c"""


@query(
    "v15_fx_convert",
    sql("""SELECT request_id, base, quote, route, round(rate, 8) AS rate, round(amount * rate, 6) AS converted_amount,
            CASE WHEN rate IS NULL THEN NULL WHEN route IN ('identical', 'daily') THEN 'daily'
              WHEN route = 'bridge' AND fy IS NULL AND base <> 'USD' AND quote <> 'USD' AND (bd OR qd) THEN 'mixed' ELSE 'annual_average' END AS precision,
            CASE WHEN rate IS NULL THEN 'no_rate_for_period' END AS error
        FROM (SELECT *, CASE route WHEN 'identical' THEN 1.0::DOUBLE WHEN 'daily' THEN qe / be WHEN 'annual_mean' THEN mean
                ELSE (CASE WHEN base = 'USD' THEN 1.0::DOUBLE WHEN bd AND fy IS NULL THEN ue / be ELSE bo END)
                   / (CASE WHEN quote = 'USD' THEN 1.0::DOUBLE WHEN qd AND fy IS NULL THEN ue / qe ELSE qo END) END AS rate
          FROM (SELECT l.*, CASE WHEN l.base = l.quote THEN 'identical' WHEN bd AND qd AND fy >= 1999 THEN 'annual_mean' WHEN bd AND qd AND fy IS NULL THEN 'daily' ELSE 'bridge' END AS route,
              b.rate AS be, q.rate AS qe, u.rate AS ue,
              (SELECT avg(x.rate / y.rate) FROM fxd x JOIN fxd y ON x.day = y.day WHERE x.quote = l.quote AND y.quote = l.base AND year(x.day) = l.fy) AS mean,
              CASE WHEN by_year IS NOT NULL THEN (SELECT max(upu) FROM fxy WHERE currency = l.base AND year = l.by_year) ELSE (SELECT arg_max(upu, year) FROM fxy WHERE currency = l.base) END AS bo,
              CASE WHEN by_year IS NOT NULL THEN (SELECT max(upu) FROM fxy WHERE currency = l.quote AND year = l.by_year) ELSE (SELECT arg_max(upu, year) FROM fxy WHERE currency = l.quote) END AS qo
            FROM legs l ASOF LEFT JOIN fxd b ON b.quote = l.base AND b.day <= l.look ASOF LEFT JOIN fxd q ON q.quote = l.quote AND q.day <= l.look
            ASOF LEFT JOIN (SELECT 'USD' AS usd, day, rate FROM fxd WHERE quote = 'USD') u ON u.usd = 'USD' AND u.day <= l.look))""",
        fxd=_FXD, fxy=_FXY, conv=_CONV, legs=_LEGS),
)
def v15(t: Tables):
    return _fx(t).select(
        "request_id", "base", "quote", "route", "rate", "converted_amount", "precision", "error"
    )


@query(
    "j8_usd_bridge",
    sql("""SELECT request_id, round((CASE WHEN base = 'USD' THEN 1.0::DOUBLE ELSE b.upu END) / (CASE WHEN quote = 'USD' THEN 1.0::DOUBLE ELSE q.upu END), 8) AS rate
        FROM (SELECT event_id AS request_id, (['USD', 'SIG', 'ERR'])[event_id % 3 + 1] AS base, (['USD', 'SIG', 'ERR'])[(event_id + 1 + user_id % 2) % 3 + 1] AS quote,
               1995 + event_id % 7 AS y FROM events) c
        LEFT JOIN fxy b ON b.currency = c.base AND b.year = c.y LEFT JOIN fxy q ON q.currency = c.quote AND q.year = c.y""", fxy=_FXY),
)
def j8(t: Tables):
    names = F.array(F.lit("USD"), F.lit("SIG"), F.lit("ERR"))
    k = F.col("event_id")
    asked = t.events.select(
        k.alias("request_id"), F.col("value").alias("amount"), F.element_at(names, (k % 3 + 1).cast("int")).alias("base"),
        F.element_at(names, ((k + 1 + F.col("user_id") % 2) % 3 + 1).cast("int")).alias("quote"), (F.lit(1995) + k % 7).cast("string").alias("date"),
    )
    official = t.annual().filter("indicator = 'price_index'").select("iso3", "year", "value")
    mapping = t.spark.createDataFrame(list(OFFICIAL_CURRENCIES.items()), "currency string, iso3 string")
    return M.fx_convert(asked, _fx_daily(t), official, mapping, DAILY, UNTIL).select("request_id", "rate")


@query(
    "j9_price_adjustment",
    sql("""SELECT r.o_orderkey AS request_id, round(o_totalprice * (b.value / a.value), 6) AS adjusted_amount, round(b.value / a.value, 6) AS factor,
            CASE WHEN b.value IS NULL THEN CAST(r.year + r.k AS VARCHAR) END AS missing_years, CASE WHEN b.value IS NULL THEN 'year_not_covered' END AS error
        FROM (SELECT *, o_orderkey % 4 AS k FROM obn) r
        JOIN annual a ON a.nk = r.nk AND a.year = r.year AND a.indicator = 'price_index'
        LEFT JOIN annual b ON b.nk = r.nk AND b.year = r.year + k AND b.indicator = 'price_index'"""),
)
def j9(t: Tables):
    asked = t.orders_by_nation().select(
        F.col("o_orderkey").alias("request_id"), F.col("o_totalprice").alias("amount"), nation_code(F.col("nk")).alias("iso3"),
        F.col("year").alias("from_year"), (F.col("year") + (F.col("o_orderkey") % 4).cast("int")).alias("to_year"),
    )
    cpi = t.annual().filter("indicator = 'price_index'").select("iso3", "year", "value")
    out = M.adjust_for_prices(asked, cpi)
    return out.select("request_id", "adjusted_amount", "factor", "missing_years", "error")
