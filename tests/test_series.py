import datetime as dt

import pytest
from pyspark.sql import functions as F

from econcheck.operators import chain as S
from econcheck.operators import compare as K
from econcheck.operators import money as M
from econcheck.operators import transforms as X

KEYS = ["s"]


def series(spark, points, name="a"):
    return spark.createDataFrame([(name, p, v, None) for p, v in points], "s string, period string, value double, note string")


def as_dict(df):
    return {r.period: r.value for r in df.collect()}


def test_yoy_ignores_gaps(spark):
    s = series(spark, [("2010", 100.0), ("2016", 120.0), ("2019", 150.0), ("2020", 165.0)])
    assert as_dict(X.year_over_year(s, KEYS)) == {"2020": 10.0}


def test_yoy_quarter_spellings(spark):
    s = series(spark, [("2022Q4", 100.0), ("2023-Q4", 110.0), ("2024Q4", None)])
    assert as_dict(X.year_over_year(s, KEYS)) == {"2023-Q4": pytest.approx(10.0), "2024Q4": None}


def test_yoy_monthly(spark):
    s = series(spark, [("2023-01", 200.0), ("2023-03", 210.0), ("2024-01", 220.0), ("2024-02", 230.0)])
    assert as_dict(X.year_over_year(s, KEYS)) == {"2024-01": pytest.approx(10.0)}


def test_pct_change_wraps_the_year(spark):
    s = series(spark, [("2023-Q3", 100.0), ("2023-Q4", 110.0), ("2024-Q1", 121.0), ("2024-Q3", 200.0)])
    got = as_dict(X.period_change(s, KEYS))
    assert got == {"2023-Q4": pytest.approx(10.0), "2024-Q1": pytest.approx(10.0)}


def test_pct_change_daily_is_positional_and_zero_base_is_null(spark):
    s = series(spark, [("2024-05-01", 100.0), ("2024-05-03", 0.0), ("2024-05-06", 50.0)])
    assert as_dict(X.period_change(s, KEYS)) == {"2024-05-03": -100.0, "2024-05-06": None}
    assert X.year_over_year(s, KEYS).count() == 0


def test_negative_base_uses_its_size(spark):
    assert as_dict(X.year_over_year(series(spark, [("2020", -10.0), ("2021", -5.0)]), KEYS)) == {"2021": 50.0}


def test_rebase(spark):
    s = series(spark, [("2019", None), ("2020", 50.0), ("2021", 75.0)])
    assert as_dict(X.rebase_index(s, KEYS)) == {"2019": None, "2020": 100.0, "2021": 150.0}
    assert as_dict(X.rebase_index(s, KEYS, "2021"))["2020"] == pytest.approx(66.6666667)
    zero = X.rebase_index(series(spark, [("2020", 0.0), ("2021", 5.0)]), KEYS)
    assert not zero.filter("usable_base").count()


def test_trim_keeps_interior_nulls(spark):
    s = series(spark, [("2018", None), ("2019", 1.0), ("2020", None), ("2021", 2.0), ("2022", None)])
    assert as_dict(X.trim_null_edges(s, KEYS)) == {"2019": 1.0, "2020": None, "2021": 2.0}


def test_latest_prefers_an_outturn(spark):
    df = spark.createDataFrame(
        [("a", "2024", 1.0, None), ("a", "2025", 2.0, "IMF WEO estimate/projection"), ("b", "2025", 3.0, "IMF WEO estimate/projection"), ("b", "2026", None, None)],
        "s string, period string, value double, note string",
    )
    got = {r.s: (r.period, r.projections_skipped) for r in X.latest_outturn(df, KEYS).collect()}
    assert got == {"a": ("2024", True), "b": ("2025", False)}


def test_last_n_plan_limits_before_the_shuffle(spark):
    s = series(spark, [(str(y), float(y)) for y in range(1990, 2020)])
    out = X.last_n(s, KEYS, 3)
    assert sorted(as_dict(out)) == ["2017", "2018", "2019"]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


OBS = [
    ("wdi", "gdp", "USA", "2019", 10.0), ("wdi", "gdp", "USA", "2020", 11.0), ("wdi", "gdp", "BRB", "2010", 5.0),
    ("imf_datamapper", "gdp", "BRB", "2020", 7.0), ("imf_datamapper", "gdp", "TWN", "2020", 9.0), ("imf_datamapper", "gdp", "TWN", "2021", 9.9), ("imf_datamapper", "gdp", "USA", "2020", 12.0),
]


def _get(spark, requests, status=()):
    obs = spark.createDataFrame([(*o, None) for o in OBS], "source string, indicator string, iso3 string, period string, value double, note string")
    chain = spark.createDataFrame([("gdp", "wdi", 1), ("gdp", "imf_datamapper", 2)], "indicator string, source string, priority int")
    req = spark.createDataFrame(requests, "request_id int, indicator string, iso3 string, start_year int, end_year int, transform string, limit int, strict boolean")
    avail = spark.createDataFrame(list(status), "source string, indicator string, iso3 string, status string") if status else None
    rows, outcomes = S.get_series(req, obs, chain, avail)
    answered = {}
    for r in rows.collect():
        answered.setdefault(r.request_id, {})[r.period] = r.value
    return answered, {o.request_id: o for o in outcomes.collect()}


def test_chain_falls_back_as_a_whole(spark):
    rows, out = _get(spark, [
        (1, "gdp", "USA", None, None, None, None, False),
        (2, "gdp", "BRB", 2015, 2025, None, None, False),
        (3, "gdp", "TWN", None, None, "yoy", None, False),
        (4, "gdp", "BRB", 2015, 2025, None, None, True),
        (5, "gdp", "XXX", None, None, None, None, False),
        (6, "gdp", "BRB", 2030, 2031, None, None, False),
        (7, "gdp", "BRB", None, None, "yoy", None, False),
        (8, "nope", "USA", None, None, None, None, False),
    ])
    assert rows[1] == {"2019": 10.0, "2020": 11.0} and not out[1].fallback_used
    assert rows[2] == {"2020": 7.0} and (out[2].source, out[2].fallback_reason) == ("imf_datamapper", "definitive")
    assert rows[3] == {"2021": pytest.approx(10.0)}
    assert 4 not in rows and (out[4].absence, out[4].available_from) == ("outside_window", "2010")
    assert out[5].absence == "no_published_data" and out[6].absence == "outside_window" and out[7].absence == "transform_emptied"
    assert out[8].absence == "inactive_indicator"


def test_transient_failures_are_disclosed(spark):
    down = [("wdi", "gdp", "USA", "transient"), ("imf_datamapper", "gdp", "BRB", "transient"), ("wdi", "gdp", "BRB", "transient")]
    rows, out = _get(spark, [(1, "gdp", "USA", None, None, None, 1, False), (2, "gdp", "BRB", None, None, None, None, False)], down)
    assert rows[1] == {"2020": 12.0} and out[1].fallback_reason == "transient"
    assert 2 not in rows and out[2].absence == "transient_failure"


def test_compare_sources(spark):
    obs = spark.createDataFrame([(*o, None) for o in OBS], "source string, indicator string, iso3 string, period string, value double, note string")
    chain = spark.createDataFrame([("gdp", "wdi", 1), ("gdp", "imf_datamapper", 2)], "indicator string, source string, priority int")
    req = spark.createDataFrame([("y", "gdp", "USA", 2020), ("l", "gdp", "USA", None), ("n", "gdp", "BRB", None)], "request_id string, indicator string, iso3 string, year int")
    per, cmp = K.compare_sources(req, obs, chain)
    got = {r.request_id: r for r in cmp.collect()}
    assert got["y"].spread_abs == 1.0 and got["y"].spread_pct == 8.7 and got["l"].period == "2020" and "n" not in got
    assert per.filter("request_id = 'n' AND ok").count() == 2


def _fx(spark, requests):
    days = [("EUR", "USD", "2020-06-12", 1.12), ("EUR", "USD", "2020-06-15", 1.10), ("EUR", "GBP", "2020-06-12", 0.9), ("EUR", "GBP", "2020-06-15", 0.88)]
    daily = spark.createDataFrame(days, "base string, quote string, d string, rate double").withColumn("day", F.to_date("d")).drop("d")
    official = spark.createDataFrame([("JAM", 2020, 142.75), ("JAM", 2023, 154.9), ("BRB", 2023, 2.0), ("GBR", 1990, 0.5), ("USA", 1990, 1.0)], "iso3 string, year int, value double")
    mapping = spark.createDataFrame([("JMD", "JAM"), ("BBD", "BRB"), ("GBP", "GBR"), ("USD", "USA")], "currency string, iso3 string")
    req = spark.createDataFrame(requests, "request_id int, amount double, base string, quote string, date string")
    return {r.request_id: r for r in M.fx_convert(req, daily, official, mapping, ["EUR", "USD", "GBP"], "2020-07-01").collect()}


def test_fx_routes(spark):
    r = _fx(spark, [
        (1, 100.0, "usd", "JMD", "2020-06-15"), (2, 100.0, "USD", "JMD", "2023"), (3, 1.0, "EUR", "USD", "2020-06-14"), (4, 1.0, "GBP", "USD", None),
        (5, 1.0, "GBP", "JMD", "2020-06-15"), (6, 1.0, "USD", "USD", None), (7, 1.0, "EUR", "USD", "2020"), (8, 1.0, "EUR", "USD", "1998-01-01"),
        (9, 1.0, "USD", "JMD", "1999"), (10, 1.0, "US", "JMD", None), (11, 1.0, "EUR", "USD", "June"), (12, 1.0, "GBP", "USD", "1990"), (13, 1.0, "BBD", "JMD", None),
    ])
    assert (r[1].rate, r[1].converted_amount, r[1].rate_date, r[1].precision) == (142.75, 14275.0, "2020", "annual_average")
    assert r[2].rate == 154.9 and r[2].rate_date == "2023"
    assert (r[3].rate, r[3].rate_date, r[3].precision) == (1.12, "2020-06-12", "daily")
    assert r[4].rate == pytest.approx(1.25) and r[4].rate_date == "2020-06-15"
    assert r[5].precision == "mixed" and r[5].rate == pytest.approx(1.25 * 142.75)
    assert (r[6].rate, r[6].rate_date) == (1.0, "n/a")
    assert r[7].rate == pytest.approx(1.11) and r[7].precision == "annual_average" and r[7].rate_date == "2020"
    assert r[8].error == "before_first_daily_rate" and r[9].error == "no_rate_for_period"
    assert r[10].error == "malformed_currency" and r[11].error == "malformed_date"
    assert r[12].rate == 2.0 and r[13].rate == pytest.approx(154.9 / 2)


def test_price_adjustment(spark):
    cpi = spark.createDataFrame([("USA", 1995, 70.0), ("USA", 2025, 140.0)], "iso3 string, year int, value double")
    req = spark.createDataFrame([(1, 100.0, "USA", 1995, 2025), (2, 1.0, "USA", 1990, 2026), (3, 1.0, "FRA", 1995, 2025)], "request_id int, amount double, iso3 string, from_year int, to_year int")
    r = {x.request_id: x for x in M.adjust_for_prices(req, cpi).collect()}
    assert (r[1].adjusted_amount, r[1].factor) == (200.0, 2.0)
    assert r[2].missing_years == "1990,2026" and (r[2].first_year, r[2].last_year) == (1995, 2025) and r[3].error == "no_index_for_economy"


def test_freshness_and_boundaries(spark):
    s = series(spark, [("2025-11", 1.0), ("2025-12", 2.0), ("2026-01", None)])
    (f,) = X.freshness(s, KEYS, F.lit("M"), F.lit(dt.date(2026, 8, 9))).collect()
    assert (f.newest_period, f.lag_months, f.stale) == ("2025-12", 8, True)
    weo = spark.createDataFrame([("a", "2017", None), ("a", "2018", None)], "s string, period string, note string")
    got = {r.period: r.note for r in X.mark_projections(weo, F.lit("WEO:2018-10")).collect()}
    assert got == {"2017": None, "2018": "IMF WEO estimate/projection"}
    assert all(r.note is None for r in X.mark_projections(weo, F.lit("WEOAGG:2018-10")).collect())
