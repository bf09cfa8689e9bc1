"""Claims that name a series by an explicit id, and retrieval requests that share series."""

import pytest
from pyspark.sql import functions as F

from econcheck.dims import registry
from econcheck.operators import compare as K
from econcheck.operators import explicit as E
from econcheck.operators import retrieval as R
from econcheck.operators import verify as V

CLAIM = "claim_id int, indicator string, country string, iso3 string, period string, claimed_value double, tolerance_abs double, tolerance_pct double, as_of string"
SERIES = "route string, provider string, dataset string, code string, iso3 string, period string, year int, value double, note string"
STORED = [
    ("wdi", None, None, "NY.GDP", "USA", "2023", 27000.0, None), ("wdi", None, None, "NY.GDP", "USA", "2022", 25000.0, None), ("wdi", None, None, "NY.GDP", "FRA", "2023", 3000.0, None),
    ("imf_datamapper", None, None, "DEBT", "USA", "2023", 121.0, None), ("imf_datamapper", None, None, "DEBT", "USA", "2027", 130.0, "IMF WEO estimate/projection"),
    ("dbnomics", "IMF", "WEO:2024-10", "USA.NGDP_RPCH.pcent_change", None, "2023", 2.5, None), ("dbnomics", "IMF", "WEO:2025-04", "USA.NGDP_RPCH.pcent_change", None, "2023", 2.9, None),
    ("dbnomics", "IMF", "WEO:2025-10", "OTHER", None, "2023", 1.0, None), ("dbnomics", "IMF", "WEOAGG:2025-04", "X/Y", None, "2023", 7.0, None),
    ("dbnomics", "OECD", "EO", "FRA.GAP", None, "2024-Q1", -0.5, None), ("dbnomics", "OECD", "EO", "FRA.EMPTY", None, "2024-Q1", None, None),
    ("dbnomics", "OECD", "EO", "FRA.PLAIN", None, "2023", 2.0, None),
]


@pytest.fixture(scope="module")
def verify(spark):
    ind = spark.createDataFrame([("gdp", "level", False, True, True)], "indicator string, kind string, modeled boolean, active boolean, has_editions boolean")
    chain = spark.createDataFrame([("gdp", "wdi", 1)], "indicator string, source string, priority int")
    obs = spark.createDataFrame([("wdi", "gdp", "USA", "2023", 2023, 27000.0, None)], "source string, indicator string, iso3 string, period string, year int, value double, note string")
    series = spark.createDataFrame([(*s[:6], int(s[5][:4]), *s[6:]) for s in STORED], SERIES)
    names = spark.createDataFrame([("dbnomics", "OECD", "EO", "FRA.GAP", "Output gap", "Percent of potential")], "route string, provider string, dataset string, code string, name string, unit string")

    def run(claims, **how):
        rows = [(i, c[0], c[1], c[1], c[2], c[3], None, None, c[4] if len(c) > 4 else None) for i, c in enumerate(claims)]
        out = V.verify_claims(spark.createDataFrame(rows, CLAIM), ind, chain, obs, today="2025-12-01", series=series, series_names=names, imf_codes=["DEBT"], **how)
        return {r.claim_id: r for r in out.collect()}

    return run


def test_every_route_answers(verify):
    r = verify([
        (" WorldBank/ny.gdp", "USA", "2023", 27000.0), ("wb/NY.GDP", "FRA", "2023", 3020.0), ("imf/DEBT", "USA", "2027", 130.0),
        ("dbnomics/IMF/WEO:latest/USA.NGDP_RPCH.pcent_change", None, "2023", 2.9), ("dbnomics/IMF/WEO:2024-10/USA.NGDP_RPCH.pcent_change", None, "2023", 2.9),
        ("dbnomics/IMF/WEOAGG:2025-04/X/Y", "USA", "2023", 7.0), (" GDP ", "USA", "2023", 27000.0),
    ])
    assert [r[i].error for i in range(7)] == [None] * 7
    assert (r[0].verdict, r[0].series_id, r[0].observation_status, r[0].indicator) == ("match", "worldbank/NY.GDP", "actual", " WorldBank/ny.gdp")
    assert r[1].verdict == "close" and r[1].iso3 == "FRA"
    assert (r[2].verdict, r[2].is_projection, r[2].observation_status, r[2].series_id) == ("match", True, "projection", "imf/DEBT")
    # the newest edition that has this series, not the newest of the dataset
    assert (r[3].verdict, r[3].series_id, r[3].observation_status) == ("match", "dbnomics/IMF/WEO:2025-04/USA.NGDP_RPCH.pcent_change", "estimate_or_actual")
    assert r[4].verdict == "mismatch" and r[4].official_value == 2.5
    # codes may hold slashes; a sibling dataset has no projection boundary
    assert (r[5].verdict, r[5].observation_status) == ("match", "unknown")
    assert (r[6].verdict, r[6].series_id, r[6].observation_status) == ("match", None, "actual")


def test_percent_is_told_from_id_unit_and_name(verify):
    """0.25 points off 2.9 or 0.2 off -0.5 are near in percentage points and far in relative terms."""
    r = verify([
        ("dbnomics/IMF/WEO:latest/USA.NGDP_RPCH.pcent_change", None, "2023", 3.15), ("dbnomics/OECD/EO/FRA.GAP", None, "2024-Q1", -0.3), ("dbnomics/OECD/EO/FRA.PLAIN", None, "2023", 2.25),
    ])
    assert [r[i].verdict for i in range(3)] == ["close", "close", "mismatch"]


def test_faults_are_named_in_order(verify):
    r = verify([
        ("worldbank/NY.GDP", None, "2023", 1.0), ("imf/NOPE", "USA", "2023", 1.0), ("imf/DEBT", None, "2023", 1.0), ("dbnomics/IMF/WEO:latest", None, "2023", 1.0), ("fred/CPI", "USA", "2023", 1.0),
        ("worldbank/NY.GDP", "USA", "2023", 1.0, "2019-04"), ("nothing", "USA", "2023", 1.0), ("worldbank/NY.GDP", "USA", "20x3", 1.0), ("dbnomics/OECD/EO/FRA.EMPTY", None, "2024-Q1", 1.0),
        ("dbnomics/OECD/EO/NONE", None, "2023", 1.0), ("worldbank/NY.GDP", "USA", "2010", 1.0), ("gdp", None, "2023", 1.0), ("dbnomics/IMF/EMPTY:latest/Z", None, "2023", 1.0),
    ])
    assert [r[i].error for i in range(13)] == [
        "country_required", "unknown_imf_code", "country_required", "malformed_series_id", "source_refused", "as_of_not_supported", "unknown_indicator", "malformed_period",
        "no_published_data", "no_published_data", None, "country_required", "no_published_data",
    ]
    assert r[10].verdict == "cannot_verify" and "Available range: 2022–2023" in r[10].explanation


def test_country_names_are_resolved(spark, verify):
    economies = spark.createDataFrame([("USA", "US", "United States", ["America"], 1), ("FRA", "FR", "France", [], 2)], "iso3 string, iso2 string, name string, aliases array<string>, ordinal int")
    r = verify([("worldbank/NY.GDP", "united states", "2023", 27000.0), ("gdp", "America", "2023", 27000.0), ("wb/NY.GDP", "Atlantis", "2023", 1.0), ("wb/NY.GDP", "FR", "2023", 3000.0)], economies=economies)
    assert [r[i].iso3 for i in range(4)] == ["USA", "USA", None, "FRA"] and [r[i].error for i in range(4)] == [None, None, "country_not_resolved", None]
    assert r[3].verdict == "match"


def test_explicit_ids_need_stored_series(spark):
    ind = spark.createDataFrame([("gdp", "level", False, True, True)], "indicator string, kind string, modeled boolean, active boolean, has_editions boolean")
    claims = spark.createDataFrame([(1, "worldbank/NY.GDP", "USA", "USA", "2023", 1.0, None, None, None)], CLAIM)
    assert V.validate_claims(claims, ind).first().claim_error == "unknown_indicator"
    assert V.validate_claims(claims, ind, []).first().claim_error is None


def test_registry_observations_by_their_published_ids(spark):
    obs = spark.createDataFrame(
        [("wdi", "gdp_growth", "BRB", "2023", 2023, 4.1, None), ("dbnomics", "gdp_growth", "BRB", "2023", 2023, 4.2, None), ("bis", "policy_rate", "USA", "2023", 2023, 5.0, None)],
        "source string, indicator string, iso3 string, period string, year int, value double, note string",
    )
    sources = spark.createDataFrame(
        [("gdp_growth", "wdi", 1, "WDI", "NY.GDP.MKTP.KD.ZG"), ("gdp_growth", "dbnomics", 2, "IMF/WEO:latest", "{ISO3}.NGDP_RPCH.pcent_change"), ("policy_rate", "bis", 1, "CBPOL", "D.US")],
        "indicator string, source string, priority int, dataset string, code string",
    )
    got = {r.route: r for r in E.addressable(obs, sources).collect()}
    assert set(got) == {"wdi", "dbnomics"} and (got["wdi"].code, got["wdi"].iso3) == ("NY.GDP.MKTP.KD.ZG", "BRB")
    assert (got["dbnomics"].provider, got["dbnomics"].dataset, got["dbnomics"].code, got["dbnomics"].iso3) == ("IMF", "WEO:latest", "BRB.NGDP_RPCH.pcent_change", None)
    assert set(E.registry_imf_codes()) == {d["imf"][0] for d in registry.INDICATORS if "imf" in d}


# --- retrieval over shared series -------------------------------------------------------

REQUEST = "request_id int, indicator string, iso3 string, start_year int, end_year int, transform string, limit int, strict boolean"
OBS = "source string, indicator string, iso3 string, period string, value double, note string"
CHAIN = "indicator string, source string, priority int"


def test_windows_merge(spark):
    def merged(*windows):
        array = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in windows])
        return [(w.lo, w.hi) for w in spark.range(1).select(R.merge_windows(array).alias("w")).first().w]

    assert merged((5, 9), (1, 3)) == [(1, 3), (5, 9)] and merged((1, 3), (4, 6)) == [(1, 6)]
    assert merged((1, 9), (2, 3), (8, 12), (20, 20)) == [(1, 12), (20, 20)] and merged((3, 1)) == [(3, 1)]


def test_a_shared_series_is_read_once(spark):
    """Ten thousand requests for one series make one row of reading and as many answers as there are shapes."""
    obs = spark.createDataFrame([("wdi", "gdp", "USA", str(y), float(y), None) for y in range(1950, 2030)] + [("wdi", "gdp", "FRA", "2000", 1.0, None)], OBS)
    chain = spark.createDataFrame([("gdp", "wdi", 1)], CHAIN)
    i = F.col("id").cast("int")
    requests = spark.range(10_000).select(
        i.alias("request_id"), F.lit("gdp").alias("indicator"), F.lit("USA").alias("iso3"), (F.lit(1990) + i % 3).alias("start_year"), (F.lit(1995) + i % 3).alias("end_year"),
        F.when(i % 2 == 0, F.lit("yoy")).alias("transform"), F.when(i % 4 == 0, F.lit(2)).alias("limit"), F.lit(None).cast("boolean").alias("strict"),
    )
    tried = R.asked_shapes(requests).join(chain, "indicator")
    assert R.asked_shapes(requests).count() == 6
    (read,) = R.read_series(tried, obs).collect()
    assert [o.period for o in read.observations] == [str(y) for y in range(1990, 1998)] and (read.first_period, read.last_period, read.n_series) == ("1950", "2029", 80)
    assert R.shaped_answers(requests, obs, chain, None).count() == 6
    rows, outcomes = R.get_series(requests, obs, chain)
    assert outcomes.count() == 10_000 and rows.groupBy("request_id").count().groupBy("count").count().orderBy("count").collect() == [(2, 2500), (5, 2500), (6, 5000)]


def test_notes_and_citations(spark):
    note = "IMF WEO estimate/projection"
    obs = spark.createDataFrame([("imf", "gdp", "USA", str(y), float(y), note if y >= 2024 else None) for y in range(2020, 2027)] + [("bis", "rate", "USA", f"2024-05-{d:02d}", float(d), None) for d in (1, 2, 3)], OBS)
    chain = spark.createDataFrame([("gdp", "imf", 1), ("rate", "bis", 1)], CHAIN)
    requests = spark.createDataFrame([
        (1, "gdp", "USA", None, None, None, None, None), (2, "gdp", "USA", None, None, None, 1, None), (3, "gdp", "USA", 2022, 2025, "index", None, None), (4, "gdp", "USA", 2024, 2026, "yoy", 1, None),
        (5, "rate", "USA", None, None, "yoy", None, None), (6, "rate", "USA", None, None, "pct_change", 2, None), (7, "gdp", "USA", None, None, None, 0, None),
    ], REQUEST)
    meta = spark.createDataFrame([("imf", "gdp", "USA", "cited")], "source string, indicator string, iso3 string, citation string")
    rows, outcomes = R.get_series(requests, obs, chain, series_meta=meta)
    out = {r.request_id: r for r in outcomes.collect()}
    got = {}
    for r in rows.collect():
        got.setdefault(r.request_id, {})[r.period] = r.value
    assert out[1].notes == ["projections_from:2024"] and out[1].citation == "cited" and len(got[1]) == 7
    assert got[2] == {"2023": 2023.0} and out[2].notes == ["latest_without_projections"]
    assert out[3].notes == ["computed:index:base=2022", "projections_from:2024"] and got[3]["2022"] == 100.0
    assert out[4].notes == ["computed:yoy:lag=1", "projections_from:2026"] and list(got[4]) == ["2026"]
    # a change on the year before is refused for daily labels; on the observation before it is not
    assert out[5].absence == "transform_unsupported" and out[5].notes is None and out[5].citation is None
    assert got[6] == {"2024-05-02": 100.0, "2024-05-03": 50.0} and 7 not in got and out[7].source == "imf"


def test_comparison_keeps_failed_sources_in_place(spark):
    obs = spark.createDataFrame([("wdi", "gdp", "USA", "2020", 10.0, None), ("imf", "gdp", "USA", "2020", 12.0, None), ("dbn", "gdp", "USA", "2010", 9.0, None)], OBS)
    chain = spark.createDataFrame([("gdp", "wdi", 1), ("gdp", "imf", 2), ("gdp", "dbn", 3), ("gdp", "bis", 4)], CHAIN)
    requests = spark.createDataFrame([(i, "gdp", "USA", 2020) for i in range(50)] + [(99, "gdp", "USA", None)], "request_id int, indicator string, iso3 string, year int")
    down = spark.createDataFrame([("wdi", "gdp", "USA", "transient")], "source string, indicator string, iso3 string, status string")
    per, compared = K.compare_sources(requests, obs, chain, down)
    got = {(r.request_id, r.source): r for r in per.collect()}
    assert len(got) == 51 * 4 and [got[0, s].error for s in ("wdi", "imf", "dbn", "bis")] == ["transient_failure", None, "outside_window", "no_published_data"]
    assert not got[0, "wdi"].ok and got[0, "wdi"].value is None and got[7, "imf"].value == 12.0 and compared.count() == 0
    per, compared = K.compare_sources(requests, obs, chain)
    assert {r.request_id for r in compared.collect()} == set(range(50)) and compared.first().spread_abs == 2.0
    assert K.compared(requests.select("indicator", "iso3", "year").distinct(), obs, chain).count() == 2
