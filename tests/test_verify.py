import pytest

from econcheck.operators import verify as V

CLAIM = "claim_id int, indicator string, country string, iso3 string, period string, claimed_value double, tolerance_abs double, tolerance_pct double, as_of string"


@pytest.fixture(scope="module")
def world(spark):
    obs = [
        ("wdi", "inflation", "USA", "2022", 8.0, None), ("wdi", "inflation", "USA", "2023", 4.1, None), ("wdi", "inflation", "USA", "2024", 2.9, None),
        ("wdi", "gdp", "USA", "2023", 27000.0, None), ("wdi", "gdp", "USA", "2024", 29000.0, None),
        ("imf_datamapper", "debt", "USA", "2023", 121.7, None), ("imf_datamapper", "debt", "USA", "2026", 125.0, "IMF WEO estimate/projection"),
        ("dbnomics", "debt", "TWN", "2023", 30.0, None), ("dbnomics", "debt", "BRB", "2023", 110.0, None),
        ("bis", "policy", "USA", "2024-05", 5.25, None), ("bis", "policy", "USA", "2024-06-12", 5.5, None), ("bis", "policy", "USA", "2024-06-19", 5.6, None),
        ("wdi", "balance", "USA", "2023", -6.3, None), ("wdi", "balance", "USA", "2022", 0.0, None),
    ]
    editions = [
        ("2026-04", "debt", "USA", "2023", 130.0, None), ("2025-10", "debt", "USA", "2023", 130.0, None), ("2018-10", "debt", "USA", "2018", 104.0, "IMF WEO estimate/projection"),
        ("2018-10", "debt", "USA", "2017", 103.0, None),
    ]
    chain = [("inflation", "wdi", 1), ("gdp", "wdi", 1), ("debt", "imf_datamapper", 1), ("debt", "dbnomics", 2), ("policy", "bis", 1), ("balance", "wdi", 1)]
    ind = [("inflation", "percent", False, True, False), ("gdp", "level", False, True, False), ("debt", "percent", False, True, True), ("policy", "percent", True, True, False), ("balance", "percent", False, True, False)]
    avail = [("imf_datamapper", "debt", "BRB", "transient")]
    year = lambda p: int(p[:4])
    return dict(
        indicators=spark.createDataFrame(ind, "indicator string, kind string, modeled boolean, active boolean, has_editions boolean"),
        chain=spark.createDataFrame(chain, "indicator string, source string, priority int"),
        obs=spark.createDataFrame([(s, i, c, p, year(p), v, n) for s, i, c, p, v, n in obs], "source string, indicator string, iso3 string, period string, year int, value double, note string"),
        editions=spark.createDataFrame([(e, i, c, p, year(p), v, n) for e, i, c, p, v, n in editions], "edition string, indicator string, iso3 string, period string, year int, value double, note string"),
        availability=spark.createDataFrame(avail, "source string, indicator string, iso3 string, status string"),
    )


def run(spark, world, claims, today="2026-07-25", strict=False):
    full = [(i, c[0], c[1], c[1], c[2], c[3], *(list(c[4:]) + [None] * (7 - len(c)))) for i, c in enumerate(claims)]
    out = V.verify_claims(spark.createDataFrame(full, CLAIM), today=today, strict=strict, **world)
    return {r.claim_id: r for r in out.collect()}, out


def test_batch_verdicts_and_summary(spark, world):
    r, out = run(spark, world, [("inflation", "USA", "2024", 2.9), ("inflation", "USA", "2024", 2.95), ("gdp", "USA", "2024", 29900.0), ("gdp", "USA", "2024", 12.0)])
    assert [r[i].verdict for i in range(4)] == ["match", "match", "close", "mismatch"]
    s = V.summarize(out).first()
    assert (s.total, s.match, s.close, s.mismatch, s.cannot_verify, s.error) == (4, 2, 1, 1, 0, 0)


def test_bad_claims_do_not_stop_the_rest(spark, world):
    r, _ = run(spark, world, [("inflation", "USA", "20x4", 1.0), ("unknown", "USA", "2024", 1.0), ("inflation", None, "2024", 1.0), ("inflation", "USA", "2024", float("nan")), ("inflation", "USA", "2024", 2.9, None, None, "2019-04"), ("debt", "USA", "2023", 1.0, None, None, "2019-02-31"), ("inflation", "USA", "2024", 2.9)])
    assert [r[i].error for i in range(7)] == ["malformed_period", "unknown_indicator", "country_required", "claimed_value_not_a_number", "as_of_not_supported", "malformed_as_of", None]
    assert [r[i].status for i in range(7)] == ["error"] * 6 + ["ok"]


def test_diagnostics(spark, world):
    r, _ = run(spark, world, [("gdp", "USA", "2024", 29.0), ("balance", "USA", "2023", 6.3), ("inflation", "USA", "2024", 4.1), ("inflation", "USA", "2024", 0.029), ("balance", "USA", "2022", 0.04)])
    assert r[0].diagnostics == ["scale:thousands:smaller"] and r[1].diagnostics == ["opposite_sign"]
    assert "year:2023" in r[2].diagnostics and r[3].diagnostics[0] == "scale:percent_vs_decimal:smaller"
    assert r[4].verdict == "close" and r[4].relative_difference_pct is None


def test_prefix_period_takes_the_first_observation(spark, world):
    r, _ = run(spark, world, [("policy", "USA", "2024-06", 5.5), ("policy", "USA", "202405", 5.25), ("policy", "USA", "2024", 5.5), ("policy", "USA", "2024-07", 5.5)])
    assert (r[0].verdict, r[0].matched_period) == ("match", "2024-06-12") and r[1].verdict == "match"
    assert r[2].verdict == "cannot_verify" and "YYYY-MM" in r[2].explanation
    assert r[3].verdict == "cannot_verify" and "2024-06-19: 5.6" in r[3].explanation
    assert r[0].observation_status == "modeled_estimate"


def test_missing_period_explains_what_exists(spark, world):
    r, _ = run(spark, world, [("inflation", "USA", "2026", 2.0), ("inflation", "FRA", "2024", 2.0)])
    assert r[0].verdict == "cannot_verify" and "Available range: 2022–2024" in r[0].explanation and "2024: 2.9" in r[0].explanation
    assert r[1].status == "error" and r[1].error == "no_published_data"


def test_fallback_classes(spark, world):
    r, _ = run(spark, world, [("debt", "TWN", "2023", 30.0), ("debt", "BRB", "2023", 110.0), ("debt", "USA", "2026", 125.0)])
    assert (r[0].verdict, r[0].fallback_used, r[0].fallback_reason) == ("match", True, "definitive")
    assert (r[1].verdict, r[1].fallback_reason, r[1].official_value, r[1].difference) == ("cannot_verify", "transient", 110.0, None)
    assert r[2].is_projection and r[2].observation_status == "projection" and r[2].verdict == "match"
    s, _ = run(spark, world, [("debt", "TWN", "2023", 30.0), ("debt", "BRB", "2023", 110.0)], strict=True)
    assert [s[i].error for i in range(2)] == ["no_published_data", "source_unavailable"]


def test_revision_probe(spark, world):
    r, _ = run(spark, world, [("debt", "USA", "2023", 130.0), ("debt", "USA", "2023", 55.0), ("debt", "USA", "2023", 121.7), ("inflation", "USA", "2024", 9.0)])
    assert r[0].verdict == "mismatch" and r[0].revision_check.matches_previous and r[0].revision_check.previous_edition == "2025-10"
    assert r[0].revision_check.next_edition == "October 2026" and r[0].revision_check.previous_value == 130.0
    assert r[1].revision_check.matches_previous is False and r[2].revision_check is None and r[3].revision_check is None


def test_as_of_reads_that_edition_only(spark, world):
    r, _ = run(spark, world, [("debt", "USA", "2018", 104.0, None, None, "2019-04"), ("debt", "USA", "2023", 130.0, None, None, "2019-04"), ("debt", "FRA", "2018", 1.0, None, None, "2019-04")])
    assert (r[0].verdict, r[0].as_of.resolved_edition, r[0].as_of.inside_release_month, r[0].is_projection) == ("match", "2018-10", True, True)
    assert r[1].verdict == "cannot_verify" and r[1].revision_check is None
    assert r[2].error == "no_published_data"


def test_result_does_not_depend_on_salting(spark, world):
    # one cell holds nearly all claims
    claims = [("inflation", "USA", "2024", 2.9 if i % 3 else 4.1) for i in range(300)] + [("gdp", "USA", "2024", 29000.0)]
    r, _ = run(spark, world, claims)
    assert [r[i].verdict for i in range(300)] == ["match" if i % 3 else "mismatch" for i in range(300)] and len(r) == 301
