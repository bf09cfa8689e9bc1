import datetime as dt
import itertools
import math
import random

from pyspark.sql import functions as F

from econcheck.functions import citations as C
from econcheck.functions import judge as J
from econcheck.functions import periods as P
from econcheck.functions import stats as S
from econcheck.functions import text as T
from econcheck.functions import units as U


def test_judge_percent_and_level_cases(rows):
    cases = [
        (5.0, 5.0, True, "match"), (5.05, 5.0, True, "match"), (5.2, 5.0, True, "close"), (5.5, 5.0, True, "mismatch"),
        (2.8, 2.5, True, "close"), (252.0, 251.2, True, "match"), (203.0, 200.0, True, "close"), (206.0, 200.0, True, "mismatch"),
        (255.0, 251.2, True, "close"), (0.03, 0.0, True, "close"), (0.2, 0.0, True, "mismatch"), (0.0, 0.0, False, "match"),
        (1004.0, 1000.0, False, "match"), (1030.0, 1000.0, False, "close"), (1200.0, 1000.0, False, "mismatch"),
    ]
    got = rows([c[:3] for c in cases], "c double, o double, p boolean", J.judge(F.col("c"), F.col("o"), F.col("p")))
    assert got == [c[3] for c in cases]


def test_judge_caller_tolerance(rows):
    data = [(110.0, 100.0, False, None, 15.0), (105.0, 100.0, True, 2.0, None), (120.0, 100.0, True, 2.0, None), (130.0, 100.0, False, None, 15.0)]
    v = J.judge(F.col("c"), F.col("o"), F.col("p"), F.col("a"), F.col("r"))
    assert rows(data, "c double, o double, p boolean, a double, r double", v) == ["match", "close", "mismatch", "close"]


def _plain_judge(c, o, percent, close_pp=0.3, close_rel=0.02, m=1.0):
    a = abs(c - o)
    if a == 0:
        return "match"
    if o == 0:
        return "close" if a <= 0.05 * m else "mismatch"
    r = a / abs(o)
    if percent:
        return "match" if a <= 0.06 * m or r <= 0.005 * m else "close" if a <= close_pp * m or r <= close_rel * m else "mismatch"
    return "match" if r <= 0.005 * m else "close" if r <= 0.05 * m else "mismatch"


def test_class_bands_agree_with_service_and_only_relax(rows):
    officials = [0.0, 0.01, 0.5, 1.0, 2.5, 9.9, 57.3, 100.0, 251.2, -3.4, -120.0, 1e6, 3.2e9]
    steps = [0, 0.01, 0.05, 0.06, 0.061, 0.29, 0.3, 0.31, 0.5, 0.51, 1.0, 1.1]
    rels = [0.001, 0.0049, 0.0051, 0.0199, 0.0201, 0.029, 0.031, 0.049, 0.051, 0.2]
    grid = [(o + s * d, o) for o in officials for d in (1, -1) for s in steps] + [(o * (1 + s * d), o) for o in officials for d in (1, -1) for s in rels]
    data = [(c, o, k) for c, o in grid for k in ("percent", "level")]
    cols = [J.judge(F.col("c"), F.col("o"), F.col("k") == "percent")] + [J.judge_by_class(F.col("c"), F.col("o"), F.col("k"), x) for x in "ABC"]
    rank = {"match": 0, "close": 1, "mismatch": 2}
    for (c, o, k), (service, a, b, cc) in zip(data, rows(data, "c double, o double, k string", *cols)):
        assert service == a == _plain_judge(c, o, k == "percent")
        assert rank[a] >= rank[b] >= rank[cc]


def test_sweep_multiplier_scales_every_threshold(rows):
    data = [(0.09, 0.0), (5.1, 5.0), (5.55, 5.0)]
    got = rows(data, "c double, o double", *[J.judge_by_class(F.col("c"), F.col("o"), "percent", "A", m) for m in J.SWEEP_MULTIPLIERS])
    assert got == [tuple(_plain_judge(c, o, True, m=m) for m in J.SWEEP_MULTIPLIERS) for c, o in data]


def test_scale_and_sign(rows):
    ratio = F.col("r")
    data = [(100.0,), (0.01,), (0.00101,), (-0.99,), (5.0,), (None,)]
    assert rows(data, "r double", J.scale_diagnostics(ratio), J.is_sign_flip(ratio)) == [
        (["scale:percent_vs_decimal:larger"], False), (["scale:percent_vs_decimal:smaller"], False), (["scale:thousands:smaller"], False),
        ([], True), ([], False), ([], False),
    ]
    assert rows([(1000.0,), (0.001,), (3.0,)], "r double", J.scale_slip(ratio)) == [1000.0, 0.001, None]


def test_period_spelling_and_validity(rows):
    data = [("2024Q1",), ("2024 Q1",), ("2024-Q1",), ("2024q3",), ("202405",), (" 2024 ",), ("2024-1",), ("20x4",), ("2024-05",), ("202413",)]
    got = rows(data, "p string", P.normalize_period(F.col("p")), P.is_valid_period(P.normalize_period(F.col("p"))))
    assert got == [
        ("2024-Q1", True), ("2024-Q1", True), ("2024-Q1", True), ("2024-Q3", True), ("2024-05", True), ("2024", True), ("2024-1", False),
        ("20x4", False), ("2024-05", True), ("202413", True),
    ]


def test_period_index_treats_spellings_alike(rows):
    data = [("2023Q4",), ("2023-Q4",), ("2024-Q1",), ("2023-12",), ("2024-01",), ("2024",), ("2024-05-01",)]
    got = rows(data, "p string", P.period_index(F.col("p")))
    assert got[0] == got[1] == got[2] - 1 and got[3] == got[4] - 1 and got[5] == 2024 and got[6] is None


def test_edition_calendar(rows):
    days = [dt.date(2026, 7, 25), dt.date(2026, 4, 30), dt.date(2026, 11, 1), dt.date(2019, 4, 1)]
    e = P.edition_at(F.col("d"))
    got = rows([(d,) for d in days], "d date", e, P.previous_edition(e), P.next_edition_label(e))
    assert got == [
        ("2026-04", "2025-10", "October 2026"), ("2025-10", "2025-04", "April 2026"), ("2026-10", "2026-04", "April 2027"), ("2018-10", "2018-04", "April 2019"),
    ]


def test_as_of_dates_never_roll_over(rows):
    data = [("2019",), ("2019-04",), ("2019-04-15",), ("2019-02-31",), ("2019-13-05",), ("2019-13",), ("April 2019",)]
    assert rows(data, "s string", P.as_of_date(F.col("s"))) == [dt.date(2019, 12, 31), dt.date(2019, 4, 1), dt.date(2019, 4, 15), None, None, None, None]


def test_edition_label_parts(rows):
    data = [("World Economic Outlook (April 2026)",), ("Fiscal Monitor (October 2025)",), ("Weird (Notamonth 2026)",), ("no label",)]
    got = rows(data, "s string", P.edition_label_parts(F.col("s")))
    assert [None if g is None else (g.year, g.month) for g in got] == [(2026, 4), (2025, 10), None, None]


def test_projection_boundary(rows):
    today = F.lit(dt.date(2026, 7, 25))
    data = [(2031, None), (2015, None), (2030, None), (2029, 2024), (2015, 2030)]
    got = rows(data, "h int, e int", P.projection_boundary(F.col("h"), today, F.col("e")))
    assert [(g.boundary_year, g.clamped) for g in got] == [(2026, False), (2026, True), (2025, False), (2024, True), (2026, True)]


def test_vintage_tags(rows):
    today = F.lit(dt.date(2026, 7, 25))
    data = [("WEO:2025-04",), ("WEO:2026-04",), ("FM:2025-10",), ("WEOAGG:2020-10",), ("other",)]
    got = rows(data, "t string", P.stale_vintage(F.col("t"), today), P.boundary_from_tag(F.col("t")))
    assert [(None if s is None else s.stale, b) for s, b in got] == [(True, 2025), (False, 2026), (True, 2025), (None, None), (None, None)]


def test_months_behind(rows):
    got = rows([("2025-12",), ("2025",), ("2026-06-15",)], "p string", P.months_behind(F.col("p"), F.lit(dt.date(2026, 8, 9))))
    assert got == [8, 8, 2]


def test_name_key(rows):
    data = [("Côte d'Ivoire",), ("  Türkiye ",), ("São Tomé and Príncipe",), ("Korea, Dem. People's Rep.",), ("Curaçao",)]
    assert rows(data, "s string", T.name_key(F.col("s"))) == ["cote d ivoire", "turkiye", "sao tome and principe", "korea dem people s rep", "curacao"]


def _osa_within_one(a, b):
    if a == b:
        return True
    edits = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"}
    edits |= {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2:] for i in range(len(a) - 1)}
    return b in edits


def test_one_edit_and_its_blocking_keys(rows):
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abc", repeat=n)]
    rng = random.Random(7)
    data = [(rng.choice(words), rng.choice(words)) for _ in range(1500)] + [("barbados", "barbadoss"), ("jamaica", "jamiaca"), ("germany", "germny"), ("chin", "china")]
    a, b = F.col("a"), F.col("b")
    got = rows(data, "a string, b string", T.within_one_edit(a, b), F.arrays_overlap(T.deletion_keys(a), T.deletion_keys(b)))
    for (x, y), (near, blocked) in zip(data[:1500], got):
        assert near == _osa_within_one(x, y), (x, y)
        assert blocked or not near
    assert all(near for near, _ in got[1500:])


def test_figures_and_rounding(rows):
    data = [(1234567.8,), (1234.5,), (0.25,), (-3.10004,), (1000.0,), (0.00001,)]
    assert rows(data, "v double", T.format_figure(F.col("v"))) == ["1,234,568", "1,234.5", "0.25", "-3.1", "1,000", "0"]
    assert rows([(29.15,), (-29.15,), (54.05,)], "v double", T.round_half_up(F.col("v"), 1)) == [29.2, -29.2, 54.1]


def test_latency_buckets(rows):
    data = [(0.0,), (50.0,), (499.9,), (999.0,), (1000.0,), (3000.0,), (-1.0,), (float("nan"),), (None,)]
    assert rows(data, "m double", T.latency_bucket(F.col("m"))) == ["lt50ms", "lt200ms", "lt500ms", "lt1s", "lt3s", "gte3s", "unknown", "unknown", "unknown"]


def test_declared_units(rows):
    data = [
        ("%", "percent"), ("% of GDP", "percent"), ("basis points (bps)", "percent"), ("ratio", "percent"), ("percent share", "percent"), ("people", "percent"),
        ("billions of US$", "level"), ("millions of people", "level"), ("thousand million usd", "level"), ("%", "level"), ("EUR bn", "level"), ("usd per capita", "level"),
        ("widgets", "level"), (None, "level"), ("  ", "percent"), ("years", "level"), ("％", "percent"),
    ]
    got = rows(data, "u string, k string", U.declared_unit(F.col("u"), F.col("k")))
    assert [(g.ok, g.factor, g.reason) for g in got] == [
        (True, 1.0, None), (True, 1.0, None), (True, 0.01, None), (True, 100.0, None), (False, None, "ambiguous_percent_and_ratio"),
        (False, None, "kind_mismatch_expected_percent"), (True, 1e9, None), (True, 1e6, None), (True, 1e9, None), (False, None, "kind_mismatch_expected_level"),
        (False, None, "rejected_token:eur"), (False, None, "rejected_token:per"), (False, None, "unknown_token:widgets"),
        (False, None, "unit_missing_or_not_string"), (False, None, "unit_missing_or_not_string"), (True, 1.0, None), (True, 1.0, None),
    ]


def test_wilson(rows):
    (w,) = rows([(82, 100)], "k int, n int", S.wilson(F.col("k"), F.col("n")))
    z, p, n = 1.959963984540054, 0.82, 100
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    assert math.isclose(w.lo, mid - half, rel_tol=1e-12) and math.isclose(w.hi, mid + half, rel_tol=1e-12)
    (empty,) = rows([(0, 0)], "k int, n int", S.wilson(F.col("k"), F.col("n")))
    assert empty.rate is None and empty.lo is None and empty.hi is None


def _exact(b, c):
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    total = sum(math.comb(n, i) for i in range(k + 1))
    return min(1.0, (2 * total - (math.comb(n, k) if b == c else 0)) / 2**n)


def test_mcnemar_against_exact_integers(rows):
    pairs = [(b, c) for b in range(0, 14) for c in range(0, 14)] + [(30, 70), (500, 560), (1200, 1500), (4000, 4100), (3, 900), (2500, 2500)]
    got = rows(pairs, "b bigint, c bigint", S.mcnemar_exact(F.col("b"), F.col("c")))
    for (b, c), p in zip(pairs, got):
        assert math.isclose(p, _exact(b, c), rel_tol=1e-8, abs_tol=1e-300), (b, c)


def test_citation_formats_share_fields(rows):
    c = C.wdi_citation(F.col("i"), F.col("n"), F.lit("BRB"), F.lit("2026-08-08"), F.lit("2026-07-01"))
    (g,) = rows([("FP.CPI.TOTL.ZG", "Inflation, consumer prices (annual %)")], "i string, n string", c)
    assert g.citation_text.startswith("World Bank, World Development Indicators, series FP.CPI.TOTL.ZG (Inflation, consumer prices (annual %)), data last updated 2026-07-01.")
    assert "annual \\%" in g.bibtex and g.bibtex.startswith("@misc{world_FP_CPI_TOTL_ZG_2026,") and g.source_url in g.apa


def test_template(rows):
    out = T.fill_template(F.col("t"), {"COUNTRY": F.lit("Fiji"), "YEAR": F.lit(2020), "UNIT_HINT": F.lit(None).cast("string")})
    assert rows([("{COUNTRY} {YEAR}{UNIT_HINT}, {COUNTRY}",)], "t string", out) == ["Fiji 2020, Fiji"]


def test_full_normal_forms(rows):
    from econcheck.functions.text import name_key
    from econcheck.functions.units import declared_unit

    got = rows([("Việt Nam",), ("CÔTE d’Ivoire",), ("Ǻland",), ("São Tomé",)], "s string", name_key(F.col("s")))
    assert got == ["viet nam", "cote d ivoire", "aland", "sao tome"]
    got = rows([("ＵＳＤ ｍｉｌｌｉｏｎｓ",), ("US$ bn",), ("US dollars/year",)], "s string", declared_unit(F.col("s"), F.lit("level")))
    assert [(r.ok, r.factor) for r in got] == [(True, 1e6), (True, 1e9), (True, 1.0)]
