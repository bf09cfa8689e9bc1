import hashlib
import random

import pytest
from pyspark.sql import functions as F

from econcheck.operators import answers as N
from econcheck.operators import draw as D
from econcheck.operators import score as S
from econcheck.operators import truth as G
from econcheck.plans.quantiles import index_quantiles
from econcheck.sources import artefacts as A


def test_strict_parse_and_repair(spark):
    good = '[{"qid":"q1","value":1}]'
    data = [("m", "b1", "﻿ " + good + "\n", None), ("m", "b2", "```json\n" + good + "\n```", good), ("m", "b3", '{"qid":1}', None), ("m", "b4", "[1,", "nope"), ("m", "b5", None, None), ("m", "b6", None, good)]
    df = spark.createDataFrame(data, "model string, batch_id string, original string, repair string")
    got = {r.batch_id: (r.outcome, r.repaired) for r in N.parse_batches(df).collect()}
    assert got == {"b1": ("parsed", False), "b2": ("parsed", True), "b3": ("format_failure_batch", False), "b4": ("format_failure_batch", False), "b5": ("missing_raw", False), "b6": ("parsed", True)}


def test_alignment_and_types(spark):
    body = (
        '[{"qid":" q1 ","value":3.5,"unit":"%","year_basis":2020,"confidence":0.9,"refused":false,"basis_note":"' + "x" * 200 + '"},'
        '{"qid":"q1","value":9},{"qid":"zz","value":1},"text",{"qid":"q2","value":"3.5","unit":5,"year_basis":2020.5,"confidence":1.5,"refused":"no"},{"qid":"q3","value":null,"refused":true},{"value":1}]'
    )
    expected = spark.createDataFrame([(m, "batch-01", q) for m in ("m", "n", "silent") for q in ("q1", "q2", "q3", "q4")], "model string, batch_id string, qid string")
    files = spark.createDataFrame([("m", "batch-01", body, None), ("n", "batch-02", "[]", None)], "model string, batch_id string, original string, repair string")
    answers, extra = N.align(expected, files)
    got = {(r.model, r.qid): r for r in answers.collect()}
    a = got[("m", "q1")]
    assert (a.value, a.unit, a.year_basis, a.confidence, a.refused, len(a.basis_note), a.parse_flags) == (3.5, "%", 2020, 0.9, False, 200, [])
    b = got[("m", "q2")]
    assert b.value is None and b.parse_flags == ["value_not_number", "unit_not_string", "year_basis_not_integer", "confidence_invalid", "refused_not_boolean"]
    assert got[("m", "q3")].refused and got[("m", "q3")].parse_flags == []
    assert got[("m", "q4")].failure_reason == "qid_missing_from_output" and got[("n", "q1")].failure_reason == "missing_raw"
    assert not any(m == "silent" for m, _ in got)
    assert sorted((r.pos, r.qid) for r in extra.collect()) == [(2, "zz"), (3, None), (6, None)]
    s = {r.model: r for r in N.batch_statistics(expected, files).collect()}
    assert (s["m"].n_items, s["m"].n_aligned, s["m"].n_extraneous, s["m"].n_duplicates) == (7, 3, 3, 1) and "silent" not in s


def test_fence_stripping(spark):
    texts = ["```json\n[1]\n```", "```\n[1]", "  ```x\n[1]\n ``` ", "[1]\n```", "```"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(N.strip_fences(F.col("t"))).collect()]
    assert [g.strip() for g in got] == ["[1]", "[1]", "[1]", "[1]\n```", ""]


@pytest.fixture(scope="module")
def scored(spark):
    truth = spark.createDataFrame(
        [
            ("h1", "headline", "percent", "A", 2020, 5.0, False, 4.0, 5.05, "USA", True), ("h2", "headline", "level", "C", 2020, 1000.0, False, 1200.0, 800.0, "BRB", False),
            ("h3", "headline", "level", "C", 2020, 100.0, False, None, 120.0, "FJI", None), ("r1", "recency", "percent", "C", 2024, None, False, None, None, "USA", None),
            ("n1", "null_probe", "percent", "A", 2020, None, False, None, None, "USA", None),
        ],
        "qid string, segment string, kind string, revision_class string, year int, value double, is_projection boolean, prev_value double, next_value double, iso3 string, core boolean",
    )
    rev = spark.createDataFrame([("h3", "ok", 121.0, None), ("r1", "ok", None, {2024: (3.0, True)})], "qid string, status string, vintage_value double, vintage_projections map<int,struct<value:double,is_projection:boolean>>")
    ans = [
        ("m", "h1", 5.02, "%", 0.9, False, False), ("m", "h2", 1.0, "usd", 0.8, False, False), ("m", "h3", 120.0, "usd", 0.7, False, False), ("m", "r1", 3.1, "percent", 0.5, False, False), ("m", "n1", 1.0, "%", 0.4, False, False),
        ("n", "h1", 5.02, "widgets", 0.9, False, False), ("n", "h2", 1.02, "usd thousands", 0.6, False, False), ("n", "h3", None, None, 0.1, True, False), ("n", "r1", None, "percent", None, False, False), ("n", "n1", None, None, None, None, True),
    ]
    answers = spark.createDataFrame([(*a, None) for a in ans], "model string, qid string, value double, unit string, confidence double, refused boolean, format_failure boolean, failure_reason string")
    return S.score_answers(answers, truth, rev).cache()


def test_statuses_and_labels(scored):
    r = {(x.model, x.qid): x for x in scored.collect()}
    assert {k: v.status for k, v in r.items()} == {
        ("m", "h1"): "match", ("m", "h2"): "mismatch", ("m", "h3"): "mismatch", ("m", "r1"): "uncorroborated_answer", ("m", "n1"): "fabricated",
        ("n", "h1"): "answer_failure", ("n", "h2"): "close", ("n", "h3"): "refusal", ("n", "r1"): "answer_failure", ("n", "n1"): "format_failure",
    }
    assert r[("m", "h2")].diagnostics == ["scale_slip:1/1000"] and r[("m", "h2")].vintage_status == "not_targeted"
    assert r[("m", "h3")].diagnostics == ["adjacent_year:next:2021"] and r[("m", "h3")].revision_affected
    assert r[("m", "r1")].projection_echo and r[("n", "h1")].failure_reason == "unit:kind_mismatch_expected_percent"
    assert r[("n", "h2")].normalized_value == 1020.0 and r[("m", "h2")].signed_rel_error == pytest.approx(-0.999)


def test_rates(scored):
    h = {r.model: r for r in S.headline_rates(scored).collect()}
    assert (h["m"].wtr_k, h["m"].wtr_rate, h["m"].cr_rate, h["m"].answer_rate) == (1, 0.3333, 0.6667, 1.0)
    assert (h["n"].scoreable, h["n"].attempted, h["n"].refusals, h["n"].answer_failures, h["n"].answer_rate) == (3, 1, 1, 1, 0.3333)
    grid = {r.model: (r.branch, r.valid) for r in S.interpretation_grid(S.headline_rates(scored)).collect()}
    assert grid == {"m": ("C", True), "n": ("C", False)}
    y = {r.model: (r.n_yd, r.wtr_yd_k) for r in S.year_discrimination(scored).collect()}
    assert y == {"m": (2, 0), "n": (2, 1)}  # h1's next year is within tolerance of it
    f = {r.model: (r.scoreable, r.fabrication_k) for r in S.fabrication(scored).collect()}
    assert f == {"m": (1, 1), "n": (0, 0)}
    c = {r.model: r for r in S.calibration(scored).collect()}
    assert c["m"].mean_confidence_within == 0.9 and c["m"].mean_confidence_mismatch == 0.75 and c["n"].mean_confidence_refused == 0.1


def test_weights_fall_back_to_the_mean(spark, scored):
    w = spark.createDataFrame([("USA", 10.0, None), ("BRB", 30.0, None), ("FJI", None, None)], "iso3 string, gdp double, population double")
    r = {x.model: x for x in S.reweighted(scored, w).collect()}
    assert r["m"].wtr_gdp_weighted == round(10 / 60, 4) and r["n"].wtr_gdp_weighted == 0.5 and r["m"].wtr_population_weighted is None


def test_pairs_mcnemar_holm(spark):
    rng = random.Random(5)
    models = ["a", "b", "c"]
    data = [(m, f"q{i}", "headline", "match" if rng.random() < p else "mismatch") for m, p in zip(models, (0.9, 0.6, 0.5)) for i in range(60) if rng.random() < 0.95]
    df = spark.createDataFrame(data, "model string, qid string, segment string, status string")
    win = {(m, q): s == "match" for m, q, _, s in data}
    want = {}
    for i, x in enumerate(models):
        for y in models[i + 1:]:
            both = [q for (m, q) in win if m == x and (y, q) in win]
            want[(x, y)] = (len(both), sum(win[(x, q)] and not win[(y, q)] for q in both), sum(win[(y, q)] and not win[(x, q)] for q in both))
    tests = S.with_mcnemar(S.pairwise(df, models))
    got = {(r.model_a, r.model_b): (r.common_scoreable, r.a_only_within, r.b_only_within) for r in tests.collect()}
    assert got == want
    rows = S.holm(tests).orderBy("p").collect()
    run, adjusted = 0.0, []
    for i, r in enumerate(rows):
        run = max(run, min(1.0, (3 - i) * r.p))
        adjusted.append(run)
    assert [r.p_holm for r in rows] == pytest.approx(adjusted)


def test_index_quantiles_equal_a_sorted_list(spark):
    rng = random.Random(11)
    data = [("hot" if i % 3 else "g%d" % (i % 7), round(rng.gauss(0, 1) * 10 ** rng.randint(-6, 5), 6)) for i in range(4000)] + [("one", -0.5)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    by = {}
    for g, v in data:
        by.setdefault(g, []).append(v)
    want = {(g, p): sorted(v)[min(len(v) - 1, int(p * len(v)))] for g, v in by.items() for p in probs}
    assert {(r.g, r.p): r.value for r in index_quantiles(df, ["g"], "v", probs).collect()} == want


def test_truth_audit_and_drift(spark):
    snap = spark.createDataFrame([("a", 1.0, "s"), ("b", None, "s"), ("c", 2.0, "s"), ("d", 3.0, None), ("e", 1.0, "s")], "qid string, value double, series_id string")
    prim = spark.createDataFrame([("a", 1.0 + 1e-12, None), ("b", None, None), ("c", 2.1, None), ("d", None, None), ("e", None, "http_500")], "qid string, primary_value double, read_error string")
    got = {r.qid: (r.status, r.divergent) for r in G.audit(snap, prim).collect()}
    assert got == {"a": ("ok", False), "b": ("ok", False), "c": ("DIVERGENT", True), "d": ("no_series_in_snapshot", True), "e": ("primary_fetch_error:http_500", True)}


def test_vintage_preference(spark):
    eds = spark.createDataFrame([(f"{y}-{m}",) for y in range(2020, 2027) for m in ("04", "10")], "edition string")
    c = G.vintage_candidates(eds, "2026-07-26", "2026-04")
    first = [r.edition for r in c.orderBy("preference").collect()]
    assert first[0] == "2024-10" and "2026-04" not in first and "2020-10" not in first
    present = spark.createDataFrame([("2025-04",), ("2023-04",)], "edition string")
    assert G.pick_vintage(c, present).first().edition == "2025-04"


def test_batch_position_reaches_the_strata(spark):
    """An answer keeps the place its question had in the batch, also when it is missing from the output."""
    expected = spark.createDataFrame([("m", "b", "q1", 3), ("m", "b", "q2", 1), ("m", "b", "q3", 2)], "model string, batch_id string, qid string, position int")
    files = spark.createDataFrame([("m", "b", '[{"qid":"q3","value":1},{"qid":"q1","value":2}]', None)], "model string, batch_id string, original string, repair string")
    answers, _ = N.align(expected, files)
    assert {r.qid: (r.batch_position, r.format_failure) for r in answers.collect()} == {"q1": (3, False), "q2": (1, True), "q3": (2, False)}
    assert {r.batch_position for r in N.align(expected.drop("position"), files)[0].collect()} == {None}
    scored = spark.createDataFrame([("m", "match", "headline", 1), ("m", "mismatch", "headline", 1), ("m", "close", "headline", 2), ("m", "match", "headline", None)], "model string, status string, segment string, batch_position int")
    got = {r.stratum_value: (r.n, r.within) for r in S.strata(scored, ["batch_position"]).collect()}
    assert got == {"1": (2, 1), "2": (1, 1)}


def test_unit_is_tokenised_once(spark):
    from econcheck.functions.units import declared_unit

    plan = spark.range(1).select(F.col("id").cast("string").alias("u")).select(declared_unit(F.col("u"), F.lit("level")).alias("d"))
    assert plan._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1


def test_batches_are_not_dealt_out_by_model(spark):
    """The roster has a handful of names: an exchange on the model alone leaves that many tasks with rows."""
    import re

    from econcheck.operators import answers as N
    from econcheck.operators import draw as D

    batches = spark.range(40).select(F.concat(F.lit("batch-"), (F.col("id") % 5).cast("string")).alias("batch_id"), F.concat(F.lit("Q"), F.col("id").cast("string")).alias("qid"))
    expected = D.order_for_models(batches, ["a", "b", "c"], "s")
    files = expected.filter("model <> 'c'").groupBy("model", "batch_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.collect_list("qid"), lambda q: F.concat(F.lit('{"qid":"'), q, F.lit('","value":1}'))), ","), F.lit("]")).alias("original")
    ).withColumn("repair", F.lit(None).cast("string"))
    answers, extra = N.align(expected, files)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(model#\d+, \d+\)", plan)
    got = {(r.model, r.qid) for r in answers.filter("value = 1 AND NOT format_failure").collect()}
    assert got == {(m, f"Q{i}") for m in "ab" for i in range(40)} and answers.count() == 80 and extra.count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_travel_as_rows(spark):
    """A batch with its questions in one row aligns as its single questions do; nobody pays for an order that is not looked at."""
    batches = spark.createDataFrame([(f"batch-{b}", f"q{b}-{i}") for b in range(1, 4) for i in range(5)] + [("batch-1", "q1-0"), ("batch-3", None)], "batch_id string, qid string")
    body = '[{"qid":" q1-0 ","value":1,"refused":false},{"qid":"zz"},{"qid":"q1-0","value":9}]'
    files = spark.createDataFrame([("m", "batch-1", body, None), ("m", "batch-2", "no json", None), ("n", "batch-9", None, None)], "model string, batch_id string, original string, repair string")
    models = ["m", "n", "silent"]
    rows, held = D.order_for_models(batches, models, "s"), D.ordered_batches(batches, models, "s")
    assert rows.columns == ["batch_id", "qid", "model", "position"]
    order = {}
    for r in rows.collect():
        order.setdefault((r.model, r.batch_id), []).append((r.position, r.qid))
    for (model, batch), got in order.items():
        key = lambda q: hashlib.sha256(":".join(["s", f"{model}:{batch}", q or ""]).encode()).hexdigest()
        asked = [r.qid for r in batches.where(F.col("batch_id") == batch).collect()]
        assert sorted(got) == list(enumerate(sorted(asked, key=key), 1))
    one, many = N.align(held, files), N.align(rows, files)
    text = lambda df: sorted(str(r) for r in df.drop("item").collect())
    assert text(one[0]) == text(many[0]) and len(text(one[0])) == 2 * 17 and text(one[1]) == text(many[1])
    assert text(N.batch_statistics(held, files)) == text(N.batch_statistics(rows, files))
    assert "sha2" not in _plan(one[0].select("model", "qid", "value")) and "sha2" in _plan(one[0].select("batch_position"))


def test_roster_shares_the_shuffle_of_the_files(spark):
    """Files are grouped once for the join and for the list of called models, and are sorted once."""
    raw = spark.range(40).select(F.concat(F.lit("raw/m"), F.col("id") % 2, F.lit("/batch-"), F.col("id"), F.lit(".txt")).alias("path"), F.lit("[]").alias("body"))
    raw = raw.unionByName(spark.createDataFrame([(None, "[]"), ("raw/x.txt", "[]")], "path string, body string"))
    expected = spark.range(41).select(F.explode(F.array(F.lit("m0"), F.lit("m1"), F.lit("m2"))).alias("model"), F.concat(F.lit("batch-"), "id").alias("batch_id"), F.lit("q").alias("qid"))
    answers, _ = N.align(expected, A.answer_files(raw))
    assert answers.count() == 82
    answers.write.format("noop").mode("overwrite").save()
    answers = answers.select("model", "qid", "format_failure")
    answers.collect()
    assert "ReusedExchange" in answers._jdf.queryExecution().executedPlan().toString()


def test_unit_rules_in_order(spark):
    from econcheck.functions.units import declared_unit

    cases = {
        ("%", "percent"): (True, 1.0, None), ("bps", "percent"): (True, 0.01, None), ("ratio", "percent"): (True, 100.0, None), ("ratio of gdp in %", "percent"): (False, None, "ambiguous_percent_and_ratio"),
        ("usd", "percent"): (False, None, "kind_mismatch_expected_percent"), ("% eur", "level"): (False, None, "kind_mismatch_expected_level"), ("US$ thousand million", "level"): (True, 1e9, None),
        ("widgets eur", "level"): (False, None, "unknown_token:widgets"), ("usd eur", "level"): (False, None, "rejected_token:eur"), ("...", None): (False, None, "unit_empty_after_cleaning"),
        (" ", "level"): (False, None, "unit_missing_or_not_string"), (None, "percent"): (False, None, "unit_missing_or_not_string"), ("share", None): (False, None, "kind_mismatch_expected_level"),
    }
    df = spark.createDataFrame(list(cases), "u string, k string").select("u", "k", declared_unit(F.col("u"), F.col("k")).alias("d"))
    assert {(r.u, r.k): tuple(r.d) for r in df.collect()} == cases


def test_neighbouring_years(spark, tmp_path):
    from econcheck.queries import score as Q
    from econcheck.queries.inputs import Tables

    data = [(1, 1, 10.0, "2000-01-05"), (2, 1, 20.0, "2001-01-05"), (3, 1, 40.0, "2003-01-05"), (4, 1, 5.0, None), (5, None, 7.0, "2000-01-05"), (6, 2, None, "1999-01-05"), (7, 2, 8.0, "2000-01-05")]
    rows = spark.createDataFrame(data, "o_orderkey long, o_custkey long, o_totalprice double, d string")
    rows.select("o_orderkey", "o_custkey", "o_totalprice", F.to_timestamp("d").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    q = Q.questions(Tables(spark, str(tmp_path)))
    got = {(r.custkey, r.year): (r.base, r.prev_value, r.next_value) for r in q.collect()}
    assert got == {(1, 2000): (10.0, None, 20.0), (1, 2001): (20.0, 10.0, None), (1, 2003): (40.0, None, None), (1, None): (5.0, 5.0, 5.0), (None, 2000): (7.0, None, None), (2, 2000): (8.0, None, None)}
