import datetime as dt
import json

from econcheck.sources import artefacts as A
from econcheck.sources import landed as L


def raw(spark, bodies, extra="", values=()):
    data = [(f"f{i}", b if isinstance(b, str) else json.dumps(b), *(values[i] if values else ())) for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, "path string, body string" + extra)


def wb(ind, iso3, date, value):
    return {"indicator": {"id": ind, "value": "Name"}, "country": {"id": iso3[:2], "value": "Country"}, "countryiso3code": iso3, "date": date, "value": value, "unit": "", "decimal": 1}


def test_wdi_envelopes(spark):
    good = [{"page": 1, "lastupdated": "2026-07-01"}, [wb("A", "USA", "2023", 1.5), wb("B", "USA", "2022", None), {**wb("A", "GBR", "2021", 2), "countryiso3code": ""}]]
    obs, bad = L.wdi_observations(raw(spark, [good, [{"message": [{"id": "120", "key": "Invalid value", "value": "no such"}]}], "<xml/>", {"a": 1}]))
    got = {(r.code, r.iso3, r.period): (r.value, r.series_id, r.last_updated) for r in obs.collect()}
    assert got == {
        ("A", "USA", "2023"): (1.5, "worldbank/A", "2026-07-01"), ("B", "USA", "2022"): (None, "worldbank/B", "2026-07-01"), ("A", "GB", "2021"): (2.0, "worldbank/A", "2026-07-01"),
    }
    assert {r.path: r.fault for r in bad.collect()} == {"f1": "Invalid value: no such", "f2": "unexpected_payload", "f3": "unexpected_payload"}


def test_imf_values_gate_and_aliases(spark):
    full = {f"C{i:02d}": {"2024": i} for i in range(150)}
    full.update({"WBG": {"2024": 1.5, "2025": "n/a", "2026": None, "2027": "7"}, "": {"2050": 1}})
    obs, bad = L.imf_values(raw(spark, [{"values": {"X": full}}, {"values": {"Y": {"USA": {"2024": 1}}}}, {"countries": {}}]))
    got = {(r.iso3, r.period): r.value for r in obs.filter("iso3 = 'PSE'").collect()}
    assert got == {("PSE", "2024"): 1.5, ("PSE", "2025"): None, ("PSE", "2026"): None, ("PSE", "2027"): None}
    assert obs.filter("period = '2050'").count() == 0
    assert sorted((r.path, r.fault) for r in bad.collect()) == [("f1", "truncated_payload"), ("f2", "unexpected_payload")]


def test_imf_editions(spark):
    table = {f"I{i}": {"label": "x", "source": "World Economic Outlook (April 2026)", "dataset": "WEO", "last-modified": "2026-04-08 16:07:34"} for i in range(51)}
    table["I0"]["source"] = "Weird (Notamonth 2026)"
    rows = {r.code: r for r in L.imf_editions(raw(spark, [{"indicators": table}, {"indicators": {"Z": table["I1"]}}]))[0].collect()}
    assert len(rows) == 51 and (rows["I1"].edition_year, rows["I1"].edition_month) == (2026, 4)
    assert rows["I0"].edition_year is None and rows["I0"].edition_label == "Weird (Notamonth 2026)"


def doc(code, periods, values):
    return {"@frequency": "annual", "dataset_code": "WEO:2018-10", "dataset_name": "WEO", "provider_code": "IMF", "series_code": code, "series_name": "n", "period": periods, "value": values}


def test_dbnomics_choice_and_values(spark):
    docs = {"provider": {"code": "IMF", "name": "IMF"}, "series": {"docs": [doc("USA.X.long", ["2017"], [1]), doc("USA.X", ["2017", "2018", "2019", "2020"], [2.5, "NA", " ", "3.5"]), doc("USA.Y", ["2017"], [9])]}}
    obs, bad = L.dbnomics_observations(raw(spark, [docs] * 4 + [{"series": {"docs": []}}], ", wanted_code string", [("USA.X",), ("USA.",), ("ZZ",), ("USA.X.l",), ("q",)]))
    got = {}
    for r in obs.collect():
        got.setdefault(r.series_code, []).append((r.pos, r.period, r.value))
    assert sorted(set(got["USA.X"])) == [(0, "2017", 2.5), (1, "2018", None), (2, "2019", None), (3, "2020", 3.5)] and len(got["USA.X"]) == 8
    assert got["USA.X.long"] == [(0, "2017", 1.0)] * 2 and "USA.Y" not in got
    assert obs.first().series_id.startswith("dbnomics/IMF/WEO:2018-10/USA.X") and [tuple(r) for r in bad.collect()] == [("f4", "no_series")]


def test_sdmx_both_generations(spark):
    structure = {"name": "flow", "dimensions": {"observation": [{"values": [{"id": "2025-12"}, {"id": "2025-11"}, {"id": "2026-01"}]}]}}
    bis = {"data": {"dataSets": [{"series": {"0:0": {"observations": {"0": ["3.625"], "2": ["NaN"], "9": ["1"]}}}}], "structure": structure}}
    ecb = {"dataSets": [{"series": {"0:0:0:0:0:0": {"observations": {"1": [2.25, 0], "0": [2.5]}}}}], "structure": structure}
    rows, bad = L.sdmx_observations(raw(spark, [bis, ecb, "<xml/>"], ", series_key string", [("M.US",), ("HICP",), ("x",)]))
    assert [tuple(r) for r in bad.collect()] == [("f2", "unexpected_payload")]
    rows = rows.collect()
    assert sorted((r.series_key, r.period, r.value) for r in rows if r.value is not None) == [("HICP", "2025-11", 2.25), ("HICP", "2025-12", 2.5), ("M.US", "2025-12", 3.625)]
    assert [(r.series_key, r.period) for r in rows if r.value is None] == [("M.US", "2026-01")]


def test_daily_rates(spark):
    rows = L.daily_rates(raw(spark, [{"amount": 1, "base": "EUR", "date": "2024-01-02", "rates": {"USD": 1.1}}, {"base": "EUR", "rates": {"2024-01-03": {"USD": 1.2, "GBP": 0.9}}}]))[0].collect()
    assert sorted((r.base, r.quote, r.day, r.rate) for r in rows) == [("EUR", "GBP", dt.date(2024, 1, 3), 0.9), ("EUR", "USD", dt.date(2024, 1, 2), 1.1), ("EUR", "USD", dt.date(2024, 1, 3), 1.2)]


def test_economy_listing(spark):
    listing = [{"page": 1}, [{"id": "ABW", "iso2Code": "AW", "name": "Aruba", "region": {"id": "LCN", "value": "x"}}, {"id": "WLD", "iso2Code": "1W", "name": "World", "region": {"id": "NA", "value": "Aggregates"}}]]
    assert [(r.iso3, r.aggregate) for r in L.economies_from_listing(raw(spark, [listing])).orderBy("ordinal").collect()] == [("ABW", False), ("WLD", True)]


def test_edition_archive_prunes_to_one_partition(spark, tmp_path):
    path = str(tmp_path / "archive")
    spark.createDataFrame([("2018-10", "USA", 1.0), ("2019-04", "USA", 2.0)], "edition string, iso3 string, value double").write.partitionBy("edition").parquet(path)
    one = L.read_editions(spark, path, "2018-10")
    assert [r.value for r in one.collect()] == [1.0] and L.read_editions(spark, path).count() == 2
    assert "PartitionFilters: [isnotnull(edition" in one._jdf.queryExecution().executedPlan().toString()


def test_raw_answer_files_and_manifest(spark, tmp_path):
    base = tmp_path / "runs" / "R1" / "raw"
    for model, name, text in [("m1", "batch-01.txt", "```json\n[]\n```"), ("m1", "batch-01.repair.txt", "[]"), ("m2", "batch-02.txt", "[1]"), ("m2", "notes.txt", "ignored")]:
        (base / model).mkdir(parents=True, exist_ok=True)
        (base / model / name).write_text(text)
    files = {(r.model, r.batch_id): (r.original, r.repair) for r in A.read_answer_files(spark, str(base)).collect()}
    assert files == {("m1", "batch-01"): ("```json\n[]\n```", "[]"), ("m2", "batch-02"): ("[1]", None)}
    built = A.build_manifest(A.read_binary_files(spark, str(base))).collect()
    assert len(built) == 4
    before = spark.createDataFrame(built, "name string, sha256 string")
    (base / "m2" / "batch-02.txt").write_text("[2]")
    (base / "m2" / "new.txt").write_text("x")
    after = A.build_manifest(A.read_binary_files(spark, str(base)))
    status = sorted(r.status for r in A.verify_manifest(before, after).collect())
    assert status == ["hash_mismatch", "not_in_manifest", "ok", "ok", "ok"]


def test_artefact_sink_keeps_other_runs(spark, tmp_path):
    path = str(tmp_path / "frame")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    A.write_artefact(df, path, "R1")
    A.write_artefact(df.filter("x = 2"), path, "R2")
    A.write_artefact(df.filter("x = 1"), path, "R2")
    assert A.read_artefact(spark, path, "R1").count() == 2 and [r.x for r in A.read_artefact(spark, path, "R2").collect()] == [1]


def test_payload_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"page":1},\n []]')
    assert L.read_payloads(spark, str(tmp_path)).first().body == '[{"page":1},\n []]'


def test_no_payload_vanishes(spark, tmp_path):
    """Every payload is a usable one or in quarantine, and one pass writes both and counts them."""
    bodies = ["<html>", "", None, "[]", "{}", '{"base":"EUR","date":"2024-01-02","rates":{}}', '{"base":"EUR","rates":{"2024-01-03":{"USD":1.2},"2024-01-04":{"USD":1.3}}}', '{"base":"EUR","date":"2024-01-02","rates":{"USD":1.1,"GBP":0.9}}']
    payloads = spark.createDataFrame([(f"f{i}", b, "K") for i, b in enumerate(bodies)], "path string, body string, series_key string")
    rows, bad, counts = L.land(payloads, L.daily_rates_marked, str(tmp_path / "rates"))
    assert counts == {"payloads": 8, "usable": 2, "quarantined": 6, "rows": 4} and rows.columns == ["base", "quote", "day", "rate"]
    assert sorted((str(r.day), r.quote, r.rate) for r in rows.collect()) == [("2024-01-02", "GBP", 0.9), ("2024-01-02", "USD", 1.1), ("2024-01-03", "USD", 1.2), ("2024-01-04", "USD", 1.3)]
    assert {r.path: r.fault for r in bad.collect()} == {**{f"f{i}": "unexpected_payload" for i in range(5)}, "f5": "no_rates"}
    for mark in (L.imf_editions_marked, L.dbnomics_marked, L.sdmx_marked):
        _, bad, counts = L.land(payloads, mark, str(tmp_path / mark.__name__))
        assert counts["payloads"] == counts["quarantined"] == bad.count() == 8 and counts["rows"] == 0


def test_only_asked_editions_are_read(spark, tmp_path):
    rows = [(f"{y}-04", "debt", "USA", str(y), float(y)) for y in range(2010, 2020)]
    spark.createDataFrame(rows, "edition string, indicator string, iso3 string, period string, value double").write.partitionBy("edition").parquet(str(tmp_path / "archive"))
    claims = spark.createDataFrame([(1, "2015-04"), (2, "2015-04"), (3, "2017-04"), (4, ""), (5, "1990-04")], "claim_id int, edition string")
    found = L.asked_editions(L.read_editions(spark, str(tmp_path / "archive")), claims)
    assert sorted(r.edition for r in found.collect()) == ["2015-04", "2017-04"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
