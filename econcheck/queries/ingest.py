"""Queries on landed payloads: the payload text is assembled from the tables, then ingested."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from econcheck.plans.durable import ensure_checkpoint_dir
from econcheck.sources import artefacts as A
from econcheck.sources import landed as L
from econcheck.queries.cte import sql
from econcheck.queries.inputs import Tables
from econcheck.queries.registry import query


def gap() -> F.Column:
    return (F.col("custkey") + F.col("year")) % 5 == 0



def _q(col) -> F.Column:
    return F.concat(F.lit('"'), col.cast("string"), F.lit('"'))


@query("s1_wdi_envelope", sql("""SELECT iso3, CAST(year AS VARCHAR) AS period, year, CASE WHEN (custkey + year) % 5 <> 0 THEN round(value, 4) END AS value, '2026-07-01' AS last_updated
      FROM customer_annual WHERE custkey % 6 <> 0"""))
def s1(t: Tables):
    obs, _ = L.wdi_observations(_wdi_payloads(t))
    return obs.select("iso3", "period", "year", F.round("value", 4).alias("value"), "last_updated")


@query("s1_wdi_quarantine", sql("SELECT DISTINCT iso3 AS path, 'Invalid value: no such country' AS fault FROM customer_annual WHERE custkey % 6 = 0"))
def s1_bad(t: Tables):
    _, bad = L.wdi_observations(_wdi_payloads(t))
    return bad


def _wdi_payloads(t: Tables):
    row = F.struct(
        F.struct(F.lit("X.TOT").alias("id"), F.lit("Total").alias("value")).alias("indicator"),
        F.struct(F.lit("C").alias("id"), F.col("iso3").alias("value")).alias("country"),
        F.col("iso3").alias("countryiso3code"), F.col("year").cast("string").alias("date"), F.when(~gap(), F.col("value")).alias("value"),
    )
    g = t.customer_annual().groupBy("custkey", "iso3").agg(F.to_json(F.collect_list(row)).alias("rows"))
    good = F.concat(F.lit('[{"page":1,"lastupdated":"2026-07-01"},'), "rows", F.lit("]"))
    bad = F.lit('[{"message":[{"id":"120","key":"Invalid value","value":"no such country"}]}]')
    return g.select(F.col("iso3").alias("path"), F.when(F.col("custkey") % 6 == 0, bad).otherwise(good).alias("body"))


_BUCKETS = """SELECT CAST(floor(custkey / 200) AS BIGINT) AS bucket, count(DISTINCT custkey) AS n FROM customer_annual GROUP BY 1"""


def _imf_payloads(t: Tables):
    v = F.when(gap(), F.lit('"n/a"')).otherwise(F.col("value").cast("string"))
    per = t.customer_annual().groupBy("custkey", "iso3").agg(
        F.concat(_q(F.col("iso3")), F.lit(":{"), F.array_join(F.collect_list(F.concat(_q(F.col("year")), F.lit(":"), v)), ","), F.lit("}")).alias("e")
    )
    bucket = F.floor(F.col("custkey") / 200).cast("long")
    g = per.groupBy(bucket.alias("bucket")).agg(F.array_join(F.collect_list("e"), ",").alias("body"))
    body = F.concat(F.lit('{"values":{"B'), F.col("bucket").cast("string"), F.lit('":{"":{"2001":1},'), "body", F.lit("}}}"))
    return g.select(F.col("bucket").cast("string").alias("path"), body.alias("body"))


@query(
    "s2_imf_values",
    sql("""SELECT 'B' || CAST(bucket AS VARCHAR) AS code, iso3, CAST(year AS VARCHAR) AS period, CASE WHEN (custkey + year) % 5 <> 0 THEN round(value, 4) END AS value
        FROM customer_annual JOIN buckets ON bucket = CAST(floor(custkey / 200) AS BIGINT) WHERE buckets.n >= 150""", buckets=_BUCKETS),
)
def s2(t: Tables):
    obs, _ = L.imf_values(_imf_payloads(t))
    return obs.select("code", "iso3", "period", F.round("value", 4).alias("value"))


@query("s2_imf_quarantine", sql("SELECT CAST(bucket AS VARCHAR) AS path, 'B' || CAST(bucket AS VARCHAR) AS code, 'truncated_payload' AS fault FROM buckets WHERE n < 150", buckets=_BUCKETS))
def s2_bad(t: Tables):
    return L.imf_values(_imf_payloads(t))[1]


_MONTHS = ["Notamonth", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _edition_payloads(t: Tables):
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), F.col("p_size") % 13 + 1)
    entry = F.struct(
        F.col("p_name").alias("label"), F.concat(F.lit("World Economic Outlook ("), month, F.lit(" "), (F.lit(2000) + F.col("p_size")).cast("string"), F.lit(")")).alias("source"),
        F.lit("WEO").alias("dataset"), F.lit("2026-04-08 16:07:34").alias("last-modified"),
    )
    per = t.part.select(
        F.floor(F.col("p_partkey") / 100).cast("long").alias("b"),
        F.concat(_q(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))), F.lit(":"), F.to_json(entry)).alias("e"),
    )
    payloads = per.groupBy("b").agg(F.concat(F.lit('{"indicators":{'), F.array_join(F.collect_list("e"), ","), F.lit("}}")).alias("body"))
    return payloads.select(F.col("b").cast("string").alias("path"), "body")


_TABLES = "(SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS b, count(*) AS n FROM part GROUP BY 1)"


@query("s3_imf_editions", sql(f"""SELECT 'P' || CAST(p_partkey AS VARCHAR) AS code, p_name AS label, CASE WHEN p_size % 13 <> 0 THEN CAST(2000 + p_size AS INTEGER) END AS edition_year,
            CASE WHEN p_size % 13 <> 0 THEN CAST(p_size % 13 AS INTEGER) END AS edition_month
        FROM part JOIN {_TABLES} ON b = CAST(floor(p_partkey / 100) AS BIGINT) WHERE n > 50"""))
def s3(t: Tables):
    return L.imf_editions(_edition_payloads(t))[0].select("code", "label", "edition_year", "edition_month")


def _spoilt(t: Tables, good, bodies: list[str], **more):
    """Payloads and, for every fifth customer, one that cannot be used."""
    k = F.col("c_custkey")
    body = F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.floor(k / 5) % len(bodies) + 1).cast("int"))
    bad = t.customer.where(k % 5 == 0).select(F.concat(F.lit("bad-"), k.cast("string")).alias("path"), body.alias("body"), *[c.alias(n) for n, c in more.items()])
    return good.unionByName(bad)


def _faults(*names: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"SELECT 'bad-' || CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey // 5 % {len(names)} {cases} END AS fault FROM customer WHERE c_custkey % 5 = 0"


@query("s3_imf_editions_quarantine", sql(f"{_faults('unexpected_payload', 'unexpected_payload', 'truncated_payload')} UNION ALL SELECT CAST(b AS VARCHAR), 'truncated_payload' FROM {_TABLES} WHERE n <= 50"))
def s3_bad(t: Tables):
    entry = '{"label":"x","source":"World Economic Outlook (April 2026)","dataset":"WEO","last-modified":"2026-04-08 16:07:34"}'
    return L.imf_editions(_spoilt(t, _edition_payloads(t), ["<html>", '{"indicators":[]}', '{"indicators":{"A":' + entry + "}}"]))[1]


@query(
    "s4_dbnomics_documents",
    sql("""SELECT iso3 || (CASE custkey % 3 WHEN 0 THEN '.order.AB' WHEN 1 THEN '.order.A' ELSE '.order.AB' END) AS series_code, CAST(year AS VARCHAR) AS period,
            CASE WHEN (custkey + year) % 5 <> 0 THEN round(value * (CASE custkey % 3 WHEN 1 THEN 1 ELSE 2 END), 4) END AS value FROM customer_annual"""),
)
def s4(t: Tables):
    return L.dbnomics_observations(_document_payloads(t))[0].select("series_code", "period", F.round("value", 4).alias("value"))


@query("s4_dbnomics_quarantine", sql(_faults("unexpected_payload", "no_series", "no_observations", "unexpected_payload")))
def s4_bad(t: Tables):
    bodies = ["not json", '{"series":{"docs":[]}}', '{"series":{"docs":[{"series_code":"A","period":[],"value":[]}]}}', '{"errors":["gone"]}']
    return L.dbnomics_observations(_spoilt(t, _document_payloads(t), bodies, wanted_code=F.lit("A")))[1]


def _document_payloads(t: Tables):
    periods = F.array_join(F.collect_list(_q(F.col("year"))), ",")

    def values(k):
        return F.array_join(F.collect_list(F.when(gap(), F.lit('"NA"')).otherwise((F.col("value") * k).cast("string"))), ",").alias(f"v{k}")

    g = t.customer_annual().groupBy("custkey", "iso3").agg(periods.alias("p"), values(1), values(2), values(3))

    def doc(suffix, k):
        return F.concat(
            F.lit('{"@frequency":"annual","dataset_code":"WEO:2018-10","dataset_name":"WEO","provider_code":"IMF","series_name":"s","series_code":"'),
            "iso3", F.lit(f'.order.{suffix}","period":['), "p", F.lit('],"value":['), f"v{k}", F.lit("]}"),
        )

    body = F.concat(F.lit('{"provider":{"code":"IMF","name":"IMF"},"series":{"docs":['), F.concat_ws(",", doc("AB", 2), doc("ABC", 3), doc("A", 1)), F.lit("]}}"))
    k = F.col("custkey") % 3
    wanted = F.when(k == 0, F.concat("iso3", F.lit(".order.AB"))).when(k == 1, F.concat("iso3", F.lit(".ord"))).otherwise(F.lit("something.else"))
    return g.select(F.col("iso3").alias("path"), body.alias("body"), wanted.alias("wanted_code"))


@query(
    "s5_sdmx_series",
    sql("SELECT iso3 AS series_key, CAST(year AS VARCHAR) AS period, CASE WHEN (custkey + year) % 5 <> 0 THEN round(value, 4) END AS value FROM customer_annual"),
)
def s5(t: Tables):
    return L.sdmx_observations(_sdmx_payloads(t))[0].select("series_key", "period", F.round("value", 4).alias("value"))


@query("s5_sdmx_quarantine", sql(_faults("unexpected_payload", "no_series", "no_observations")))
def s5_bad(t: Tables):
    empty = '{"dataSets":[{"series":{"0:0":{"observations":{"7":[1]}}}}],"structure":{"dimensions":{"observation":[{"values":[{"id":"2001"}]}]}}}'
    return L.sdmx_observations(_spoilt(t, _sdmx_payloads(t), ["<xml/>", '{"data":{"dataSets":[]}}', empty], series_key=F.lit("K")))[1]


def _sdmx_payloads(t: Tables):
    text = F.col("custkey") % 2 == 0
    v = F.when(gap(), F.lit('""')).when(text, _q(F.col("value"))).otherwise(F.col("value").cast("string"))
    index = (F.col("year") - 1995).cast("string")
    g = t.customer_annual().groupBy("custkey", "iso3").agg(F.array_join(F.collect_list(F.concat(_q(index), F.lit(":["), v, F.lit("]"))), ",").alias("o"))
    ids = ",".join(f'{{"id":"{y}"}}' for y in range(1995, 2002))
    inner = F.concat(
        F.lit('"dataSets":[{"series":{"0:0":{"observations":{"99":[1],'), "o",
        F.lit('}}}}],"structure":{"name":"flow","dimensions":{"observation":[{"values":[' + ids + "]}]}}"),
    )
    body = F.when(text, F.concat(F.lit('{"data":{'), inner, F.lit("}}"))).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
    return g.select(F.col("iso3").alias("path"), body.alias("body"), F.col("iso3").alias("series_key"))


@query("s6_daily_rates", sql("SELECT base, quote, CAST(day AS VARCHAR) AS day, round(rate, 6) AS rate FROM daily_quotes"))
def s6(t: Tables):
    return _rates(L.daily_rates(_rate_payloads(t))[0])


@query("s6_daily_rates_quarantine", sql(_faults("unexpected_payload", "no_rates", "no_rates")))
def s6_bad(t: Tables):
    return L.daily_rates(_spoilt(t, _rate_payloads(t), ['{"message":"not found"}', '{"base":"EUR","date":"2001-01-01","rates":{}}', '{"base":"EUR","rates":{}}']))[1]


@query("s6_landed_in_one_pass", sql("SELECT base, quote, CAST(day AS VARCHAR) AS day, round(rate, 6) AS rate, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS quarantined FROM daily_quotes"))
def s6_landed(t: Tables):
    payloads = _spoilt(t, _rate_payloads(t), ['{"message":"not found"}', '{"base":"EUR","rates":{}}'])
    rows, bad, counts = L.land(payloads, L.daily_rates_marked, _shared_folder(t, "rates"))
    if counts["payloads"] != counts["usable"] + counts["quarantined"] or counts["quarantined"] != bad.count():
        raise ValueError(f"payloads do not add up: {counts}")
    return _rates(rows).withColumn("quarantined", F.lit(counts["quarantined"]).cast("long"))


def _rates(rows):
    return rows.select("base", "quote", F.col("day").cast("string").alias("day"), F.round("rate", 6).alias("rate"))


def _rate_payloads(t: Tables):
    q = t.daily_quotes().withColumn("e", F.concat(_q(F.col("quote")), F.lit(":"), F.col("rate").cast("string")))
    per_day = q.groupBy("day").agg(F.array_join(F.collect_list("e"), ",").alias("r"))
    alone = F.dayofmonth("day") % 3 == 0
    single = per_day.filter(alone).select(
        F.concat(F.lit('{"amount":1.0,"base":"EUR","date":"'), F.col("day").cast("string"), F.lit('","rates":{'), "r", F.lit("}}")).alias("body")
    )
    many = per_day.filter(~alone).groupBy(F.weekofyear("day").alias("w")).agg(
        F.array_join(F.collect_list(F.concat(_q(F.col("day")), F.lit(":{"), "r", F.lit("}"))), ",").alias("r")
    ).select(F.concat(F.lit('{"amount":1.0,"base":"EUR","start_date":"x","rates":{'), "r", F.lit("}}")).alias("body"))
    return single.unionByName(many).select(F.sha1("body").alias("path"), "body")


def _shared_folder(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s7_edition_archive", sql("SELECT indicator, iso3, period, round(value, 4) AS value FROM editions WHERE edition = '2000-04'"))
def s7(t: Tables):
    path = _shared_folder(t, "editions")
    t.editions().repartition("edition").write.partitionBy("edition").parquet(path)
    return L.read_editions(t.spark, path, "2000-04").select("indicator", "iso3", "period", F.round("value", 4).alias("value"))


@query("s10_artefact_sink", sql("SELECT run, iso3, year, round(CASE run WHEN 'R1' THEN value / 2 ELSE value END, 4) AS value FROM customer_annual CROSS JOIN (VALUES ('R1'), ('R2')) r(run)"))
def s10(t: Tables):
    path = _shared_folder(t, "artefacts")
    frozen = t.customer_annual().select("iso3", "year", "value")
    A.write_artefact(frozen.withColumn("value", F.col("value") / 2), path, "R1")
    A.write_artefact(frozen.limit(0), path, "R2")
    A.write_artefact(frozen, path, "R2")  # replaces that run alone
    runs = [A.read_artefact(t.spark, path, run).select(F.lit(run).alias("run"), "iso3", "year", F.round("value", 4).alias("value")) for run in ("R1", "R2")]
    return runs[0].unionByName(runs[1])


@query(
    "s11_manifest_verify",
    sql("""SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status,
            CASE WHEN doc_id % 11 <> 0 THEN sha256(text || (CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END)) END AS actual FROM documents
        UNION ALL SELECT 'extra-' || CAST(doc_id AS VARCHAR), 'not_in_manifest', sha256(text) FROM documents WHERE doc_id % 11 = 0"""),
)
def s11(t: Tables):
    name, k = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("doc_id")
    manifest = A.build_manifest(t.documents.select(name.alias("name"), F.col("text").cast("binary").alias("content")))
    changed = F.concat("text", F.when(k % 7 == 0, F.lit("!")).otherwise(F.lit("")))
    kept = t.documents.filter(k % 11 != 0).select(name.alias("name"), changed.cast("binary").alias("content"))
    added = t.documents.filter(k % 11 == 0).select(F.concat(F.lit("extra-"), k.cast("string")).alias("name"), F.col("text").cast("binary").alias("content"))
    return A.verify_manifest(manifest, A.build_manifest(kept.unionByName(added))).select("name", "status", "actual")
