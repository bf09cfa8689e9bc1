"""Landed publisher payloads to the long observations table.

Every reader takes ``raw(path, body)`` - one payload per row, as ``read_payloads``
returns - and gives rows plus a quarantine table (path, fault), so that no payload
vanishes.  Nothing is fetched: a payload is a file somebody has already saved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from econcheck.functions import periods as P

# Payload gates and economy codes the IMF spells its own way.
MIN_ECONOMIES = 150
MIN_METADATA_ENTRIES = 50
IMF_CODES = {"WBG": "PSE", "UVK": "XKX"}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (recursive)."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def split(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of rows that carry ``path`` and ``fault``; a bad payload is one row with a fault."""
    rows = marked.where(F.col("fault").isNull()).drop("path", "fault", "leads")
    return rows, marked.where(F.col("fault").isNotNull()).select("path", "fault")


def land(raw: DataFrame, mark: Callable[[DataFrame], DataFrame], folder: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Ingest in one pass: payloads are parsed once, rows and quarantine written side by side, counts observed on the way.

    ``mark`` is one of the ``*_marked`` readers.  Returns the written rows, the written
    quarantine and counts with payloads = usable + quarantined.
    """
    seen = Observation()
    bad = F.col("fault").isNotNull()
    usable = F.count_if(F.col("leads") & ~bad)
    marked = mark(raw).observe(seen, F.count_if(F.col("leads")).alias("payloads"), usable.alias("usable"), F.count_if(bad).alias("quarantined"), F.count_if(~bad).alias("rows"))
    marked.withColumn("quarantined", bad).write.partitionBy("quarantined").parquet(folder)
    written = raw.sparkSession.read.schema(f"{marked._jdf.schema().toDDL()}, quarantined boolean").parquet(folder)
    rows, _ = split(written.where("not quarantined").drop("quarantined"))
    return rows, written.where("quarantined").select("path", "fault"), seen.get


def _path(raw: DataFrame) -> Column:
    return F.col("path") if "path" in raw.columns else F.lit(None).cast("string").alias("path")


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def wdi_observations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``[meta, rows]`` envelopes; an envelope with ``message`` is an error and goes to quarantine."""
    v = raw.withColumn("_v", F.try_parse_json("body"))
    is_array = F.coalesce(F.schema_of_variant("_v").startswith("ARRAY"), F.lit(False))
    message = F.try_variant_get("_v", "$[0].message", "array<struct<key:string,value:string>>")
    v = v.withColumn("_fault", F.when(~is_array, F.lit("unexpected_payload")).when(
        message.isNotNull(), F.array_join(F.transform(message, lambda m: F.concat_ws(": ", m["key"], m["value"])), "; ")
    ))
    row = "struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,countryiso3code:string,date:string,value:double>"
    rows = v.filter(F.col("_fault").isNull()).select(
        "path", F.try_variant_get("_v", "$[0].lastupdated", "string").alias("last_updated"),
        F.explode(F.try_variant_get("_v", "$[1]", f"array<{row}>")).alias("r"),
    )
    obs = rows.select(
        F.lit("wdi").alias("source"), F.concat(F.lit("worldbank/"), F.col("r.indicator.id")).alias("series_id"),
        F.col("r.indicator.id").alias("code"), F.col("r.indicator.value").alias("series_name"),
        F.coalesce(F.nullif("r.countryiso3code", F.lit("")), F.upper("r.country.id")).alias("iso3"),
        F.col("r.country.value").alias("country_name"), F.col("r.date").alias("period"), P.period_year(F.col("r.date")).alias("year"),
        F.col("r.value").alias("value"), "last_updated",
    )
    return obs, v.filter(F.col("_fault").isNotNull()).select("path", F.col("_fault").alias("fault"))


def imf_values(raw: DataFrame, min_economies: int = MIN_ECONOMIES) -> tuple[DataFrame, DataFrame]:
    """``values[code][economy][year]`` payloads.

    Only JSON numbers are values.  A payload with too few economies is truncated,
    not a statement about the missing ones: it is quarantined whole.
    """
    codes = F.from_json("body", "values map<string,map<string,map<string,variant>>>")["values"]
    per_code = raw.withColumn("_c", codes)
    exploded = per_code.filter(F.col("_c").isNotNull()).select("path", F.explode("_c").alias("code", "economies"))
    named = F.map_filter("economies", lambda k, _: k != "")
    exploded = exploded.withColumn("economies", named).withColumn("n_economies", F.size("economies"))
    good = exploded.filter(F.col("n_economies") >= min_economies)
    alias = F.create_map(*[F.lit(x) for kv in IMF_CODES.items() for x in kv])
    by_year = good.select("code", F.explode("economies").alias("key", "years")).select("code", "key", F.explode("years").alias("period", "v"))
    numeric = F.schema_of_variant("v").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    obs = by_year.select(
        F.lit("imf_datamapper").alias("source"), F.concat(F.lit("imf/"), F.col("code")).alias("series_id"), "code",
        F.coalesce(F.try_element_at(alias, F.col("key")), F.col("key")).alias("iso3"), "period",
        P.period_year(F.col("period")).alias("year"), F.when(numeric, F.try_variant_get("v", "$", "double")).alias("value"),
    )
    unusable = per_code.filter(F.col("_c").isNull()).select("path", F.lit(None).cast("string").alias("code"), F.lit("unexpected_payload").alias("fault"))
    truncated = exploded.filter(F.col("n_economies") < min_economies).select("path", "code", F.lit("truncated_payload").alias("fault"))
    return obs, unusable.unionByName(truncated)


def imf_editions(raw: DataFrame, min_entries: int = MIN_METADATA_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Edition label, year, month and load time per code; the label itself is never rewritten."""
    return split(imf_editions_marked(raw, min_entries))


def imf_editions_marked(raw: DataFrame, min_entries: int = MIN_METADATA_ENTRIES) -> DataFrame:
    """A table with too few entries is a truncated payload, not a statement about the missing ones."""
    entry = "struct<label:string,source:string,dataset:string,`last-modified`:string>"
    table = F.from_json("body", f"indicators map<string,{entry}>")["indicators"]
    fault = F.when(F.col("t").isNull(), "unexpected_payload").when(F.size("t") <= min_entries, "truncated_payload")
    rows = raw.select(_path(raw), table.alias("t")).withColumn("fault", fault)
    rows = rows.select("path", "fault", F.posexplode_outer(F.when(F.col("fault").isNull(), F.map_entries("t"))).alias("pos", "e"))
    parts = P.edition_label_parts(F.col("e.value.source"))
    return rows.select(
        "path", "fault", (F.coalesce("pos", F.lit(0)) == 0).alias("leads"),
        F.col("e.key").alias("code"), F.col("e.value.label").alias("label"), F.col("e.value.source").alias("edition_label"), F.col("e.value.dataset").alias("dataset"),
        parts["year"].alias("edition_year"), parts["month"].alias("edition_month"), F.col("e.value.last-modified").alias("last_modified"),
    )


def dbnomics_observations(raw: DataFrame, wanted: str | None = "wanted_code") -> tuple[DataFrame, DataFrame]:
    """Series documents with parallel ``period`` / ``value`` arrays.

    When a payload lists several series the exact code wins, then the shortest code
    starting with the wanted one, then the first.  The choice is made inside the row.
    """
    return split(dbnomics_marked(raw, wanted))


def dbnomics_marked(raw: DataFrame, wanted: str | None = "wanted_code") -> DataFrame:
    doc = (
        "struct<`@frequency`:string,dataset_code:string,dataset_name:string,provider_code:string,series_code:string,"
        "series_name:string,period:array<string>,value:array<string>>"
    )
    schema = f"provider struct<code:string,name:string>, dataset struct<code:string,name:string>, series struct<docs:array<{doc}>>"
    p = raw.withColumn("_p", F.from_json("body", schema))
    code = F.col(wanted) if wanted in raw.columns else F.lit(None).cast("string")

    def preference(d, i):
        starts = F.coalesce(d["series_code"].startswith(code), F.lit(False))
        rank = F.when(F.coalesce(d["series_code"] == code, F.lit(False)), F.lit(0)).when(starts, F.lit(1)).otherwise(F.lit(2))
        return F.struct(rank.alias("rank"), F.when(starts, F.length(d["series_code"])).otherwise(F.lit(0)).alias("len"), i.alias("i"))

    best = F.array_min(F.transform("_p.series.docs", preference))["i"]
    chosen = p.select(_path(raw), "_p", F.get(F.col("_p.series.docs"), best).alias("d"))
    points = F.arrays_zip("d.period", "d.value")
    fault = (
        F.when(F.col("_p.series.docs").isNull(), "unexpected_payload")
        .when(F.size("_p.series.docs") == 0, "no_series")
        .when(F.coalesce(F.size(points), F.lit(0)) <= 0, "no_observations")
    )
    chosen = chosen.withColumn("fault", fault)
    rows = chosen.select(
        "path", "fault",
        F.coalesce("_p.provider.code", "d.provider_code").alias("provider"),
        F.coalesce("_p.provider.name", "d.provider_code").alias("provider_name"),
        F.coalesce("_p.dataset.code", "d.dataset_code").alias("dataset"),
        F.coalesce("_p.dataset.name", "d.dataset_name").alias("dataset_name"),
        F.col("d.series_code").alias("series_code"), F.col("d.series_name").alias("series_name"), F.col("d.@frequency").alias("frequency"),
        F.posexplode_outer(F.when(F.col("fault").isNull(), points)).alias("pos", "o"),
    )
    text = F.trim(F.col("o.value"))
    return rows.select(
        "path", "fault", (F.coalesce("pos", F.lit(0)) == 0).alias("leads"),
        F.lit("dbnomics").alias("source"),
        F.concat_ws("/", F.lit("dbnomics"), "provider", "dataset", "series_code").alias("series_id"),
        "provider", "provider_name", "dataset", "dataset_name", "series_code", "series_name", "frequency", "pos",
        F.col("o.period").alias("period"), P.period_year(F.col("o.period")).alias("year"), _finite(text.try_cast("double")).alias("value"),
    )


def sdmx_observations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SDMX-JSON with or without the ``data`` envelope.

    Observations are keyed by stringified index into the time dimension; the map may
    be sparse, values may be text or numbers, and an index without a period is
    dropped.  Needs ``series_key`` in ``raw`` to name the series.
    """
    return split(sdmx_marked(raw))


def sdmx_marked(raw: DataFrame) -> DataFrame:
    v = raw.withColumn("_v", F.try_parse_json("body"))
    inner = F.try_variant_get("_v", "$.data", "variant")
    has_inner = F.try_variant_get("_v", "$.data.dataSets", "variant").isNotNull()
    v = v.withColumn("_root", F.when(has_inner, inner).otherwise(F.col("_v")))
    periods = F.try_variant_get("_root", "$.structure.dimensions.observation[0].values", "array<struct<id:string>>")
    series = F.try_variant_get("_root", "$.dataSets[0].series", "map<string,struct<observations:map<string,array<variant>>>>")
    first = F.get(F.map_values(series), F.lit(0))["observations"]
    v = v.select(_path(raw), "series_key", F.try_variant_get("_root", "$.structure.name", "string").alias("series_name"), F.col("_v").isNull().alias("_unread"), periods.alias("periods"), F.map_entries(first).alias("_o"))
    dated = F.transform(
        "_o",
        lambda e: F.struct(F.get(F.transform("periods", lambda p: p["id"]), e["key"].try_cast("int")).alias("period"), F.nullif(F.try_variant_get(F.get(e["value"], F.lit(0)), "$", "string"), F.lit("")).alias("text")),
    )
    v = v.withColumn("_o", F.filter(dated, lambda o: F.coalesce(o["period"], F.lit("")) != ""))
    fault = F.when(F.col("_unread"), "unexpected_payload").when(F.col("_o").isNull(), "no_series").when(F.size("_o") == 0, "no_observations")
    rows = v.withColumn("fault", fault).select("path", "fault", "series_key", "series_name", F.posexplode_outer(F.when(F.col("fault").isNull(), F.col("_o"))).alias("pos", "o"))
    return rows.select(
        "path", "fault", (F.coalesce("pos", F.lit(0)) == 0).alias("leads"), "series_key", "series_name", F.col("o.period").alias("period"),
        _finite(F.col("o.text").try_cast("double")).alias("value"), P.period_year(F.col("o.period")).alias("year"),
    )


def daily_rates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Range payloads ``rates[day][currency]`` and single-day payloads ``rates[currency]`` to (base, quote, day, rate)."""
    return split(daily_rates_marked(raw))


def daily_rates_marked(raw: DataFrame) -> DataFrame:
    one = F.from_json("body", "base string, date string, rates map<string,double>")
    many = F.from_json("body", "base string, rates map<string,map<string,double>>")
    single = F.get_json_object("body", "$.date").isNotNull()
    p = raw.withColumn("_single", single).withColumn("_one", F.when(single, one)).withColumn("_many", F.when(~single, many))

    def quote(day, e):
        return F.struct(day.alias("day"), e["key"].alias("quote"), e["value"].alias("rate"))

    flat = F.when(F.col("_single"), F.transform(F.map_entries("_one.rates"), lambda e: quote(F.col("_one.date"), e))).otherwise(
        F.flatten(F.transform(F.map_entries("_many.rates"), lambda d: F.transform(F.map_entries(d["value"]), lambda e: quote(d["key"], e))))
    )
    p = p.select(_path(raw), F.coalesce("_one.base", "_many.base").alias("base"), flat.alias("_q"))
    fault = F.when(F.col("_q").isNull(), "unexpected_payload").when(F.size("_q") == 0, "no_rates")
    rows = p.withColumn("fault", fault).select("path", "fault", "base", F.posexplode_outer(F.when(F.col("fault").isNull(), F.col("_q"))).alias("pos", "q"))
    return rows.select("path", "fault", (F.coalesce("pos", F.lit(0)) == 0).alias("leads"), "base", "q.quote", F.try_to_date("q.day", "yyyy-MM-dd").alias("day"), "q.rate")


def economies_from_listing(raw: DataFrame) -> DataFrame:
    """Publisher's country listing ``[meta, rows]``: code, two-letter code, name, aggregate flag."""
    row = "struct<id:string,iso2Code:string,name:string,region:struct<id:string,value:string>>"
    rows = raw.select(F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$[1]", f"array<{row}>")).alias("ordinal", "r"))
    return rows.select(
        "ordinal", F.col("r.id").alias("iso3"), F.col("r.iso2Code").alias("iso2"), F.col("r.name").alias("name"),
        (F.col("r.region.id") == "NA").alias("aggregate"), F.array().cast("array<string>").alias("aliases"),
    )


def read_editions(spark: SparkSession, path: str, edition: str | None = None) -> DataFrame:
    """Dated archive partitioned by ``edition``; one edition reads one partition, never a neighbour."""
    archive = spark.read.option("basePath", path).parquet(path)
    return archive if edition is None else archive.filter(F.col("edition") == edition)


def asked_editions(archive: DataFrame, claims: DataFrame) -> DataFrame:
    """The rows of the dated archive in the editions that ``claims(edition)`` name; the others are not read.

    Partitions are pruned while the query runs, from the distinct editions of the claims:
    two a year, whatever the number of claims, so they are broadcast.
    """
    # a condition on the label's form: Spark prunes by a side that it takes to be selective
    wanted = claims.where(F.col("edition").rlike("^[0-9]{4}-[0-9]{2}$")).select("edition").distinct()
    return archive.join(F.broadcast(wanted), "edition", "left_semi")
