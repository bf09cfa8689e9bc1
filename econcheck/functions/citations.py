"""Citation columns derived from one struct, so the formats can never disagree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOL_NAME = "Econcheck"

# Licence lines.
LICENSE_WDI = "CC BY 4.0"
LICENSE_IMF = (
    "Use and redistribution are subject to the IMF's data-usage terms, including attribution and "
    "downstream-user conditions; commercial reuse may require IMF permission — consult the IMF terms directly"
)
LICENSE_BIS = (
    "BIS statistics may be reproduced and redistributed with attribution; see the BIS terms and conditions for statistics"
)
LICENSE_ECB_DATA = "ECB content may be reproduced with attribution; see the ECB disclaimer and copyright notice"
LICENSE_ECB_FX = "ECB reference rates are published for information purposes; reuse with attribution"
ECB_FX_URL = (
    "https://www.ecb.europa.eu/stats/policy_and_exchange_rates/euro_reference_exchange_rates/html/index.en.html"
)


def bibtex_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([&%$#_])", r"\\$1")


def citation(
    publisher: Column,
    dataset: Column,
    series_id: Column,
    series_name: Column,
    source_url: Column,
    license_text: Column,
    attribution: Column,
    retrieved_at: Column,
    last_updated: Column | None = None,
) -> Column:
    """struct with the citation fields plus sentence, BibTeX and APA forms."""
    updated = F.when(
        last_updated.isNotNull(), F.concat(F.lit(", data last updated "), last_updated)
    ).otherwise(F.lit("")) if last_updated is not None else F.lit("")
    text = F.concat(
        publisher, F.lit(", "), dataset, F.lit(", series "), series_id, F.lit(" ("), series_name, F.lit(")"), updated,
        F.lit(". Retrieved "), retrieved_at, F.lit(f" via {TOOL_NAME}. "), source_url,
    )
    key = F.concat_ws(
        "_",
        F.lower(F.regexp_extract(publisher, r"^([A-Za-z]*)", 1)),
        F.regexp_replace(series_id, r"[^A-Za-z0-9]+", "_"),
        F.substring(retrieved_at, 1, 4),
    )
    bibtex = F.concat(
        F.lit("@misc{"), key, F.lit(",\n  author = {{"), publisher, F.lit("}},\n  title = {{"),
        bibtex_escape(dataset), F.lit(": "), bibtex_escape(series_name), F.lit("}},\n  year = {"),
        F.substring(retrieved_at, 1, 4), F.lit("},\n  url = {"), source_url, F.lit("},\n  note = {Series "),
        bibtex_escape(series_id), F.lit(". Retrieved "), retrieved_at, F.lit(f" via {TOOL_NAME}. "),
        bibtex_escape(attribution), F.lit("}\n}"),
    )
    apa = F.concat(
        publisher, F.lit(". (n.d.). "), series_name, F.lit(" [Data set]. "), dataset, F.lit(". Retrieved "),
        retrieved_at, F.lit(", from "), source_url,
    )
    return F.struct(
        publisher.alias("source"), dataset.alias("dataset"), series_id.alias("series_id"),
        series_name.alias("series_name"), source_url.alias("source_url"), license_text.alias("license"),
        attribution.alias("attribution"), retrieved_at.alias("retrieved_at"), text.alias("citation_text"),
        bibtex.alias("bibtex"), apa.alias("apa"),
    )


def wdi_citation(indicator_id, indicator_name, iso3, retrieved_at, last_updated=None) -> Column:
    return citation(
        F.lit("World Bank"), F.lit("World Development Indicators"), indicator_id, indicator_name,
        F.concat(F.lit("https://data.worldbank.org/indicator/"), indicator_id, F.lit("?locations="), iso3),
        F.lit(LICENSE_WDI),
        F.concat(F.lit("The World Bank: World Development Indicators: "), indicator_name),
        retrieved_at, last_updated,
    )


def imf_citation(code, edition_label, series_name, iso3, database, retrieved_at) -> Column:
    return citation(
        F.lit("International Monetary Fund"), edition_label, F.concat(F.lit("imf/"), code), series_name,
        F.concat(F.lit("https://www.imf.org/external/datamapper/"), code, F.lit("@"), database, F.lit("/"), iso3),
        F.lit(LICENSE_IMF), F.lit("Source: International Monetary Fund"), retrieved_at,
    )


def aggregator_citation(provider, provider_name, dataset, dataset_name, series_code, series_name, retrieved_at) -> Column:
    is_imf = provider == "IMF"
    return citation(
        provider_name, dataset_name, F.concat_ws("/", provider, dataset, series_code), series_name,
        F.concat(
            F.lit("https://db.nomics.world/"), provider, F.lit("/"),
            F.url_encode(dataset), F.lit("/"), F.url_encode(series_code),
        ),
        F.when(is_imf, F.lit(LICENSE_IMF)).otherwise(
            F.concat(provider_name, F.lit(" terms apply; retrieved via DBnomics (open aggregator)"))
        ),
        F.when(is_imf, F.lit("Source: International Monetary Fund")).otherwise(
            F.concat(F.lit("Source: "), provider_name, F.lit(" (via DBnomics)"))
        ),
        retrieved_at,
    )


def sdmx_citation(provider, flow, key, series_name, source_url, retrieved_at) -> Column:
    is_bis = provider == "BIS"
    publisher = F.when(is_bis, F.lit("Bank for International Settlements")).otherwise(F.lit("European Central Bank"))
    return citation(
        publisher,
        F.concat(F.when(is_bis, F.lit("BIS ")).otherwise(F.lit("ECB Data Portal ")), flow),
        F.concat_ws("/", F.lower(provider), flow, key), series_name, source_url,
        F.when(is_bis, F.lit(LICENSE_BIS)).otherwise(F.lit(LICENSE_ECB_DATA)),
        F.concat(F.lit("Source: "), publisher), retrieved_at,
    )


def ecb_fx_citation(base, quote, retrieved_at) -> Column:
    return citation(
        F.lit("European Central Bank"), F.lit("Euro foreign exchange reference rates"),
        F.concat(F.lit("ECB/"), base, quote),
        F.concat(base, F.lit("/"), quote, F.lit(" reference exchange rate")),
        F.lit(ECB_FX_URL), F.lit(LICENSE_ECB_FX),
        F.lit("Source: European Central Bank euro foreign exchange reference rates"), retrieved_at,
    )
