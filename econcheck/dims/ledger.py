"""Licence ledger: which publishers are served, and on what terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from econcheck.functions import citations as C

# Id, name, licence, verdict, verified on, attribution, url, terms url.
SOURCES = [
    ("worldbank", "World Bank — World Development Indicators", C.LICENSE_WDI, "served", "2026-08-07",
     "The World Bank: World Development Indicators: <series name>", "https://data.worldbank.org",
     "https://data.worldbank.org/summary-terms-of-use"),
    ("imf_weo", "IMF — World Economic Outlook & Fiscal Monitor", C.LICENSE_IMF, "served", "2026-07-26",
     "Source: International Monetary Fund", "https://www.imf.org/en/Publications/WEO",
     "https://www.imf.org/external/terms.htm"),
    ("ecb_fx", "European Central Bank — euro foreign exchange reference rates", C.LICENSE_ECB_FX, "served", "2026-07-25",
     "Source: European Central Bank euro foreign exchange reference rates", C.ECB_FX_URL,
     "https://www.ecb.europa.eu/services/disclaimer/html/index.en.html"),
    ("dbnomics", "DBnomics (aggregator)", "Per underlying provider", "flow_through", "2026-07-25",
     "Cite the underlying provider", "https://db.nomics.world", "https://docs.db.nomics.world/"),
    ("bis", "Bank for International Settlements — central bank policy rates", C.LICENSE_BIS, "served", "2026-08-08",
     "Source: Bank for International Settlements", "https://data.bis.org/topics/CBPOL",
     "https://www.bis.org/terms_statistics.htm"),
    ("ecb_data", "European Central Bank — Data Portal", C.LICENSE_ECB_DATA, "served", "2026-08-08",
     "Source: European Central Bank", "https://data.ecb.europa.eu",
     "https://www.ecb.europa.eu/services/disclaimer/html/index.en.html"),
    ("fred", "Federal Reserve Bank of St. Louis — FRED", "FRED Services Terms of Use, clauses (p) and (q)", "refused",
     "2026-07-26", "Not applicable", "https://fred.stlouisfed.org", "https://fred.stlouisfed.org/legal/"),
    ("un_comtrade", "UN Comtrade (trade statistics)", "UN Comtrade policy on use and re-dissemination", "refused",
     "2026-08-08", "Not applicable", "https://comtradeplus.un.org",
     "https://uncomtrade.org/docs/policy-on-use-and-re-dissemination/"),
    ("eccb", "Eastern Caribbean Central Bank statistics", "ECCB website terms of use", "refused", "2026-07-31",
     "Not applicable", "https://www.eccb-centralbank.org", "https://www.eccb-centralbank.org"),
    ("cbb", "Central Bank of Barbados statistics", "Central Bank of Barbados website terms of use", "refused",
     "2026-07-31", "Not applicable", "https://www.centralbank.org.bb", "https://www.centralbank.org.bb"),
]


def ledger_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SOURCES,
        "source string, name string, license string, license_verdict string, verified_on string, "
        "attribution string, url string, terms_url string",
    )
