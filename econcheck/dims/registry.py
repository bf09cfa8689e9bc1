"""Indicator registry: 48 series keys with their source codes.

``indicator_table`` gives one row per key, ``source_table`` one row per
(key, source) with its place in the source chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WDI, DATAMAPPER, DBNOMICS, BIS, ECB, FRED = "wdi", "imf_datamapper", "dbnomics", "bis", "ecb_data", "fred"
SOURCE_LABELS = {
    WDI: "World Bank WDI",
    DATAMAPPER: "IMF DataMapper API",
    DBNOMICS: "IMF WEO (via DBnomics)",
    BIS: "BIS statistics",
    ECB: "ECB Data Portal",
}

# Key, label, unit, kind, source codes, synonyms, flags.
INDICATORS = [
    dict(key="gdp_growth", label="GDP growth (annual %)", unit="% (annual, real)", kind="percent",
         wdi="NY.GDP.MKTP.KD.ZG", imf=("NGDP_RPCH", "WEO"), weo="{ISO3}.NGDP_RPCH.pcent_change",
         synonyms=["real gdp growth", "economic growth", "growth rate", "gdp growth rate"]),
    dict(key="gdp_current_usd", label="GDP (current US$)", unit="current US$", kind="level", wdi="NY.GDP.MKTP.CD",
         synonyms=["gdp", "nominal gdp", "gross domestic product", "size of economy", "gdp in dollars"]),
    dict(key="gdp_per_capita_usd", label="GDP per capita (current US$)", unit="current US$", kind="level",
         wdi="NY.GDP.PCAP.CD", synonyms=["gdp per capita", "income per person", "gdp per head"]),
    dict(key="gdp_per_capita_ppp", label="GDP per capita, PPP (current international $)",
         unit="current international $ (PPP)", kind="level", wdi="NY.GDP.PCAP.PP.CD",
         synonyms=["gdp per capita ppp", "ppp per capita", "purchasing power parity per capita"]),
    dict(key="gni_per_capita_atlas", label="GNI per capita, Atlas method (current US$)", unit="current US$", kind="level",
         wdi="NY.GNP.PCAP.CD", synonyms=["gni per capita", "atlas method", "income classification"]),
    dict(key="inflation_cpi", label="Inflation, consumer prices (annual %)", unit="% (annual average)", kind="percent",
         wdi="FP.CPI.TOTL.ZG",
         synonyms=["inflation", "inflation rate", "cpi inflation", "consumer price inflation", "price growth"]),
    dict(key="cpi_index", label="Consumer price index (2010 = 100)", unit="index, 2010 = 100", kind="index",
         wdi="FP.CPI.TOTL", synonyms=["cpi", "consumer price index", "price level", "price index"]),
    dict(key="gdp_deflator_growth", label="Inflation, GDP deflator (annual %)", unit="%", kind="percent",
         wdi="NY.GDP.DEFL.KD.ZG", synonyms=["gdp deflator", "deflator inflation"]),
    dict(key="unemployment_rate", label="Unemployment, total (% of labor force, modeled ILO estimate)",
         unit="% of labor force", kind="percent", wdi="SL.UEM.TOTL.ZS", modeled=True,
         synonyms=["unemployment", "unemployment rate", "jobless rate", "joblessness"]),
    dict(key="labor_force_participation", label="Labor force participation rate (% of population 15+, modeled ILO)",
         unit="% of population ages 15+", kind="percent", wdi="SL.TLF.CACT.ZS", modeled=True,
         synonyms=["labor force participation", "participation rate", "lfpr"]),
    dict(key="population", label="Population, total", unit="people", kind="level", wdi="SP.POP.TOTL",
         synonyms=["population", "number of people", "inhabitants", "how many people"]),
    dict(key="population_growth", label="Population growth (annual %)", unit="%", kind="percent", wdi="SP.POP.GROW",
         synonyms=["population growth", "population growth rate"]),
    dict(key="current_account_gdp", label="Current account balance (% of GDP)", unit="% of GDP", kind="percent",
         wdi="BN.CAB.XOKA.GD.ZS", imf=("BCA_NGDPD", "WEO"), weo="{ISO3}.BCA_NGDPD.pcent_gdp",
         synonyms=["current account", "current account balance", "external balance", "bop current account"]),
    dict(key="govt_debt_gdp", label="General government gross debt (% of GDP)", unit="% of GDP", kind="percent",
         wdi="GC.DOD.TOTL.GD.ZS", imf=("GGXWDG_NGDP", "WEO"), weo="{ISO3}.GGXWDG_NGDP.pcent_gdp", imf_first=True,
         synonyms=["government debt", "public debt", "debt to gdp", "national debt", "sovereign debt", "debt ratio"]),
    dict(key="fiscal_balance_gdp", label="General government net lending/borrowing (% of GDP)", unit="% of GDP",
         kind="percent", imf=("GGXCNL_NGDP", "WEO"), weo="{ISO3}.GGXCNL_NGDP.pcent_gdp", imf_first=True,
         synonyms=["fiscal balance", "budget balance", "fiscal deficit", "budget deficit", "government balance",
                   "net lending"]),
    dict(key="govt_revenue_gdp", label="General government revenue (% of GDP)", unit="% of GDP", kind="percent",
         imf=("GGR_G01_GDP_PT", "FM"), weo="{ISO3}.GGR_NGDP.pcent_gdp", imf_first=True,
         synonyms=["government revenue", "revenue to gdp", "fiscal revenue"]),
    dict(key="govt_expenditure_gdp", label="General government total expenditure (% of GDP)", unit="% of GDP",
         kind="percent", imf=("G_X_G01_GDP_PT", "FM"), weo="{ISO3}.GGX_NGDP.pcent_gdp", imf_first=True,
         synonyms=["government spending", "government expenditure", "public spending"]),
    dict(key="tax_revenue_gdp", label="Tax revenue (% of GDP)", unit="% of GDP", kind="percent", wdi="GC.TAX.TOTL.GD.ZS",
         synonyms=["tax revenue", "tax to gdp", "tax burden"]),
    dict(key="trade_gdp", label="Trade (% of GDP)", unit="% of GDP", kind="percent", wdi="NE.TRD.GNFS.ZS",
         synonyms=["trade openness", "trade to gdp", "openness"]),
    dict(key="exports_gdp", label="Exports of goods and services (% of GDP)", unit="% of GDP", kind="percent",
         wdi="NE.EXP.GNFS.ZS", synonyms=["exports", "export share"]),
    dict(key="imports_gdp", label="Imports of goods and services (% of GDP)", unit="% of GDP", kind="percent",
         wdi="NE.IMP.GNFS.ZS", synonyms=["imports", "import share"]),
    dict(key="fdi_inflows_gdp", label="Foreign direct investment, net inflows (% of GDP)", unit="% of GDP",
         kind="percent", wdi="BX.KLT.DINV.WD.GD.ZS",
         synonyms=["fdi", "foreign direct investment", "fdi inflows"]),
    dict(key="policy_rate", label="Central bank policy rate", unit="% per annum", kind="percent",
         sdmx=("BIS", "WS_CBPOL", "M.{ISO2}"),
         synonyms=["policy rate", "interest rate", "central bank rate", "base rate", "fed funds", "bank rate",
                   "monetary policy rate"]),
    dict(key="euro_area_hicp", label="Euro area HICP inflation (annual rate)", unit="%", kind="percent",
         sdmx=("ECB", "HICP", "M.U2.N.000000.4D0.ANR"),
         synonyms=["hicp", "euro area inflation", "eurozone inflation", "harmonised inflation"]),
    dict(key="tourism_receipts_exports", label="International tourism, receipts (% of total exports)",
         unit="% of total exports", kind="percent", wdi="ST.INT.RCPT.XP.ZS",
         synonyms=["tourism receipts", "tourism exports", "tourism share of exports", "tourism dependence"]),
    dict(key="external_debt_stock_usd", label="External debt stocks, total (DOD, current US$)", unit="current US$",
         kind="level", wdi="DT.DOD.DECT.CD",
         synonyms=["external debt", "external debt stock", "total external debt", "foreign debt"]),
    dict(key="external_debt_service_usd", label="Total debt service on external debt (TDS, current US$)",
         unit="current US$", kind="level", wdi="DT.TDS.DECT.CD",
         synonyms=["debt service", "external debt service", "debt repayments"]),
    dict(key="debt_service_exports_pct", label="Total debt service (% of exports of goods, services and primary income)",
         unit="% of exports", kind="percent", wdi="DT.TDS.DECT.EX.ZS",
         synonyms=["debt service ratio", "debt service to exports", "debt burden"]),
    dict(key="remittances_gdp", label="Personal remittances, received (% of GDP)", unit="% of GDP", kind="percent",
         wdi="BX.TRF.PWKR.DT.GD.ZS", synonyms=["remittances", "remittance inflows"]),
    dict(key="gross_capital_formation_gdp", label="Gross capital formation (% of GDP)", unit="% of GDP", kind="percent",
         wdi="NE.GDI.TOTL.ZS", synonyms=["investment rate", "capital formation", "gross investment"]),
    dict(key="gross_savings_gdp", label="Gross savings (% of GDP)", unit="% of GDP", kind="percent",
         wdi="NY.GNS.ICTR.ZS", synonyms=["savings rate", "gross savings", "national savings"]),
    dict(key="official_fx_rate", label="Official exchange rate (LCU per US$, period average)", unit="LCU per US$",
         kind="rate", wdi="PA.NUS.FCRF",
         synonyms=["exchange rate", "official exchange rate", "currency rate", "lcu per usd"]),
    dict(key="reserves_months_imports", label="Total reserves in months of imports", unit="months of imports",
         kind="level", wdi="FI.RES.TOTL.MO", synonyms=["reserves", "import cover", "foreign reserves months"]),
    dict(key="reserves_total_usd", label="Total reserves (includes gold, current US$)", unit="current US$", kind="level",
         wdi="FI.RES.TOTL.CD", synonyms=["total reserves", "foreign exchange reserves", "fx reserves"]),
    dict(key="lending_rate", label="Lending interest rate (%)", unit="%", kind="percent", wdi="FR.INR.LEND",
         synonyms=["lending rate", "loan rate", "bank lending rate"]),
    dict(key="deposit_rate", label="Deposit interest rate (%)", unit="%", kind="percent", wdi="FR.INR.DPST",
         synonyms=["deposit rate", "savings rate interest"]),
    dict(key="real_interest_rate", label="Real interest rate (%)", unit="%", kind="percent", wdi="FR.INR.RINR",
         synonyms=["real interest rate"]),
    dict(key="broad_money_gdp", label="Broad money (% of GDP)", unit="% of GDP", kind="percent",
         wdi="FM.LBL.BMNY.GD.ZS", synonyms=["broad money", "m2 to gdp", "money supply"]),
    dict(key="gini", label="Gini index", unit="index (0–100)", kind="index", wdi="SI.POV.GINI",
         synonyms=["gini", "gini coefficient", "inequality", "income inequality"]),
    dict(key="poverty_headcount_intl", label="Poverty headcount ratio at $2.15/day, 2017 PPP (% of population)",
         unit="% of population", kind="percent", wdi="SI.POV.DDAY",
         synonyms=["poverty rate", "extreme poverty", "poverty headcount"]),
    dict(key="life_expectancy", label="Life expectancy at birth, total (years)", unit="years", kind="years",
         wdi="SP.DYN.LE00.IN", synonyms=["life expectancy", "longevity"]),
    dict(key="urban_population_share", label="Urban population (% of total population)", unit="% of population",
         kind="percent", wdi="SP.URB.TOTL.IN.ZS", synonyms=["urbanization", "urban population", "urban share"]),
    # Recognised keys without a servable source.
    dict(key="us_fed_funds_rate", label="US federal funds effective rate (monthly, %)", unit="%", kind="percent",
         synonyms=["fed funds", "federal funds rate", "us policy rate", "fed rate"]),
    dict(key="us_10y_treasury", label="US 10-year Treasury constant maturity yield (daily, %)", unit="%", kind="percent",
         synonyms=["10 year treasury", "10y yield", "treasury yield"]),
    dict(key="us_cpi_monthly", label="US CPI for all urban consumers (monthly index, 1982–84 = 100)",
         unit="index, 1982–84 = 100", kind="index", synonyms=["us cpi monthly", "cpiaucsl"]),
    dict(key="us_unemployment_monthly", label="US unemployment rate (monthly, %)", unit="%", kind="percent",
         synonyms=["us unemployment monthly", "unrate"]),
    dict(key="us_nonfarm_payrolls", label="US total nonfarm payrolls (monthly, thousands of persons)",
         unit="thousands of persons", kind="level",
         synonyms=["nonfarm payrolls", "payrolls", "payems", "jobs report"]),
    dict(key="us_real_gdp", label="US real GDP (quarterly, chained 2017 dollars, SAAR)",
         unit="billions of chained 2017 US$", kind="level", synonyms=["us real gdp quarterly", "gdpc1"]),
]

# The ten keys of a country snapshot, in order; debt has its own chain.
SNAPSHOT_KEYS = [
    "gdp_current_usd", "gdp_growth", "gdp_per_capita_usd", "inflation_cpi", "unemployment_rate", "population",
    "current_account_gdp", "trade_gdp", "fdi_inflows_gdp", "life_expectancy",
]
SNAPSHOT_DEBT_KEY = "govt_debt_gdp"
REGISTRY_SIZE = len(INDICATORS)


def chain_of(d: dict) -> list[tuple[str, str, str]]:
    """Ordered (source, dataset, code) attempts: SDMX alone; IMF before WDI for fiscal or IMF-only keys."""
    if "sdmx" in d:
        provider, flow, code = d["sdmx"]
        return [(BIS if provider == "BIS" else ECB, flow, code)]
    imf = []
    if "imf" in d:
        imf.append((DATAMAPPER, d["imf"][1], d["imf"][0]))
    if "weo" in d:
        imf.append((DBNOMICS, "IMF/WEO:latest", d["weo"]))
    world = [(WDI, "WDI", d["wdi"])] if "wdi" in d else []
    return imf + world if d.get("imf_first") or not world else world + imf


def indicator_table(spark: SparkSession) -> DataFrame:
    rows = [
        (i, d["key"], d["label"], d["unit"], d["kind"], bool(d.get("modeled")), bool(chain_of(d)), "weo" in d, d["synonyms"])
        for i, d in enumerate(INDICATORS)
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, indicator string, label string, unit string, kind string, modeled boolean, active boolean, "
        "has_editions boolean, synonyms array<string>",
    )


def source_table(spark: SparkSession) -> DataFrame:
    rows = [
        (d["key"], source, priority, dataset, code)
        for d in INDICATORS
        for priority, (source, dataset, code) in enumerate(chain_of(d), start=1)
    ]
    return spark.createDataFrame(rows, "indicator string, source string, priority int, dataset string, code string")


def source_label(source) -> F.Column:
    """Public name of a source id."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])[source], source)
