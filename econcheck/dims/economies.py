"""Economies: aliases, groups, area codes and currencies.

The list of economies itself is a parameter: ``sources.landed.economies_from_listing``
reads the publisher's country listing a user has landed.  Only what the listing
does not carry (aliases, group membership, area codes, currencies) is stated here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extra names per code.
ALIASES = {
    "ATG": ["antigua"], "BHS": ["the bahamas"], "BIH": ["bosnia"], "BRN": ["brunei"], "CPV": ["cape verde"],
    "CHN": ["prc", "people's republic of china"],
    "COD": ["democratic republic of the congo", "dr congo", "drc", "congo-kinshasa"],
    "COG": ["republic of the congo", "congo-brazzaville", "congo"],
    "CIV": ["ivory coast", "côte d'ivoire"], "CUW": ["curaçao"], "CZE": ["czech republic"],
    "EGY": ["arab republic of egypt"], "SWZ": ["swaziland"], "GMB": ["the gambia"], "HKG": ["hong kong"],
    "IRN": ["iran"], "PRK": ["north korea"], "KOR": ["south korea", "korea", "republic of korea"],
    "KGZ": ["kyrgyzstan"], "LAO": ["laos"], "MAC": ["macau", "macao"], "FSM": ["micronesia"], "MMR": ["burma"],
    "NLD": ["the netherlands", "holland"], "MKD": ["macedonia"], "PHL": ["the philippines"], "RUS": ["russia"],
    "STP": ["são tomé and príncipe"], "SXM": ["sint maarten"], "SVK": ["slovakia"],
    "KNA": ["saint kitts and nevis", "st kitts"], "LCA": ["saint lucia"],
    "VCT": ["saint vincent and the grenadines", "st vincent"], "SYR": ["syria"], "TLS": ["east timor"],
    "TTO": ["trinidad"], "TUR": ["turkey", "türkiye"], "TCA": ["turks and caicos"], "ARE": ["uae", "emirates"],
    "GBR": ["uk", "great britain", "britain", "england"],
    "USA": ["usa", "america", "united states of america", "u.s.", "u.s.a."], "VEN": ["venezuela"],
    "VNM": ["vietnam"], "PSE": ["palestine", "palestinian territories"], "YEM": ["yemen"],
    "WLD": ["global", "worldwide"], "EUU": ["eu"], "EMU": ["eurozone", "euro zone"], "OED": ["oecd"],
    "HIC": ["high income"], "LIC": ["low income"], "LMC": ["lower middle income"], "UMC": ["upper middle income"],
    "LCN": ["latin america", "lac"], "MEA": ["mena"],
}

# Small island developing states (39).
SIDS = [
    "ATG", "BHS", "BRB", "BLZ", "CPV", "COM", "COK", "CUB", "DMA", "DOM", "FJI", "GRD", "GNB",
    "GUY", "HTI", "JAM", "KIR", "MDV", "MHL", "FSM", "MUS", "NRU", "NIU", "PLW", "PNG", "WSM",
    "STP", "SGP", "KNA", "LCA", "VCT", "SYC", "SLB", "SUR", "TLS", "TON", "TTO", "TUV", "VUT",
]

# Policy-rate areas (economy code -> area code). The euro area is XM here only.
POLICY_RATE_AREAS = dict(
    ARG="AR", AUS="AU", AUT="AT", BEL="BE", BRA="BR", CAN="CA", CHE="CH", CHL="CL", CHN="CN", COL="CO",
    CZE="CZ", DEU="DE", DNK="DK", ESP="ES", FRA="FR", GBR="GB", GRC="GR", HKG="HK", HRV="HR", HUN="HU",
    IDN="ID", IND="IN", ISL="IS", ISR="IL", ITA="IT", JPN="JP", KOR="KR", KWT="KW", MAR="MA", MEX="MX",
    MKD="MK", MYS="MY", NLD="NL", NOR="NO", NZL="NZ", PER="PE", PHL="PH", POL="PL", PRT="PT", ROU="RO",
    RUS="RU", SAU="SA", SRB="RS", SWE="SE", THA="TH", TUR="TR", USA="US", ZAF="ZA", EMU="XM",
)

# Currency -> economy whose official rate represents it.
CURRENCY_ECONOMY = dict(
    BBD="BRB", XCD="LCA", JMD="JAM", TTD="TTO", BSD="BHS", GYD="GUY", BZD="BLZ", HTG="HTI", DOP="DOM", CUP="CUB",
    AWG="ABW", ANG="CUW", KYD="CYM", BMD="BMU", SRD="SUR", ARS="ARG", CLP="CHL", COP="COL", PEN="PER", UYU="URY",
    BOB="BOL", PYG="PRY", CRC="CRI", GTQ="GTM", HNL="HND", NIO="NIC", PAB="PAN", VES="VEN", EGP="EGY", NGN="NGA",
    KES="KEN", GHS="GHA", XOF="SEN", XAF="CMR", MAD="MAR", TND="TUN", DZD="DZA", ETB="ETH", TZS="TZA", UGX="UGA",
    RWF="RWA", ZMW="ZMB", BWP="BWA", NAD="NAM", MUR="MUS", SCR="SYC", MZN="MOZ", AOA="AGO", CDF="COD", GMD="GMB",
    SLL="SLE", LRD="LBR", LKR="LKA", PKR="PAK", BDT="BGD", NPR="NPL", VND="VNM", KHR="KHM", LAK="LAO", MMK="MMR",
    MNT="MNG", KZT="KAZ", UZS="UZB", GEL="GEO", AMD="ARM", AZN="AZE", TJS="TJK", TMT="TKM", ALL="ALB", MKD="MKD",
    RSD="SRB", BAM="BIH", MDL="MDA", UAH="UKR", BYN="BLR", RUB="RUS", SAR="SAU", AED="ARE", QAR="QAT", KWD="KWT",
    BHD="BHR", OMR="OMN", JOD="JOR", ILS="ISR", IQD="IRQ", IRR="IRN", LBP="LBN", YER="YEM", SYP="SYR", FJD="FJI",
    PGK="PNG", WST="WSM", TOP="TON", SBD="SLB", VUV="VUT", XPF="PYF", MVR="MDV", BTN="BTN", MOP="MAC", BND="BRN",
    EUR="EMU", GBP="GBR", JPY="JPN", CHF="CHE", CAD="CAN", AUD="AUS", NZD="NZL", CNY="CHN", INR="IND", BRL="BRA",
    MXN="MEX", KRW="KOR", SEK="SWE", NOK="NOR", DKK="DNK", PLN="POL", CZK="CZE", HUF="HUN", RON="ROU", BGN="BGR",
    TRY="TUR", ZAR="ZAF", SGD="SGP", HKD="HKG", THB="THA", MYR="MYS", IDR="IDN", PHP="PHL", ISK="ISL", USD="USA",
)


def pairs_table(spark: SparkSession, pairs: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), f"{key} string, {value} string")


def policy_rate_areas(spark: SparkSession) -> DataFrame:
    return pairs_table(spark, POLICY_RATE_AREAS, "iso3", "area")


def currency_economies(spark: SparkSession) -> DataFrame:
    return pairs_table(spark, CURRENCY_ECONOMY, "currency", "iso3")


def with_aliases(economies: DataFrame) -> DataFrame:
    """Fill ``aliases`` from the stated table where the listing carries none."""
    stated = F.create_map(
        *[x for code, names in ALIASES.items() for x in (F.lit(code), F.array(*[F.lit(n) for n in names]))]
    )
    own = F.col("aliases") if "aliases" in economies.columns else F.lit(None).cast("array<string>")
    return economies.withColumn(
        "aliases", F.coalesce(own, F.try_element_at(stated, F.col("iso3")), F.array().cast("array<string>"))
    )


def members(df: DataFrame, codes: list[str], column: str = "iso3") -> DataFrame:
    """Rows whose economy belongs to a stated group (a constant list, so no join)."""
    return df.filter(F.col(column).isin(codes))
