"""Constants of the accuracy benchmark."""

# Quotas, classes, kinds, years, restrictions.
HEADLINE_QUOTA = {
    "inflation_cpi": 12, "population": 8, "life_expectancy": 8, "unemployment_rate": 8, "trade_gdp": 8,
    "reserves_total_usd": 8, "gdp_growth": 8, "gdp_current_usd": 8, "govt_debt_gdp": 8, "fiscal_balance_gdp": 8,
    "current_account_gdp": 8, "fdi_inflows_gdp": 8,
}
REVISION_CLASS = {
    "inflation_cpi": "A", "population": "B", "life_expectancy": "B", "unemployment_rate": "B", "trade_gdp": "B",
    "reserves_total_usd": "B", "gdp_growth": "C", "gdp_current_usd": "C", "govt_debt_gdp": "C",
    "fiscal_balance_gdp": "C", "current_account_gdp": "C", "fdi_inflows_gdp": "C",
}
INDICATOR_KIND = {
    "inflation_cpi": "percent", "unemployment_rate": "percent", "trade_gdp": "percent", "gdp_growth": "percent",
    "govt_debt_gdp": "percent", "fiscal_balance_gdp": "percent", "current_account_gdp": "percent",
    "fdi_inflows_gdp": "percent", "population": "level", "life_expectancy": "level", "reserves_total_usd": "level",
    "gdp_current_usd": "level", "gini": "level", "poverty_headcount_intl": "percent",
}
PROBE_INDICATORS = ["gini", "poverty_headcount_intl"]
HEADLINE_YEARS = [2018, 2019, 2020, 2021, 2022]
RECENCY_YEARS = [2023, 2024, 2025]
TIER_RESTRICTION = {"gdp_current_usd": ["T1", "T2"], "fdi_inflows_gdp": ["T1", "T2", "T3"]}
TIER_UPPER_RANK = (("T1", 20), ("T2", 60), ("T3", 120))
LAST_TIER = "T4"
TIER_QUOTA = {"T1": 25, "T2": 25, "T3": 25, "T4": 25}
YEAR_QUOTA = {y: 20 for y in HEADLINE_YEARS}
MAX_PER_ECONOMY = 2
BATCH_SIZE = 10
MAX_PROBES_PER_BATCH = 2
CORE_PER_TIER = 10
RETRIEVAL_PER_TIER = {"T1": 8, "T2": 8, "T3": 7, "T4": 7}
AUDIT_REL_TOLERANCE = 1e-9
GRID_MIN_ANSWER_RATE = 0.7
ERROR_PROBS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
