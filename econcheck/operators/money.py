"""Currency conversion and price-level adjustment over request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from econcheck.plans.joins import lookup_join, null_safe_lookup_join

# First day of the daily reference rates, and the first whole year.
FIRST_DAILY_DAY = "1999-01-04"
FIRST_DAILY_YEAR = 1999
DATE_PATTERN = r"^\d{4}(-\d{2}-\d{2})?$"


def annual_average(rates: DataFrame) -> DataFrame:
    """Mean of quoted days and day count per base, quote and year."""
    return rates.groupBy("base", "quote", F.year("day").alias("year")).agg(
        F.avg("rate").alias("average"), F.count("rate").alias("days")
    )


def working_day_calendar(rates: DataFrame, until: str) -> DataFrame:
    """Every calendar day of each pair with the latest quote on or before it.

    A quoted day is repeated until the next quoted one, so an as-of lookup becomes
    an equi-join on the day.  One pair has at most one row per calendar day.
    """
    ordered = Window.partitionBy("base", "quote").orderBy("day")
    end = F.greatest(F.to_date(F.lit(until)), F.col("day"))
    last = F.coalesce(F.date_sub(F.lead("day").over(ordered), 1), end)
    return rates.withColumn("_last", last).select(
        "base", "quote", F.explode(F.sequence("day", F.greatest("_last", F.col("day")), F.expr("interval 1 day"))).alias("day"),
        F.col("day").alias("rate_day"), "rate",
    )


def rate_on_day(requests: DataFrame, rates: DataFrame, until: str, spread_by: str) -> DataFrame:
    """Latest quoted rate on or before the requested day; ``shifted`` when it is an earlier day."""
    calendar = working_day_calendar(rates, until)
    out = lookup_join(requests, calendar, ["base", "quote", "day"], spread_by)
    early = F.col("day") < F.to_date(F.lit(FIRST_DAILY_DAY))
    return (
        out.withColumn("rate", F.when(~early, F.col("rate")))
        .withColumn("rate_day", F.when(~early, F.col("rate_day")))
        .withColumn("shifted", F.coalesce(F.col("rate_day") < F.col("day"), F.lit(False)))
        .withColumn("error", F.when(early, F.lit("before_first_daily_rate")).when(F.col("rate").isNull(), F.lit("rate_unavailable")))
    )


def annual_rate_table(official: DataFrame, currency_economy: DataFrame) -> DataFrame:
    """(currency, year, usd_per_unit): reciprocal of local currency per USD, and the latest year's row."""
    priced = official.filter(F.col("value").isNotNull() & (F.col("value") != 0)).join(currency_economy, "iso3")
    rows = priced.select("currency", "year", (F.lit(1.0) / F.col("value")).alias("usd_per_unit"))
    latest = rows.groupBy("currency").agg(F.max(F.struct("year", "usd_per_unit")).alias("l"))
    span = rows.groupBy("currency").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return rows.join(span, "currency").join(latest.select("currency", F.col("l.usd_per_unit").alias("latest_usd_per_unit")), "currency")


def fx_convert(
    requests: DataFrame,
    daily: DataFrame,
    official: DataFrame,
    currency_economy: DataFrame,
    daily_currencies: list[str],
    until: str,
) -> DataFrame:
    """Convert ``requests(request_id, amount, base, quote, date)``.

    ``date`` is NULL (latest), ``YYYY`` or ``YYYY-MM-DD``.  ``daily`` holds EUR-based
    quotes (base, quote, day, rate) with a row EUR->EUR implied.  Pairs inside the
    daily set use daily or annual-mean rates; every other pair goes through USD with
    the best leg available: a daily rate for a daily currency when no year was
    forced, else the annual official rate of the requested year.
    """
    asked = (
        requests.withColumn("base", F.upper(F.trim("base")))
        .withColumn("quote", F.upper(F.trim("quote")))
        .withColumn("forced_year", F.when(F.length("date") == 4, F.col("date").try_cast("int")))
        .withColumn("day", F.when(F.length("date") == 10, F.try_to_date("date", "yyyy-MM-dd")))
    )
    bad = (
        F.when(F.col("amount").isNull() | F.isnan("amount"), "amount_not_a_number")
        .when(~F.col("base").rlike("^[A-Z]{3}$") | ~F.col("quote").rlike("^[A-Z]{3}$"), "malformed_currency")
        .when(F.col("date").isNotNull() & ~F.col("date").rlike(DATE_PATTERN), "malformed_date")
        .when((F.length("date") == 10) & F.col("day").isNull(), "malformed_date")
    )
    in_set = F.col("base").isin(daily_currencies) & F.col("quote").isin(daily_currencies)
    route = (
        F.when(bad.isNotNull(), "error")
        .when(F.col("base") == F.col("quote"), "identical")
        .when(in_set & (F.col("forced_year") >= FIRST_DAILY_YEAR), "annual_mean")
        .when(in_set & F.col("forced_year").isNull(), "daily")
        .otherwise("bridge")
    )
    asked = asked.withColumn("error", bad).withColumn("route", route)
    # the rate depends on (base, quote, date) only: work it out once per distinct triple
    pairs = asked.filter(bad.isNull()).select("base", "quote", "date", "forced_year", "day", "route").distinct()

    # EUR-based quotes, one row per currency and calendar day; the last quoted day answers "latest".
    euro = daily.filter((F.col("base") == "EUR") & F.col("rate").isNotNull())
    calendar = working_day_calendar(euro, until).select(F.col("quote").alias("currency"), "day", "rate_day", "rate")
    latest = euro.groupBy(F.col("quote").alias("currency")).agg(F.max(F.struct("day", "rate")).alias("l")).select(
        "currency", F.col("l.day").alias("latest_day"), F.col("l.rate").alias("latest_rate")
    )

    def euro_leg(df: DataFrame, column: str, name: str) -> DataFrame:
        cal = calendar.select(F.col("currency").alias(column), "day", F.col("rate_day").alias(f"{name}_day"), F.col("rate").alias(f"{name}_d"))
        last = latest.select(F.col("currency").alias(column), F.col("latest_day").alias(f"{name}_ld"), F.col("latest_rate").alias(f"{name}_l"))
        out = df.join(cal, [column, "day"], "left").join(last, [column], "left")
        is_eur = F.col(column) == "EUR"
        rate = F.when(is_eur, F.lit(1.0)).when(F.col("day").isNotNull(), F.col(f"{name}_d")).otherwise(F.col(f"{name}_l"))
        on = F.when(F.col("day").isNotNull(), F.col(f"{name}_day")).otherwise(F.col(f"{name}_ld"))
        return out.withColumn(f"{name}_eur", rate).withColumn(f"{name}_on", on).drop(f"{name}_d", f"{name}_l", f"{name}_day", f"{name}_ld")

    usd = latest.filter(F.col("currency") == "USD")
    usd_cal = calendar.filter(F.col("currency") == "USD").select("day", F.col("rate").alias("usd_d"))
    legs = euro_leg(euro_leg(pairs, "base", "b"), "quote", "q").join(usd_cal, "day", "left")
    usd_latest = usd.select(F.col("latest_rate").alias("usd_l")).agg(F.max("usd_l").alias("usd_l")).scalar()
    legs = legs.withColumn("usd_eur", F.when(F.col("day").isNotNull(), F.col("usd_d")).otherwise(usd_latest))

    means = annual_average(_pair_rates(pairs.where("route = 'annual_mean'").select("base", "quote", "forced_year").distinct(), euro)).select("base", "quote", F.col("year").alias("forced_year"), "average", "days")
    legs = legs.join(means, ["base", "quote", "forced_year"], "left")

    annual = annual_rate_table(official, currency_economy)
    legs = legs.withColumn("bridge_year", F.coalesce("forced_year", F.year("day")))

    def annual_leg(df: DataFrame, column: str, name: str) -> DataFrame:
        by_year = annual.select(F.col("currency").alias(column), F.col("year").alias("bridge_year"), F.col("usd_per_unit").alias(f"{name}_y"))
        span = annual.groupBy(F.col("currency").alias(column)).agg(F.max("latest_usd_per_unit").alias(f"{name}_last"), F.max("last_year").alias(f"{name}_ly"))
        return df.join(by_year, [column, "bridge_year"], "left").join(span, [column], "left")

    legs = annual_leg(annual_leg(legs, "base", "b"), "quote", "q")

    def usd_per_unit(column: str, name: str):
        daily_leg = F.col(column).isin(daily_currencies) & F.col("forced_year").isNull()
        official_leg = F.when(F.col("bridge_year").isNotNull(), F.col(f"{name}_y")).otherwise(F.col(f"{name}_last"))
        return F.when(F.col(column) == "USD", F.lit(1.0)).when(daily_leg, F.col("usd_eur") / F.col(f"{name}_eur")).otherwise(official_leg)

    def leg_date(column: str, name: str):
        daily_leg = F.col(column).isin(daily_currencies) & F.col("forced_year").isNull()
        year = F.coalesce("bridge_year", F.col(f"{name}_ly")).cast("string")
        return F.when(F.col(column) == "USD", F.lit(None).cast("string")).when(daily_leg, F.col(f"{name}_on").cast("string")).otherwise(year)

    r = F.col("route")
    rate = (
        F.when(r == "identical", F.lit(1.0))
        .when(r == "annual_mean", F.col("average"))
        .when(r == "daily", F.col("q_eur") / F.col("b_eur"))
        .when(r == "bridge", usd_per_unit("base", "b") / usd_per_unit("quote", "q"))
    )
    daily_legs = [F.col(c).isin(daily_currencies) & (F.col(c) != "USD") for c in ("base", "quote")]
    early = (F.col("day") < F.to_date(F.lit(FIRST_DAILY_DAY))) & ((r == "daily") | ((r == "bridge") & (daily_legs[0] | daily_legs[1])))
    mixed = (
        (r == "bridge") & F.col("forced_year").isNull() & (F.col("base") != "USD") & (F.col("quote") != "USD")
        & (F.col("base").isin(daily_currencies) | F.col("quote").isin(daily_currencies))
    )
    precision = (
        F.when(r.isin("identical", "daily"), "daily").when(mixed, "mixed").when(r.isin("annual_mean", "bridge"), "annual_average")
    )
    rate_date = (
        F.when(r == "identical", F.coalesce("date", F.lit("n/a")))
        .when(r == "annual_mean", F.col("forced_year").cast("string"))
        .when(r == "daily", F.coalesce(F.least("b_on", "q_on"), F.col("b_on"), F.col("q_on")).cast("string"))
        .when(r == "bridge", F.coalesce(leg_date("base", "b"), leg_date("quote", "q")))
    )
    priced = legs.select(
        "base", "quote", "date",
        F.when(~F.coalesce(early, F.lit(False)), rate).alias("rate"),
        F.when(early, F.lit("before_first_daily_rate")).when(rate.isNull(), F.lit("no_rate_for_period")).alias("rate_error"),
        rate_date.alias("rate_date"),
        precision.alias("precision"),
    )
    out = null_safe_lookup_join(asked, priced, ["base", "quote", "date"], "request_id")
    out = out.withColumn("error", F.coalesce("error", "rate_error"))
    good = F.col("error").isNull()
    return out.select(
        "request_id", "amount", "base", "quote", "date", "route",
        F.when(good, F.round("rate", 8)).alias("rate"),
        F.when(good, F.round(F.col("amount") * F.col("rate"), 6)).alias("converted_amount"),
        F.when(good, F.col("rate_date")).alias("rate_date"),
        F.when(good, F.col("precision")).alias("precision"),
        "error",
    )


def _pair_rates(pairs: DataFrame, euro: DataFrame) -> DataFrame:
    """Daily cross rates of the asked (base, quote, forced_year) only, through the EUR quotes of that year."""
    quoted = euro.select(F.col("quote").alias("currency"), "day", F.col("rate").cast("double").alias("rate"))
    unit = quoted.select(F.lit("EUR").alias("currency"), "day", F.lit(1.0).alias("rate")).distinct()
    days = quoted.union(unit).withColumn("forced_year", F.year("day"))
    base = pairs.join(days.select(F.col("currency").alias("base"), "forced_year", "day", F.col("rate").alias("_b")), ["base", "forced_year"])
    both = base.join(days.select(F.col("currency").alias("quote"), "day", F.col("rate").alias("_q")), ["quote", "day"])
    return both.select("base", "quote", "day", (F.col("_q") / F.col("_b")).alias("rate"))


def adjust_for_prices(requests: DataFrame, cpi: DataFrame) -> DataFrame:
    """amount x CPI(to) / CPI(from) for ``requests(request_id, amount, iso3, from_year, to_year)``.

    Missing years are named together with the range the index covers.
    """
    index = cpi.filter(F.col("value").isNotNull()).groupBy("iso3", "year").agg(F.max("value").alias("value"))
    span = index.groupBy("iso3").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    spans = requests.select("iso3", "from_year", "to_year").distinct()
    spans = (
        spans.join(index.select("iso3", F.col("year").alias("from_year"), F.col("value").alias("from_index")), ["iso3", "from_year"], "left")
        .join(index.select("iso3", F.col("year").alias("to_year"), F.col("value").alias("to_index")), ["iso3", "to_year"], "left")
        .join(span, "iso3", "left")
    )
    out = lookup_join(requests, spans, ["iso3", "from_year", "to_year"], "request_id")
    missing = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("from_index").isNull(), F.col("from_year").cast("string")),
                F.when(F.col("to_index").isNull(), F.col("to_year").cast("string")),
            )
        ),
        ",",
    )
    factor = F.col("to_index") / F.col("from_index")
    return out.select(
        "request_id", "iso3", "from_year", "to_year", "amount",
        F.round(F.col("amount") * factor, 6).alias("adjusted_amount"), F.round(factor, 6).alias("factor"),
        F.when(missing != "", missing).alias("missing_years"), "first_year", "last_year",
        F.when(F.col("first_year").isNull(), F.lit("no_index_for_economy")).when(missing != "", F.lit("year_not_covered")).alias("error"),
    )
