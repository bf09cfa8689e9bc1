"""Statistical inputs derived from the given tables.

The tables hold orders, customers, events and texts rather than economic series, so
each query derives what its operator needs: nations act as economies, yearly order
totals as official figures, single orders as claims or answers, events as usage.
``cte.py`` states the same derivations in SQL for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDICATORS = ["order_value", "order_count", "urgent_share", "price_index"]
KINDS = {"order_value": "level", "order_count": "level", "urgent_share": "percent", "price_index": "index"}
DATED = ["order_value", "order_count"]
EDITIONS = [f"{y}-{m}" for y in range(1996, 2002) for m in ("04", "10")]
TODAY = "2001-12-15"
FACTORS = [1.0, 1.003, 1.03, 1.2, 100.0, 0.001, -1.0, 1.0, 1.0]
MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def nation_code(key) -> F.Column:
    return F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0"))


def customer_code(key) -> F.Column:
    return F.concat(F.lit("C"), key.cast("string"))


def money(col: str) -> F.Column:
    """Exact sum of two-decimal amounts, independent of the order of addition."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


class Tables:
    """Given tables as DataFrames plus the derived inputs, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    orders = cached_property(lambda self: self.read("orders"))
    customer = cached_property(lambda self: self.read("customer"))
    lineitem = cached_property(lambda self: self.read("lineitem"))
    nation = cached_property(lambda self: self.read("nation"))
    region = cached_property(lambda self: self.read("region"))
    part = cached_property(lambda self: self.read("part"))
    supplier = cached_property(lambda self: self.read("supplier"))
    events = cached_property(lambda self: self.read("events"))
    documents = cached_property(lambda self: self.read("documents"))
    conversations = cached_property(lambda self: self.read("conversations"))
    pages = cached_property(lambda self: self.read("pages"))
    labels = cached_property(lambda self: self.read("labels"))

    # --- official series ------------------------------------------------------

    def orders_by_nation(self) -> DataFrame:
        o = self.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
        c = self.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nk"))
        return o.join(c, "o_custkey").withColumn("year", F.year("o_orderdate"))

    @cached_property
    def nation_months(self) -> DataFrame:
        """Orders per nation and month, written to a durable checkpoint.

        Everything official below (yearly figures, dated editions) is a regrouping of
        this table, so the orders are read once however often a plan looks it up.  It
        has one row per nation and month whatever the number of orders.
        """
        from econcheck.plans.durable import cut_lineage

        o = self.orders_by_nation()
        return cut_lineage(
            o.groupBy("nk", "year", F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(
                F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count("*").alias("n"),
                F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            )
        )

    def annual_wide(self) -> DataFrame:
        g = self.nation_months.groupBy("nk", "year").agg(
            F.sum("v").cast("double").alias("order_value"), F.sum("n").cast("double").alias("order_count"), F.sum("urgent").cast("double").alias("_urgent")
        )
        return g.select(
            "nk", nation_code(F.col("nk")).alias("iso3"), "year", "order_value", "order_count",
            (F.lit(100.0) * F.col("_urgent") / F.col("order_count")).alias("urgent_share"),
            (F.col("order_value") / F.col("order_count")).alias("price_index"),
        )

    def annual(self) -> DataFrame:
        """nk, iso3, indicator, period, year, value."""
        return self.annual_wide().select(
            "nk", "iso3", "year", F.col("year").cast("string").alias("period"),
            F.explode(F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("value")) for i in INDICATORS])).alias("e"),
        ).select("nk", "iso3", "e.indicator", "period", "year", "e.value")

    def observations(self) -> DataFrame:
        """Two sources: wdi lacks every seventh nation; the IMF one is dated and 1% apart."""
        none = F.lit(None).cast("string")
        wdi = F.when(F.col("nk") % 7 != 0, F.struct(F.lit("wdi").alias("source"), F.col("value").alias("value"), none.alias("note")))
        imf = F.when(
            F.col("indicator").isin(DATED),
            F.struct(
                F.lit("imf_datamapper").alias("source"), (F.col("value") * 1.01).alias("value"),
                F.when(F.col("year") >= 2000, F.lit("IMF WEO estimate/projection")).alias("note"),
            ),
        )
        rows = self.annual().withColumn("s", F.explode(F.array_compact(F.array(wdi, imf))))
        return rows.select("s.source", "indicator", "iso3", "nk", "period", "year", "s.value", "s.note")

    def shipments(self) -> DataFrame:
        """Third source from shipped lines: iso3, year, value."""
        li = self.lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("v"))
        per_order = li.groupBy("l_orderkey").agg(F.sum("v").alias("v"))
        o = self.orders_by_nation().select(F.col("o_orderkey").alias("l_orderkey"), "nk", "year")
        g = per_order.join(o, "l_orderkey").groupBy("nk", "year").agg(F.sum("v").cast("double").alias("value"))
        return g.select("nk", nation_code(F.col("nk")).alias("iso3"), "year", F.col("year").cast("string").alias("period"), "value")

    def chain(self) -> DataFrame:
        rows = [(i, s, p) for i in INDICATORS for p, s in enumerate(["wdi"] + (["imf_datamapper"] if i in DATED else []), 1)]
        return self.spark.createDataFrame(rows, "indicator string, source string, priority int")

    def indicators(self) -> DataFrame:
        rows = [(i, KINDS[i], i == "price_index", True, i in DATED) for i in INDICATORS]
        return self.spark.createDataFrame(rows, "indicator string, kind string, modeled boolean, active boolean, has_editions boolean")

    def availability(self) -> DataFrame:
        """The wdi load failed for every fifth nation (offset 3)."""
        down = self.nation.filter(F.col("n_nationkey") % 5 == 3)
        return down.select(
            F.lit("wdi").alias("source"), F.explode(F.array(*[F.lit(i) for i in INDICATORS])).alias("indicator"),
            nation_code(F.col("n_nationkey")).alias("iso3"), F.lit("transient").alias("status"),
        )

    def editions(self) -> DataFrame:
        """Dated archive: what was known before each April and October."""
        known = F.filter(F.array(*[F.lit(e) for e in EDITIONS]), lambda e: e > F.col("ym"))
        g = self.nation_months.withColumn("edition", F.explode(known)).groupBy("nk", "year", "edition").agg(
            F.sum("v").cast("double").alias("order_value"), F.sum("n").cast("double").alias("order_count")
        )
        revised = F.when((F.col("edition") == "2001-04") & (F.col("nk") % 3 == 0), F.lit(1.2)).otherwise(F.lit(1.0))
        return g.select(
            "edition", nation_code(F.col("nk")).alias("iso3"), F.col("year").cast("string").alias("period"), "year",
            F.explode(F.array(*[F.struct(F.lit(i).alias("indicator"), (F.col(i) * revised).alias("value")) for i in DATED])).alias("e"),
        ).select("edition", "e.indicator", "iso3", "period", "year", "e.value", F.lit(None).cast("string").alias("note"))

    def claims(self) -> DataFrame:
        """One claim per order about its nation and year; the factor decides what is wrong with it.

        Claims are a table to the operators, which look at its keys before they join it, so
        it is written once per query.
        """
        return self._claims

    @cached_property
    def _claims(self) -> DataFrame:
        from econcheck.plans.durable import cut_lineage

        k, key = F.col("k"), F.col("o_orderkey")
        base = self.orders_by_nation().select("o_orderkey", "nk", "year").withColumn("k", ((key + F.col("year")) % 9).cast("int"))
        base = base.withColumn("indicator", F.element_at(F.array(*[F.lit(i) for i in INDICATORS]), (key % 4 + 1).cast("int")))
        official = self.annual().select("nk", "year", "indicator", "value")
        c = base.join(official, ["nk", "year", "indicator"])
        factor = F.element_at(F.array(*[F.lit(f) for f in FACTORS]), k + 1)
        year = F.when(k == 7, F.col("year") - 1).when(k == 8, F.col("year") + 20).otherwise(F.col("year"))
        return cut_lineage(c.select(
            key.alias("claim_id"), "indicator", nation_code(F.col("nk")).alias("iso3"), nation_code(F.col("nk")).alias("country"),
            year.cast("string").alias("period"), (F.col("value") * factor).alias("claimed_value"),
            F.when(key % 17 == 0, F.lit(1.0)).alias("tolerance_abs"), F.when(key % 13 == 0, F.lit(25.0)).alias("tolerance_pct"),
            F.when((key % 11 == 0) & F.col("indicator").isin(DATED), F.concat((F.col("year") + 1).cast("string"), F.lit("-06"))).alias("as_of"),
        ))

    # --- long series ------------------------------------------------------------

    def monthly(self) -> DataFrame:
        """Per-customer monthly series with natural gaps and some NULL values."""
        g = self.orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(money("o_totalprice").alias("v"))
        month = F.substring("period", 6, 2).cast("int")
        return g.select(
            customer_code(F.col("o_custkey")).alias("iso3"), "period", F.substring("period", 1, 4).cast("int").alias("year"),
            F.when((F.col("o_custkey") + month) % 11 != 0, F.col("v")).alias("value"),
            F.when(F.col("period") >= "2000-01", F.lit("IMF WEO estimate/projection")).alias("note"),
        )

    def customer_annual(self) -> DataFrame:
        """Per-customer yearly totals: custkey, iso3, year, value, n."""
        g = self.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(money("o_totalprice").alias("value"), F.count("*").alias("n"))
        return g.select(F.col("o_custkey").alias("custkey"), customer_code(F.col("o_custkey")).alias("iso3"), "year", "value", "n")

    @cached_property
    def frozen_customer_annual(self) -> DataFrame:
        """``customer_annual`` behind a durable checkpoint, for plans that look it up several times."""
        from econcheck.plans.durable import cut_lineage

        return cut_lineage(self.customer_annual())

    # --- money ---------------------------------------------------------------------

    def daily_quotes(self) -> DataFrame:
        """EUR-based daily rates per event type, weekdays only."""
        code = F.upper(F.substring("event_type", 1, 3))
        e = self.events.select(code.alias("quote"), F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("v"))
        g = e.filter(F.weekday("day") < 5).groupBy("quote", "day").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
        return g.select(F.lit("EUR").alias("base"), "quote", "day", (F.col("s").cast("double") / F.col("n")).alias("rate"))
