"""Queries on names, search texts and declared units."""

from __future__ import annotations

from pyspark.sql import functions as F

from econcheck.dims import economies, ledger, registry
from econcheck.functions import text as N
from econcheck.functions import units as U
from econcheck.operators import resolve as R
from econcheck.plans.joins import dim_join
from econcheck.queries.cte import sql
from econcheck.queries.inputs import Tables, nation_code
from econcheck.queries.registry import query


def _economies(t: Tables):
    """Suppliers act as named economies: code, name with a qualifier, one alias."""
    key = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("S"), key.cast("string")).alias("iso3"), F.concat(F.lit("X"), key.cast("string")).alias("iso2"),
        F.concat(F.lit("Trader "), F.lpad(F.sha2(key.cast("string"), 256), 6, "0"), F.lit(", Rep.")).alias("name"),
        F.array(F.concat(F.lit("House Of "), F.substring(F.sha2(key.cast("string"), 256), 7, 5))).alias("aliases"),
    )


_ECON = """SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS iso3, left(sha256(CAST(s_suppkey AS VARCHAR)), 6) AS core,
    substr(sha256(CAST(s_suppkey AS VARCHAR)), 7, 5) AS nick FROM supplier"""


def _typed_names(t: Tables):
    """A name as somebody typed it, per shipped line: right, short, alias, swapped, one letter off, or nonsense."""
    core = F.substring(F.sha2(F.col("l_suppkey").cast("string"), 256), 1, 6)
    nick = F.substring(F.sha2(F.col("l_suppkey").cast("string"), 256), 7, 5)
    k = F.col("l_orderkey") % 6
    typed = (
        F.when(k == 0, F.concat(F.lit(" TRADER "), core, F.lit(" rep")))
        .when(k == 1, F.concat(F.lit("trader "), core))
        .when(k == 2, F.concat(F.lit("house-of  "), nick))
        .when(k == 3, F.concat(F.lit("Trdaer "), core, F.lit(" Rep")))
        .when(k == 4, F.concat(F.lit("the trader "), core, F.lit(" rep of old")))
        .otherwise(F.lit("zzqq unknown place"))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", typed.alias("typed"))


@query(
    "j16_resolve_names",
    sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 6 <> 5 THEN 'S' || CAST(l_suppkey AS VARCHAR) END AS iso3 FROM lineitem"""),
)
def j16(t: Tables):
    out = R.resolve_names(_typed_names(t), "typed", _economies(t), "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "iso3")


@query(
    "j17_suggestions",
    sql("""SELECT o_comment AS name, CAST(rn AS INTEGER) AS position, n_name AS iso3, score FROM (
          SELECT q.o_comment, e.n_name, CASE WHEN starts_with(e.key, q.key) OR starts_with(q.key, e.key) THEN 3 WHEN contains(e.key, q.key) OR contains(q.key, e.key) THEN 2
              WHEN len(list_filter(string_split(q.key, ' '), lambda w: length(w) > 2 AND contains(e.key, w))) > 0 THEN 1 ELSE 0 END AS score,
              row_number() OVER (PARTITION BY q.o_comment ORDER BY score DESC, e.n_name) AS rn
          FROM (SELECT DISTINCT p_name AS o_comment, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part) q
          CROSS JOIN (SELECT n_name, lower(n_name) AS key FROM (SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 2) || ' ' || p_brand AS n_name FROM part)
                      ) e0(n_name, key0) CROSS JOIN LATERAL (SELECT trim(regexp_replace(regexp_replace(key0, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key, e0.n_name) e)
        WHERE score > 0 AND rn <= 5"""),
)
def j17(t: Tables):
    label = F.concat_ws(" ", F.col("p_type"), F.element_at(F.split("p_name", " "), 2), F.col("p_brand"))
    economies = t.part.select(label.alias("name")).distinct().withColumn("iso3", F.col("name"))
    s = R.suggest(t.part.select(F.col("p_name").alias("name")).distinct(), economies)
    return s.select("name", "position", "iso3", "score")


_PLACES = sorted({*economies.SIDS, *economies.POLICY_RATE_AREAS, *economies.CURRENCY_ECONOMY.values()})
_PLACE_LIST = "[" + ", ".join(f"'{c}'" for c in _PLACES) + "]"


def _place(key) -> F.Column:
    """One of the stated economies for a key."""
    return F.element_at(F.array(*[F.lit(c) for c in _PLACES]), (key % len(_PLACES) + 1).cast("int"))


@query(
    "j18_group_members",
    sql(f"""SELECT custkey, place AS iso3, year, round(value, 4) AS value FROM (SELECT *, ({_PLACE_LIST})[custkey % {len(_PLACES)} + 1] AS place FROM customer_annual)
        WHERE place IN ({", ".join(f"'{c}'" for c in economies.SIDS)})"""),
)
def j18(t: Tables):
    placed = t.customer_annual().withColumn("iso3", _place(F.col("custkey")))
    return economies.members(placed, economies.SIDS).select("custkey", "iso3", "year", F.round("value", 4).alias("value"))


def _values(rows, names: str) -> str:
    def text(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


@query(
    "s8_dimensions",
    sql(
        f"""SELECT i.key AS indicator, i.kind, i.unit, s.source, l.license_verdict, l.attribution IS NOT NULL AS attributed, count(*) AS orders, count(a.area) AS with_area, count(c.currency) AS with_currency,
               coalesce(min(c.currency), '') AS first_currency
        FROM (SELECT o_orderkey % {len(registry.INDICATORS)} AS ordinal, ({_PLACE_LIST})[o_custkey % {len(_PLACES)} + 1] AS iso3 FROM orders) o
        JOIN reg8 i ON i.ordinal = o.ordinal LEFT JOIN chain8 s ON s.key = i.key LEFT JOIN ledger8 l ON l.source = s.source LEFT JOIN areas8 a ON a.iso3 = o.iso3
        LEFT JOIN (SELECT iso3, min(currency) AS currency FROM currencies8 GROUP BY iso3) c ON c.iso3 = o.iso3
        GROUP BY ALL""",
        reg8=_values([(i, d["key"], d["kind"], d["unit"]) for i, d in enumerate(registry.INDICATORS)], "ordinal, key, kind, unit"),
        chain8=_values([(d["key"], registry.chain_of(d)[0][0]) for d in registry.INDICATORS if registry.chain_of(d)], "key, source"),
        ledger8=_values([(r[0], r[3], r[5]) for r in ledger.SOURCES], "source, license_verdict, attribution"),
        areas8=_values(list(economies.POLICY_RATE_AREAS.items()), "iso3, area"),
        currencies8=_values(list(economies.CURRENCY_ECONOMY.items()), "currency, iso3"),
    ),
)
def s8(t: Tables):
    """Registry, chains, licence ledger, areas and currencies, each joined to the orders as a table."""
    spark = t.spark
    asked = t.orders.select((F.col("o_orderkey") % len(registry.INDICATORS)).cast("int").alias("ordinal"), _place(F.col("o_custkey")).alias("iso3"))
    listed = registry.indicator_table(spark).select("ordinal", "indicator", "kind", "unit")
    first = registry.source_table(spark).where("priority = 1").select("indicator", "source")
    licence = ledger.ledger_table(spark).select("source", "license_verdict", "attribution")
    money = economies.currency_economies(spark).groupBy("iso3").agg(F.min("currency").alias("currency"))
    rows = dim_join(dim_join(dim_join(asked, listed, ["ordinal"], "inner"), first, ["indicator"]), licence, ["source"])
    rows = dim_join(dim_join(rows, economies.policy_rate_areas(spark), ["iso3"]), money, ["iso3"])
    return rows.groupBy("indicator", "kind", "unit", "source", "license_verdict", F.col("attribution").isNotNull().alias("attributed")).agg(
        F.count("*").alias("orders"), F.count("area").alias("with_area"), F.count("currency").alias("with_currency"), F.coalesce(F.min("currency"), F.lit("")).alias("first_currency")
    )


@query(
    "c1_name_key",
    sql(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[̀-ͯ]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))) AS key_md5 FROM documents"""),
)
def c1(t: Tables):
    return t.documents.select("doc_id", F.md5(N.name_key(F.col("text"))).alias("key_md5"))


@query(
    "c2_one_edit",
    sql("""SELECT a.p_partkey, damerau_levenshtein(a.p_name, b.p_name) <= 1 AS near FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""),
)
def c2(t: Tables):
    a = t.part.select("p_partkey", "p_name")
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", N.within_one_edit(F.col("p_name"), F.col("other")).alias("near"))


_REG = ", ".join(
    "({}, '{}', '{}', [{}])".format(
        i, d["key"], " | ".join([d["key"].replace("_", " "), d["label"].lower(), *d["synonyms"]]).replace("'", "''"),
        ", ".join("'" + s.replace("'", "''") + "'" for s in d["synonyms"]),
    )
    for i, d in enumerate(registry.INDICATORS)
)
_HITS = r"""SELECT q.id, r.ordinal, r.key, (CASE WHEN r.key = regexp_replace(q.q, '\s+', '_', 'g') THEN 100 ELSE 0 END)
        + len(list_filter(r.syn, lambda s: s = q.q)) * 60 + (CASE WHEN contains(r.hay, q.q) THEN 25 ELSE 0 END)
        + len(list_filter(string_split_regex(q.q, '\s+'), lambda w: length(w) > 1 AND contains(r.hay, w))) * 8 AS score
    FROM (SELECT id, trim(regexp_replace(lower(query), '[^a-z0-9% ]+', ' ', 'g')) AS q FROM texts) q CROSS JOIN reg r WHERE q.q <> ''"""
_TEXTS = """SELECT event_id AS id, (['inflation rate', 'government debt', 'GDP per capita', 'jobless rate', 'trade (% of GDP)', 'remittances', 'us cpi'])[user_id % 7 + 1]
    || ' ' || event_type || (CASE WHEN event_id % 3 = 0 THEN ' growth' ELSE '' END) AS query FROM events"""


def _search_texts(t: Tables):
    base = F.array(*[F.lit(x) for x in ("inflation rate", "government debt", "GDP per capita", "jobless rate", "trade (% of GDP)", "remittances", "us cpi")])
    text = F.concat(
        F.element_at(base, (F.col("user_id") % 7 + 1).cast("int")), F.lit(" "), F.col("event_type"),
        F.when(F.col("event_id") % 3 == 0, F.lit(" growth")).otherwise(F.lit("")),
    )
    return t.events.select(F.col("event_id").alias("id"), text.alias("query"))


@query(
    "t3_indicator_search",
    sql("""SELECT id, CAST(rn AS INTEGER) AS position, key AS indicator, CAST(score AS INTEGER) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ordinal) AS rn FROM hits WHERE score > 0) WHERE rn <= 8""",
        hits=_HITS, texts=_TEXTS, reg=f"SELECT * FROM (VALUES {_REG}) AS r(ordinal, key, hay, syn)"),
)
def t3(t: Tables):
    return R.search_indicators(_search_texts(t), "query", "id")


@query(
    "t4_country_in_text",
    sql("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'N' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') WHEN 1 THEN 'N' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0')
          WHEN 2 THEN 'N' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') ELSE 'WLD' END AS iso3 FROM events"""),
)
def t4(t: Tables):
    # nation names spelled with letters, so a digit typo cannot name a neighbour
    words = F.translate(F.sha2(F.col("n_nationkey").cast("string"), 256), "0123456789", "ghijklmnop")
    name = F.concat(F.substring(words, 1, 8), F.lit(" "), F.substring(words, 9, 8))
    economies = t.nation.select(nation_code(F.col("n_nationkey")).alias("iso3"), F.upper(F.substring(words, 20, 2)).alias("iso2"), name.alias("name"),
                                F.array(F.concat(F.lit("old "), F.substring(words, 30, 6))).alias("aliases"))
    key = (F.col("user_id") % 25).cast("string")
    w = F.translate(F.sha2(key, 256), "0123456789", "ghijklmnop")
    k = F.col("event_id") % 4
    place = (
        F.when(k == 0, F.concat(F.initcap(F.substring(w, 1, 8)), F.lit(" "), F.substring(w, 9, 8)))
        .when(k == 1, F.concat(F.lit("N"), F.lpad(key, 2, "0")))
        .when(k == 2, F.concat(F.lit("Old "), F.substring(w, 30, 6)))
        .otherwise(F.lit("nowhere"))
    )
    texts = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("rate for "), place, F.lit("  in "), F.col("event_type")).alias("query"))
    return R.extract_country(texts, "query", "id", economies)


_UNITS = ["% of GDP", "percent", "bps", "US$ billions", "millions of people", "ratio", "percent ratio", "EUR millions", "current US$ (mn)", "per capita usd", "", "years", "widgets"]


@query(
    "c3_declared_unit",
    sql("""SELECT o_orderkey, CASE u WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN p WHEN 5 THEN p WHEN 6 THEN FALSE WHEN 3 THEN NOT p WHEN 4 THEN NOT p WHEN 8 THEN NOT p WHEN 11 THEN NOT p ELSE FALSE END AS ok,
          CASE WHEN p THEN CASE u WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.01 WHEN 5 THEN 100.0 END
               ELSE CASE u WHEN 3 THEN 1e9 WHEN 4 THEN 1e6 WHEN 8 THEN 1e6 WHEN 11 THEN 1.0 END END::DOUBLE AS factor,
          CASE WHEN u = 10 THEN 'unit_missing_or_not_string'
               WHEN p THEN CASE WHEN u IN (0, 1, 2, 5) THEN NULL WHEN u = 6 THEN 'ambiguous_percent_and_ratio' ELSE 'kind_mismatch_expected_percent' END
               ELSE CASE WHEN u IN (0, 1, 2, 5, 6) THEN 'kind_mismatch_expected_level' WHEN u = 7 THEN 'rejected_token:eur' WHEN u = 9 THEN 'rejected_token:per' WHEN u = 12 THEN 'unknown_token:widgets' END END AS reason
        FROM (SELECT o_orderkey, o_orderkey % 13 AS u, o_custkey % 2 = 0 AS p FROM orders)"""),
)
def c3(t: Tables):
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("o_orderkey") % 13 + 1).cast("int"))
    kind = F.when(F.col("o_custkey") % 2 == 0, F.lit("percent")).otherwise(F.lit("level"))
    return t.orders.select("o_orderkey", U.declared_unit(unit, kind).alias("u")).select("o_orderkey", "u.ok", "u.factor", "u.reason")


@query(
    "c4_natural_scale",
    sql("""SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN v < 1e6 THEN 'thousands of people' ELSE 'millions of people' END
          WHEN 1 THEN CASE WHEN v < 1e10 THEN 'millions of US dollars' ELSE 'billions of US dollars' END WHEN 2 THEN 'years' END AS label,
          CASE k WHEN 0 THEN CASE WHEN v < 1e6 THEN 1e3 ELSE 1e6 END WHEN 1 THEN CASE WHEN v < 1e10 THEN 1e6 ELSE 1e9 END WHEN 2 THEN 1.0 END::DOUBLE AS factor
        FROM (SELECT o_orderkey, o_orderkey % 4 AS k, o_totalprice * (CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 1e5 END)::DOUBLE AS v FROM orders)"""),
)
def c4(t: Tables):
    keys = F.array(F.lit("population"), F.lit("gdp_current_usd"), F.lit("life_expectancy"), F.lit("inflation_cpi"))
    v = F.col("o_totalprice") * F.when(F.col("o_custkey") % 2 == 0, F.lit(1.0)).otherwise(F.lit(1e5))
    s = U.natural_scale(F.element_at(keys, (F.col("o_orderkey") % 4 + 1).cast("int")), v)
    return t.orders.select("o_orderkey", s["label"].alias("label"), s["factor"].alias("factor"))


@query(
    "c12_question_text",
    sql("""SELECT o_orderkey, 'What was the order value of Customer#' || CAST(o_custkey AS VARCHAR) || ' in ' || strftime(o_orderdate, '%Y') || ' (' ||
          CASE WHEN o_totalprice < 200000 THEN 'thousands' ELSE '' END || ')?' AS question FROM orders"""),
)
def c12(t: Tables):
    template = F.lit("What was the order value of {COUNTRY} in {YEAR} ({UNIT_HINT})?")
    q = N.fill_template(
        template,
        {"COUNTRY": F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")), "YEAR": F.year("o_orderdate"),
         "UNIT_HINT": F.when(F.col("o_totalprice") < 200000, F.lit("thousands"))},
    )
    return t.orders.select("o_orderkey", q.alias("question"))


@query(
    "c13_figure_format",
    sql("""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN format('{:,}', CAST(round(l_quantity * 1000003) AS BIGINT))
          ELSE regexp_replace(regexp_replace(format('{:,}', CAST(floor(l_quantity * 37) AS BIGINT)) || '.' || lpad(CAST(CAST(l_discount * 100 AS INTEGER) AS VARCHAR), 2, '0'), '0+$', ''), '\\.$', '') END AS shown FROM lineitem"""),
)
def c13(t: Tables):
    big = F.col("l_quantity") * 1000003
    small = F.floor(F.col("l_quantity") * 37) + F.round(F.col("l_discount"), 2)
    v = F.when(F.col("l_linenumber") % 2 == 0, big).otherwise(small)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", N.format_figure(v).alias("shown"))
