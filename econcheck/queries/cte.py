"""The derivations of ``inputs.py`` in SQL."""

from __future__ import annotations

import re

INDICATOR_LIST = "('order_value'), ('order_count'), ('urgent_share'), ('price_index')"
EDITION_LIST = ", ".join(f"('{y}-{m}')" for y in range(1996, 2002) for m in ("04", "10"))

CTES = {
    "obn": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, c_nationkey AS nk,
               CAST(year(o_orderdate) AS INTEGER) AS year
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "annual_wide": """
        SELECT nk, 'N' || lpad(CAST(nk AS VARCHAR), 2, '0') AS iso3, year, order_value, order_count,
               100.0::DOUBLE * urgent / order_count AS urgent_share, order_value / order_count AS price_index
        FROM (SELECT nk, year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value,
                     CAST(count(*) AS DOUBLE) AS order_count,
                     CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS urgent
              FROM obn GROUP BY nk, year)""",
    "annual": f"""
        SELECT nk, iso3, indicator, CAST(year AS VARCHAR) AS period, year,
               CASE indicator WHEN 'order_value' THEN order_value WHEN 'order_count' THEN order_count
                    WHEN 'urgent_share' THEN urgent_share ELSE price_index END AS value
        FROM annual_wide CROSS JOIN (VALUES {INDICATOR_LIST}) AS i(indicator)""",
    "obs": """
        SELECT 'wdi' AS source, indicator, iso3, nk, period, year, value, CAST(NULL AS VARCHAR) AS note
        FROM annual WHERE nk % 7 <> 0
        UNION ALL
        SELECT 'imf_datamapper', indicator, iso3, nk, period, year, value * 1.01::DOUBLE,
               CASE WHEN year >= 2000 THEN 'IMF WEO estimate/projection' END
        FROM annual WHERE indicator IN ('order_value', 'order_count')""",
    "shipments": """
        SELECT nk, 'N' || lpad(CAST(nk AS VARCHAR), 2, '0') AS iso3, year, CAST(year AS VARCHAR) AS period,
               CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS value
        FROM lineitem JOIN obn ON l_orderkey = o_orderkey GROUP BY nk, year""",
    "chain": """
        SELECT * FROM (VALUES ('order_value', 'wdi', 1), ('order_value', 'imf_datamapper', 2), ('order_count', 'wdi', 1),
            ('order_count', 'imf_datamapper', 2), ('urgent_share', 'wdi', 1), ('price_index', 'wdi', 1)) AS c(indicator, source, priority)""",
    "indicators": """
        SELECT * FROM (VALUES ('order_value', 'level', FALSE, TRUE), ('order_count', 'level', FALSE, TRUE),
            ('urgent_share', 'percent', FALSE, FALSE), ('price_index', 'index', TRUE, FALSE)) AS i(indicator, kind, modeled, has_editions)""",
    "editions": f"""
        SELECT edition, indicator, iso3, CAST(year AS VARCHAR) AS period, year,
               (CASE indicator WHEN 'order_value' THEN v ELSE n END)
               * (CASE WHEN edition = '2001-04' AND nk % 3 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS value
        FROM (SELECT nk, 'N' || lpad(CAST(nk AS VARCHAR), 2, '0') AS iso3, year, edition,
                     CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n
              FROM obn JOIN (VALUES {EDITION_LIST}) AS e(edition) ON strftime(o_orderdate, '%Y-%m') < edition
              GROUP BY nk, year, edition)
        CROSS JOIN (VALUES ('order_value'), ('order_count')) AS i(indicator)""",
    "claims": """
        SELECT o_orderkey AS claim_id, b.indicator, b.nk, a.iso3,
               CAST(CASE k WHEN 7 THEN b.year - 1 WHEN 8 THEN b.year + 20 ELSE b.year END AS INTEGER) AS year,
               CAST(CASE k WHEN 7 THEN b.year - 1 WHEN 8 THEN b.year + 20 ELSE b.year END AS VARCHAR) AS period,
               a.value * (CASE k WHEN 1 THEN 1.003::DOUBLE WHEN 2 THEN 1.03::DOUBLE WHEN 3 THEN 1.2::DOUBLE WHEN 4 THEN 100.0::DOUBLE
                          WHEN 5 THEN 0.001::DOUBLE WHEN 6 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS claimed_value,
               CASE WHEN o_orderkey % 17 = 0 THEN 1.0::DOUBLE END AS tolerance_abs,
               CASE WHEN o_orderkey % 13 = 0 THEN 25.0::DOUBLE END AS tolerance_pct,
               CASE WHEN o_orderkey % 11 = 0 AND b.indicator IN ('order_value', 'order_count')
                    THEN CAST(b.year + 1 AS VARCHAR) || '-06' END AS as_of
        FROM (SELECT o_orderkey, nk, year, (o_orderkey + year) % 9 AS k,
                     (['order_value', 'order_count', 'urgent_share', 'price_index'])[o_orderkey % 4 + 1] AS indicator FROM obn) b
        JOIN annual a ON a.nk = b.nk AND a.year = b.year AND a.indicator = b.indicator""",
    "monthly": """
        SELECT 'C' || CAST(o_custkey AS VARCHAR) AS iso3, period, CAST(substr(period, 1, 4) AS INTEGER) AS year,
               CASE WHEN (o_custkey + CAST(substr(period, 6, 2) AS INTEGER)) % 11 <> 0 THEN v END AS value,
               CASE WHEN period >= '2000-01' THEN 'IMF WEO estimate/projection' END AS note,
               CAST(substr(period, 1, 4) AS INTEGER) * 12 + CAST(substr(period, 6, 2) AS INTEGER) - 1 AS idx
        FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS period,
                     CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
              FROM orders GROUP BY 1, 2)""",
    "customer_annual": """
        SELECT o_custkey AS custkey, 'C' || CAST(o_custkey AS VARCHAR) AS iso3, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS n
        FROM orders GROUP BY 1, 2, 3""",
    "daily_quotes": """
        SELECT 'EUR' AS base, quote, day, CAST(s AS DOUBLE) / n AS rate
        FROM (SELECT upper(substr(event_type, 1, 3)) AS quote, CAST(ts AS DATE) AS day,
                     sum(CAST(value AS DECIMAL(18,2))) AS s, count(value) AS n
              FROM events WHERE isodow(ts) < 6 GROUP BY 1, 2)""",
}


def judge_sql(claimed: str, official: str, percent: str, t_abs: str = "NULL", t_pct: str = "NULL") -> str:
    a, r = f"abs({claimed} - {official})", f"(abs({claimed} - {official}) / abs({official}))"
    return f"""CASE WHEN {claimed} IS NULL OR {official} IS NULL THEN NULL
        WHEN {a} = 0 THEN 'match'
        WHEN {official} = 0 THEN (CASE WHEN {a} <= 0.05::DOUBLE THEN 'close' ELSE 'mismatch' END)
        WHEN {t_abs} IS NOT NULL OR {t_pct} IS NOT NULL THEN (
            CASE WHEN coalesce({a} <= {t_abs}, FALSE) OR coalesce({r} * 100 <= {t_pct}, FALSE) THEN 'match'
                 WHEN coalesce({a} <= {t_abs} * 3, FALSE) OR coalesce({r} * 100 <= {t_pct} * 3, FALSE) THEN 'close' ELSE 'mismatch' END)
        WHEN {percent} THEN (CASE WHEN {a} <= 0.06::DOUBLE OR {r} <= 0.005::DOUBLE THEN 'match'
                                  WHEN {a} <= 0.3::DOUBLE OR {r} <= 0.02::DOUBLE THEN 'close' ELSE 'mismatch' END)
        WHEN {r} <= 0.005::DOUBLE THEN 'match' WHEN {r} <= 0.05::DOUBLE THEN 'close' ELSE 'mismatch' END"""


def class_judge_sql(claimed: str, official: str, kind: str, cls: str, m: str = "1.0::DOUBLE") -> str:
    a, r = f"abs({claimed} - {official})", f"(abs({claimed} - {official}) / abs({official}))"
    pp = f"(CASE {cls} WHEN 'A' THEN 0.3::DOUBLE WHEN 'B' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"
    rel = f"(CASE {cls} WHEN 'A' THEN 0.02::DOUBLE WHEN 'B' THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END)"
    return f"""CASE WHEN {claimed} IS NULL OR {official} IS NULL THEN NULL
        WHEN {a} = 0 THEN 'match'
        WHEN {official} = 0 THEN (CASE WHEN {a} <= 0.05::DOUBLE * {m} THEN 'close' ELSE 'mismatch' END)
        WHEN {kind} = 'percent' THEN (CASE WHEN {a} <= 0.06::DOUBLE * {m} OR {r} <= 0.005::DOUBLE * {m} THEN 'match'
                                  WHEN {a} <= {pp} * {m} OR {r} <= {rel} * {m} THEN 'close' ELSE 'mismatch' END)
        WHEN {r} <= 0.005::DOUBLE * {m} THEN 'match' WHEN {r} <= 0.05::DOUBLE * {m} THEN 'close' ELSE 'mismatch' END"""


def wilson_sql(k: str, n: str, name: str) -> str:
    z = "1.959963984540054::DOUBLE"
    p = f"(({k})::DOUBLE / nullif({n}, 0))"
    nn = f"(nullif({n}, 0)::DOUBLE)"
    center = f"({p} + {z} * {z} / (2 * {nn}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {nn} + {z} * {z} / (4 * {nn} * {nn})))"
    denom = f"(1 + {z} * {z} / {nn})"
    return f"""{k} AS {name}_k, round({p}, 4) AS {name}_rate,
        round(CASE WHEN {nn} IS NOT NULL THEN greatest(0.0::DOUBLE, ({center} - {half}) / {denom}) END, 4) AS {name}_lo,
        round(CASE WHEN {nn} IS NOT NULL THEN least(1.0::DOUBLE, ({center} + {half}) / {denom}) END, 4) AS {name}_hi"""


def sql(body: str, **extra: str) -> str:
    """Prefix ``body`` with the CTEs it uses, in dependency order; ``extra`` adds local ones."""
    known = {**CTES, **extra}
    needed: list[str] = []

    def visit(text: str):
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text) and known[name] is not text:
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + body
