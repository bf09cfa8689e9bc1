"""Queries on seeded draws, question banks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from econcheck.operators import draw as D
from econcheck.plans.durable import cut_lineage
from econcheck.functions.text import fill_template
from econcheck.plans.ranking import row_number_by_hash
from econcheck.queries.frame import FVIEWS, HEADLINE, YEARS, excluded_cells
from econcheck.queries.cte import sql
from econcheck.queries.inputs import MODELS, Tables
from econcheck.queries.registry import query

SEED = "9f2c"
RESTRICTION = {"order_count": ["T1", "T2", "T4"]}
QUOTAS = {
    "indicator": {"order_value": 50, "order_count": 50},
    "tier": {"T1": 25, "T2": 25, "T3": 25, "T4": 25},
    "year": {y: 20 for y in YEARS},
}

_POOL = """SELECT * FROM marked WHERE eligible AND exclusion_reason IS NULL AND NOT probe AND (indicator <> 'order_count' OR tier IN ('T1', 'T2', 'T4'))"""
DVIEWS = dict(pool=_POOL, **FVIEWS)


def dsql(body: str, **extra: str) -> str:
    return sql(body, **DVIEWS, **extra)


def pool(t: Tables):
    cells = excluded_cells(t).select("iso3", "tier", "indicator", "year", "value", "eligible", "excluded", "null_probe_indicator", "reason")
    return D.headline_pool(cells, RESTRICTION)


def headline(t: Tables):
    """The drawn headline questions (first attempt that fills the quotas, else the largest)."""
    return D.draw_until_full(pool(t).select("iso3", "tier", "indicator", "year", "value"), SEED, "headline-draw:0", QUOTAS, partial=True)


def bank(t: Tables):
    """A whole bank: headline draw, recency questions and null probes, with blind ids."""
    cells = cut_lineage(excluded_cells(t).select("iso3", "tier", "indicator", "year", "value", "eligible", "excluded", "null_probe_indicator", "reason"))
    base = D.headline_pool(cells, RESTRICTION).select("iso3", "tier", "indicator", "year", "value")
    head = D.draw_until_full(base, SEED, "headline-draw:0", QUOTAS, partial=True).select("iso3", "tier", "indicator", "year", "value")
    recency = D.one_per_indicator(base, SEED, HEADLINE, [2001]).drop("turn")
    published = t.frozen_customer_annual.select("iso3", F.lit("order_value").alias("indicator"), "year", "value")
    probes = D.null_probes(cells, published, SEED, 10)
    return D.blind_ids(D.assemble_bank(head, recency, probes), "R1", SEED)


@query("t5_seeded_order", dsql(f"SELECT iso3, indicator, CAST(year AS INTEGER) AS year, row_number() OVER (ORDER BY sha256('{SEED}:order:' || iso3 || '|' || indicator || '|' || CAST(year AS VARCHAR))) AS position FROM pool"))
def t5(t: Tables):
    rows = pool(t).select("iso3", "indicator", "year")
    return row_number_by_hash(rows, D.seeded_key(SEED, "order", *D.cell_key()), "position")


@query("t6_quota_draw")
def t6(t: Tables):
    return headline(t).select("attempt_id", "position", "iso3", "indicator", "tier", "year", "shortfall")


@query(
    "t7_first_per_stratum",
    dsql(f"""SELECT tier, iso3, indicator, CAST(year AS INTEGER) AS year FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sha256('{SEED}:core-panel:' || iso3 || '|' || indicator || '|' || CAST(year AS VARCHAR))) AS rn FROM pool)
        WHERE rn <= CASE tier WHEN 'T1' THEN 8 WHEN 'T2' THEN 8 ELSE 7 END"""),
)
def t7(t: Tables):
    take = {"T1": 8, "T2": 8, "T3": 7, "T4": 7}
    return D.first_per_stratum(pool(t), "tier", D.seeded_key(SEED, "core-panel", *D.cell_key()), take).select("tier", "iso3", "indicator", "year")


_TURNS = ", ".join(f"('{i}')" for i in HEADLINE)


# a walk over the turns: each takes its first economy that no earlier turn has taken
@query(
    "t8_recency_draw",
    dsql(f"""SELECT indicator, iso3, tier, CAST(year AS INTEGER) AS year, CAST(turn AS INTEGER) AS turn FROM (
      WITH RECURSIVE turns AS (SELECT indicator, row_number() OVER (ORDER BY sha256('{SEED}:recency:' || indicator)) - 1 AS turn FROM (VALUES {_TURNS}) v(indicator)),
      cand AS (SELECT o.turn, p.indicator, p.iso3, p.tier, row_number() OVER (PARTITION BY p.indicator ORDER BY sha256('{SEED}:recency:' || p.indicator || ':' || p.iso3)) AS rn
               FROM (SELECT indicator, iso3, max(tier) AS tier FROM pool GROUP BY 1, 2) p JOIN turns o USING (indicator)),
      walk(turn, used, iso3) AS (
        SELECT -1::BIGINT, []::VARCHAR[], NULL::VARCHAR
        UNION ALL
        SELECT w.turn + 1, list_append(any_value(w.used), arg_min(c.iso3, c.rn)), arg_min(c.iso3, c.rn)
        FROM walk w LEFT JOIN cand c ON c.turn = w.turn + 1 AND NOT list_contains(w.used, c.iso3) WHERE w.turn + 1 < {len(HEADLINE)} GROUP BY w.turn)
      SELECT c.indicator, c.iso3, c.tier, CASE c.turn % 2 WHEN 0 THEN 2000 ELSE 2001 END AS year, c.turn FROM walk w JOIN cand c ON c.turn = w.turn AND c.iso3 = w.iso3)"""),
)
def t8(t: Tables):
    return D.one_per_indicator(pool(t), SEED, HEADLINE, [2000, 2001])


_PROBE = f"""SELECT iso3, indicator, year, sha256('{SEED}:null-probes:' || iso3 || '|' || indicator || '|' || CAST(year AS VARCHAR)) AS key FROM marked
    WHERE probe AND exclusion_reason IS NULL AND reason IN ('missing_year', 'null_value') AND NOT (year = 1998)"""


@query(
    "t9_null_probes",
    dsql("SELECT iso3, indicator, CAST(year AS INTEGER) AS year FROM (SELECT iso3, arg_min(indicator, key) AS indicator, arg_min(year, key) AS year, min(key) AS key FROM probe_cells GROUP BY iso3) ORDER BY key LIMIT 25", probe_cells=_PROBE),
)
def t9(t: Tables):
    cells = excluded_cells(t)
    # what a later reading found published: every 1998 cell
    published = cells.filter("year = 1998").select("iso3", "indicator", "year", F.lit(1.0).alias("value"))
    return D.null_probes(cells, published, SEED, 25).select("iso3", "indicator", "year")


@query("t10_conflict_free_batches")
def t10(t: Tables):
    b = cut_lineage(bank(t).select("qid", "iso3", "indicator", "segment"))
    packed = D.pack_batches(b, SEED)
    return D.order_for_models(packed, MODELS, SEED)


@query(
    "t10_model_order",
    sql(f"""SELECT model, batch_id, qid, CAST(row_number() OVER (PARTITION BY model, batch_id ORDER BY sha256('{SEED}:' || model || ':' || batch_id || ':' || qid)) AS INTEGER) AS position FROM (
          SELECT DISTINCT m.model, 'batch-' || CAST(o_custkey AS VARCHAR) AS batch_id, 'Q' || CAST(o_orderkey AS VARCHAR) AS qid FROM orders CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) m(model))"""),
)
def t10_order(t: Tables):
    b = t.orders.select(F.concat(F.lit("batch-"), F.col("o_custkey").cast("string")).alias("batch_id"), F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("qid"))
    return D.order_for_models(b, MODELS, SEED).select("model", "batch_id", "qid", "position")


_OPENING = "Answer the following {N} questions. Reply with one JSON array of {N} objects."


@query(
    "c12_prompts",
    sql(f"""SELECT model, batch_id, count(*) AS n_questions, string_agg(qid, ',' ORDER BY n) AS qids,
            replace('{_OPENING}', '{{N}}', CAST(count(*) AS VARCHAR)) || chr(10) || chr(10) || string_agg(CAST(n AS VARCHAR) || '. [' || qid || '] ' || text, chr(10) ORDER BY n) AS prompt
        FROM (SELECT m.model, 'batch-' || CAST(o_custkey AS VARCHAR) AS batch_id, 'Q' || CAST(o_orderkey AS VARCHAR) AS qid, 'What was order ' || CAST(o_orderkey AS VARCHAR) || ' worth in ' || strftime(o_orderdate, '%Y') || '?' AS text,
                row_number() OVER (PARTITION BY m.model, o_custkey ORDER BY sha256('{SEED}:' || m.model || ':batch-' || CAST(o_custkey AS VARCHAR) || ':Q' || CAST(o_orderkey AS VARCHAR))) AS n
              FROM orders CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) m(model))
        GROUP BY model, batch_id"""),
)
def c12_prompts(t: Tables):
    qid = F.concat(F.lit("Q"), F.col("o_orderkey").cast("string"))
    batches = t.orders.select(F.concat(F.lit("batch-"), F.col("o_custkey").cast("string")).alias("batch_id"), qid.alias("qid"))
    text = fill_template(F.lit("What was order {ORDER} worth in {YEAR}?"), {"ORDER": F.col("o_orderkey"), "YEAR": F.year("o_orderdate")})
    return D.render_prompts(D.order_for_models(batches, MODELS, SEED), t.orders.select(qid.alias("qid"), text.alias("text")), _OPENING)[0]


_N = f"row_number() OVER (ORDER BY sha256('{SEED}:qid-order:headline|' || indicator || '|' || iso3 || '|' || CAST(year AS VARCHAR)))"


@query("t11_blind_ids", dsql(f"SELECT iso3, indicator, CAST(year AS INTEGER) AS year, 'R1-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS qid FROM (SELECT *, {_N} AS n FROM pool)"))
def t11(t: Tables):
    return D.blind_ids(pool(t).withColumn("segment", F.lit("headline")), "R1", SEED).select("iso3", "indicator", "year", "qid")


@query(
    "x1_bank_assembly",
    dsql("""SELECT 'headline' AS segment, iso3, indicator, CAST(year AS INTEGER) AS year, round(value, 4) AS value FROM pool WHERE year < 1999
        UNION ALL SELECT 'recency', iso3, indicator, CAST(year AS INTEGER), NULL FROM pool WHERE year >= 1999 UNION ALL SELECT 'null_probe', iso3, indicator, CAST(year AS INTEGER), NULL FROM marked WHERE probe AND reason = 'missing_year'"""),
)
def x1(t: Tables):
    p = pool(t)
    head = p.filter("year < 1999").select("iso3", "indicator", "year", F.round("value", 4).alias("value"))
    probes = excluded_cells(t).filter("null_probe_indicator AND reason = 'missing_year'").select("iso3", "indicator", "year")
    return D.assemble_bank(head, p.filter("year >= 1999").select("iso3", "indicator", "year"), probes)


def _verified(t: Tables):
    k = F.regexp_extract("iso3", r"^C(\d+)$", 1).cast("long") + F.col("year")
    return pool(t).select(
        "iso3", "indicator", "year", F.when(k % 5 == 0, F.lit(None).cast("double")).when(k % 5 == 1, F.col("value") * 1.5).otherwise(F.col("value")).alias("official_value"),
        (k % 7 == 0).alias("is_projection"), F.when(k % 5 == 0, F.lit("cannot_verify")).when(k % 5 == 1, F.lit("mismatch")).otherwise(F.lit("match")).alias("verdict"),
    )


_TAKE = {"T1": 3, "T2": 3, "T3": 2, "T4": 2}
_CYCLES = 12


def _redraw_sql() -> str:
    """Every cycle spelled out: draw from what is left, find what cannot be verified, go on without it."""
    steps, taken = [], "CASE tier " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _TAKE.items()) + " ELSE 0 END"
    for c in range(_CYCLES):
        before = f"ANTI JOIN g{c - 1} g USING (iso3, indicator, year)" if c else ""
        steps.append(f"p{c} AS MATERIALIZED (SELECT p.* FROM {f'p{c - 1}' if c else 'pool'} p {before})")
        steps.append(f"""d{c} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sha256('{SEED}:headline-draw:{c}:' || iso3 || '|' || indicator || '|' || CAST(year AS VARCHAR))) AS rn FROM p{c}) WHERE rn <= {taken})""")
        steps.append(f"g{c} AS MATERIALIZED (SELECT iso3, indicator, year FROM d{c} WHERE (custkey + year) % 11 = 0)")
    every = " UNION ALL ".join(f"SELECT {c} AS cycle, d.*, (SELECT count(*) FROM g{c}) AS bad FROM d{c} d" for c in range(_CYCLES))
    return f"""SELECT iso3, indicator, CAST(year AS INTEGER) AS year, round(CASE WHEN (custkey + year) % 5 = 1 THEN value * 1.5::DOUBLE ELSE value END, 4) AS value, (custkey + year) % 5 = 1 AS frame_value_reanchored, cycle
        FROM (WITH {", ".join(steps)}, every AS MATERIALIZED ({every}) SELECT * FROM every WHERE cycle = (SELECT min(cycle) FROM every WHERE bad = 0))"""


@query("j21_reanchored_draw", dsql(_redraw_sql()))
def j21(t: Tables):
    k = F.regexp_extract("iso3", r"^C(\d+)$", 1).cast("long") + F.col("year")

    def verify(cells):
        return cells.select(
            "iso3", "indicator", "year", F.when(k % 11 != 0, F.when(k % 5 == 1, F.col("value") * 1.5).otherwise(F.col("value"))).alias("official_value"), F.lit(False).alias("is_projection"),
            F.when(k % 11 == 0, F.lit("cannot_verify")).when(k % 5 == 1, F.lit("mismatch")).otherwise(F.lit("match")).alias("verdict"),
        )

    def draw(left, cycle, core):
        taken = D.first_per_stratum(left, "tier", D.seeded_key(SEED, f"headline-draw:{cycle}", *D.cell_key()), _TAKE)
        return taken.select("iso3", "indicator", "year", "value", F.lit(cycle).cast("int").alias("cycle"))

    kept, _ = D.draw_verified(pool(t), draw, verify, _CYCLES)
    return kept.select("iso3", "indicator", "year", F.round("value", 4).alias("value"), "frame_value_reanchored", "cycle")


@query("x3_redraw_pool", dsql("SELECT iso3, indicator, CAST(year AS INTEGER) AS year FROM pool WHERE (custkey + year) % 5 <> 0 AND (custkey + year) % 7 <> 0"))
def x3(t: Tables):
    p = pool(t)
    _, unusable = D.reanchor(p, _verified(t))
    return D.redraw_pool(p, unusable).select("iso3", "indicator", "year")


_CORE = """SELECT 'R0-' || iso3 || '-' || CAST(year AS VARCHAR) AS source_qid, iso3, indicator, year FROM cells WHERE indicator = 'order_value' AND year IN (1997, 1998)"""


@query("j19_core_carry_over", dsql("SELECT c.source_qid, p.iso3, CAST(p.year AS INTEGER) AS year, round(p.value, 4) AS value FROM core_q c JOIN pool p ON p.iso3 = c.iso3 AND p.indicator = c.indicator AND p.year = c.year", core_q=_CORE))
def j19(t: Tables):
    core, _ = _carried(t)
    return core.select("source_qid", "iso3", "year", F.round("value", 4).alias("value"))


@query("j19_core_missing", dsql("SELECT c.source_qid FROM core_q c WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.iso3 = c.iso3 AND p.indicator = c.indicator AND p.year = c.year)", core_q=_CORE))
def j19_missing(t: Tables):
    return _carried(t)[1].select("source_qid")


def _carried(t: Tables):
    old = t.customer.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("iso3"), F.lit("order_value").alias("indicator"), F.explode(F.array(F.lit(1997), F.lit(1998))).alias("year"), F.lit("headline").alias("segment")
    ).withColumn("qid", F.concat(F.lit("R0-"), "iso3", F.lit("-"), F.col("year").cast("string")))
    return D.carry_core(old, old.select(F.col("qid").alias("source_qid")), pool(t))


@query(
    "j20_sibling_run",
    sql("""SELECT model, batch_id, qid, CAST(row_number() OVER (PARTITION BY model, batch_id ORDER BY o_orderkey) AS INTEGER) AS position FROM (
          SELECT o_orderpriority AS model, 'batch-' || CAST(o_custkey AS VARCHAR) AS batch_id, o_orderkey, 'Q' || CAST(o_orderkey AS VARCHAR) AS qid FROM orders WHERE o_orderstatus = 'F')"""),
)
def j20(t: Tables):
    from pyspark.sql import Window

    order = Window.partitionBy("o_orderpriority", "o_custkey").orderBy("o_orderkey")
    items = t.orders.select(
        F.col("o_orderpriority").alias("model"), F.concat(F.lit("batch-"), F.col("o_custkey").cast("string")).alias("batch_id"),
        F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("qid"), F.row_number().over(order).alias("position"),
    )
    subset = t.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("qid"))
    return D.sibling_run(items, subset).select("model", "batch_id", "qid", "position")
