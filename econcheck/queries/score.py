"""Queries on raw answers, scoring and significance.

Questions are customer-years, models are order priorities and every order is one
answer: its text, unit and mistakes follow from the order key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from econcheck.functions import judge as J
from econcheck.operators import answers as N
from econcheck.operators import draw as D
from econcheck.operators import score as S
from econcheck.plans.durable import cut_lineage
from econcheck.sources import artefacts as A
from econcheck.queries.cte import class_judge_sql, sql, wilson_sql
from econcheck.queries.inputs import FACTORS, MODELS, Tables
from econcheck.queries.registry import query


SEED = "9f2c"


def order_key() -> F.Column:
    return F.col("o_orderkey")



def questions(t: Tables):
    """qid, custkey, iso3, year, strata and official values with the years either side.

    Bank and ground truth are frozen before anything is scored, hence the checkpoint.
    """
    a = t.customer_annual().select("custkey", "iso3", "year", "value")
    base = F.when(F.col("custkey") % 3 == 0, F.col("value") / 10000.0).otherwise(F.col("value"))
    b = a.withColumn("base", base)
    # neighbours: a customer's years lie side by side; a row without a year is its own neighbour on both sides
    years, base, year = Window.partitionBy("custkey").orderBy("year"), F.col("base"), F.col("year")

    def beside(look, gap):
        return F.when(year.isNull(), base).when(look("year").over(years) == year + gap, look("base").over(years))

    g = b.select("custkey", "iso3", "year", "base", beside(F.lag, -1).alias("prev_value"), beside(F.lead, 1).alias("next_value")).filter("base IS NOT NULL")
    k = F.col("custkey")
    segment = F.when(k % 10 == 9, "null_probe").when(k % 10 == 8, "recency").otherwise("headline")
    hidden = (segment == "null_probe") | ((segment == "recency") & (F.col("year") == 2001))
    return cut_lineage(g.select(
        F.concat(F.lit("Q"), k.cast("string"), F.lit("-"), F.col("year").cast("string")).alias("qid"), "custkey", "iso3", "year", segment.alias("segment"),
        F.when(k % 3 == 0, "percent").otherwise("level").alias("kind"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.floor(k / 3) % 3 + 1).cast("int")).alias("revision_class"),
        F.concat(F.lit("T"), (k % 4 + 1).cast("string")).alias("tier"), (F.col("year") % 2 == 0).alias("core"), F.lit(False).alias("is_projection"),
        F.when(~hidden, F.col("base")).alias("value"), "base", "prev_value", "next_value",
    ))


def expected(q):
    """Every model is asked every question in its own seeded order; a batch is one customer's questions."""
    return D.ordered_batches(q.select(F.concat(F.lit("batch-"), F.col("custkey").cast("string")).alias("batch_id"), "qid"), MODELS, SEED)


def answer_texts(t: Tables, q):
    """Raw answer files: path and body, one per model and customer plus repairs."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("model"))
    j = o.join(q.select("custkey", "year", "qid", "kind", "base"), ["custkey", "year"])
    factor = F.element_at(F.array(*[F.lit(f) for f in FACTORS]), (order_key() % 9 + 1).cast("int"))
    level = F.col("kind") == "level"
    v = F.col("base") * factor
    scaled = F.when(level & (order_key() % 3 == 0), v / 1e6).when(~level & (order_key() % 3 == 0), v / 100.0).otherwise(v)
    unit = (
        F.when(order_key() % 29 == 0, "widgets").when(level & (order_key() % 3 == 0), "US$ millions").when(level, "usd").when(order_key() % 3 == 0, "ratio").otherwise("%")
    )
    shown = F.when(order_key() % 23 == 0, F.concat(F.lit('"'), scaled.cast("string"), F.lit('"'))).otherwise(scaled.cast("string"))
    qid = F.when(order_key() % 31 == 0, F.concat(F.lit("X"), order_key().cast("string"))).otherwise(F.concat(F.lit(" "), F.col("qid")))
    item = F.concat(
        F.lit('{"qid":"'), qid, F.lit('","value":'), shown, F.lit(',"unit":"'), unit, F.lit('","year_basis":'), F.col("year").cast("string"),
        F.lit(',"confidence":'), ((order_key() % 100) / 100.0).cast("string"), F.when(order_key() % 37 == 0, F.lit("")).otherwise(
            F.concat(F.lit(',"refused":'), F.when(order_key() % 19 == 0, "true").otherwise("false"))), F.lit(',"basis_note":"n"}'),
    )
    b = j.groupBy("model", "custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
    b = b.filter(~((F.col("custkey") % 17 == 0) & (F.col("model") == "5-LOW"))).withColumn("body", body)
    fenced = F.concat(F.lit("```json\n"), "body", F.lit("\n```"))
    path = F.concat(F.lit("/runs/R1/raw/"), "model", F.lit("/batch-"), F.col("custkey").cast("string"))
    original = F.struct(F.concat(path, F.lit(".txt")).alias("path"), F.when(F.col("custkey") % 13 == 0, fenced).otherwise(F.col("body")).alias("body"))
    repair = F.when(F.col("custkey") % 26 == 0, F.struct(F.concat(path, F.lit(".repair.txt")).alias("path"), F.col("body").alias("body")))
    return b.select(F.explode(F.array_compact(F.array(original, repair))).alias("f")).select("f.*")


def aligned(t: Tables, q, files=None):
    files = A.answer_files(answer_texts(t, q)) if files is None else files
    exp = expected(q)
    return N.align(exp, files)


def revisions(q):
    k = F.col("custkey")
    status = F.when(k % 5 == 0, "ok").when(k % 5 == 1, "cell_missing_in_vintage")
    projections = F.when(
        F.col("segment") == "recency", F.create_map(F.col("year"), F.struct((F.col("base") * 1.003).alias("value"), F.lit(True).alias("is_projection")))
    )
    return q.filter(k % 5 <= 1).select("qid", status.alias("status"), F.when(k % 5 == 0, F.col("base") * 1.2).alias("vintage_value"), projections.alias("vintage_projections"))


def scored(t: Tables):
    q = questions(t)
    answers, _ = aligned(t, q)
    return S.score_answers(answers, q.drop("base", "custkey"), revisions(q))


_DIV = "(CASE WHEN a.custkey % 3 = 0 THEN {x}.value / 10000.0::DOUBLE ELSE {x}.value END)"
_QUESTIONS = f"""SELECT 'Q' || CAST(custkey AS VARCHAR) || '-' || CAST(year AS VARCHAR) AS qid, custkey, iso3, year, segment, CASE WHEN custkey % 3 = 0 THEN 'percent' ELSE 'level' END AS kind,
        (['A', 'B', 'C'])[CAST(floor(custkey / 3) AS BIGINT) % 3 + 1] AS cls, 'T' || CAST(custkey % 4 + 1 AS VARCHAR) AS tier, year % 2 = 0 AS core, base, prev, nxt,
        CASE WHEN segment = 'null_probe' OR (segment = 'recency' AND year = 2001) THEN NULL ELSE base END AS official
    FROM (SELECT a.custkey, a.iso3, a.year, CASE WHEN a.custkey % 10 = 9 THEN 'null_probe' WHEN a.custkey % 10 = 8 THEN 'recency' ELSE 'headline' END AS segment,
            {_DIV.format(x='a')} AS base, {_DIV.format(x='p')} AS prev, {_DIV.format(x='n')} AS nxt
          FROM customer_annual a LEFT JOIN customer_annual p ON p.custkey = a.custkey AND p.year = a.year - 1
          LEFT JOIN customer_annual n ON n.custkey = a.custkey AND n.year = a.year + 1)"""
_MODELS = "SELECT * FROM (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4)) m(model, pos)"
_ITEMS = """SELECT o_orderkey AS k, o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS model FROM orders
    WHERE NOT (o_custkey % 17 = 0 AND o_orderpriority = '5-LOW')"""
_BATCHES = """SELECT model, custkey, count(*) AS n_items, CASE WHEN custkey % 13 <> 0 OR custkey % 26 = 0 THEN 'parsed' ELSE 'format_failure_batch' END AS outcome,
    custkey % 26 = 0 AS repaired FROM items GROUP BY model, custkey"""
# the answer of a model to a question: the first order of that customer, year and priority with a known id
_ALIGNED = """SELECT m.model, m.pos, q.*, coalesce(b.outcome, 'missing_raw') AS outcome, coalesce(b.repaired, FALSE) AS repaired,
        CASE WHEN b.outcome = 'parsed' THEN f.k END AS k
    FROM questions q CROSS JOIN models m LEFT JOIN batches b ON b.model = m.model AND b.custkey = q.custkey
    LEFT JOIN (SELECT model, custkey, year, min(k) AS k FROM items WHERE k % 31 <> 0 GROUP BY 1, 2, 3) f ON f.model = m.model AND f.custkey = q.custkey AND f.year = q.year"""
_FACTOR = "(CASE k % 9 WHEN 1 THEN 1.003::DOUBLE WHEN 2 THEN 1.03::DOUBLE WHEN 3 THEN 1.2::DOUBLE WHEN 4 THEN 100.0::DOUBLE WHEN 5 THEN 0.001::DOUBLE WHEN 6 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
_CLAIMED = f"""SELECT *, CASE WHEN early IS NULL THEN CASE WHEN k % 3 = 0 AND kind = 'level' THEN (base * {_FACTOR}) / 1e6::DOUBLE * 1e6::DOUBLE
        WHEN k % 3 = 0 THEN (base * {_FACTOR}) / 100.0::DOUBLE * 100.0::DOUBLE ELSE base * {_FACTOR} END END AS claimed
    FROM (SELECT *, CASE WHEN k IS NULL THEN 'format_failure' WHEN k % 37 <> 0 AND k % 19 = 0 THEN 'refusal' WHEN k % 23 = 0 OR k % 29 = 0 THEN 'answer_failure' END AS early FROM aligned)"""
_V = class_judge_sql("claimed", "official", "kind", "cls")
_SCORED = f"""SELECT *, coalesce(early, CASE segment WHEN 'null_probe' THEN 'fabricated' WHEN 'recency' THEN coalesce({_V}, 'uncorroborated_answer') ELSE {_V} END) AS status,
        CASE WHEN early IS NULL AND segment <> 'null_probe' AND official <> 0 THEN (claimed - official) / abs(official) END AS rel FROM claimed_answers"""
_HEAD = "SELECT * FROM scored WHERE segment = 'headline' AND status <> 'format_failure'"
VIEWS = dict(
    questions=_QUESTIONS, models=_MODELS, items=_ITEMS, batches=_BATCHES, aligned=_ALIGNED, claimed_answers=_CLAIMED, scored=_SCORED, head=_HEAD,
)


def ssql(body: str, **extra: str) -> str:
    return sql(body, **VIEWS, **extra)


@query(
    "s9_raw_answer_files",
    ssql("SELECT model, 'batch-' || CAST(custkey AS VARCHAR) AS batch_id, custkey % 13 = 0 AS fenced, custkey % 26 = 0 AS has_repair FROM batches"),
)
def s9(t: Tables):
    files = A.answer_files(answer_texts(t, questions(t)))
    return files.select("model", "batch_id", F.col("original").startswith("```").alias("fenced"), F.col("repair").isNotNull().alias("has_repair"))


@query("c5_strict_parse", ssql("SELECT model, custkey, outcome = 'parsed' AND NOT repaired AS original_ok, outcome FROM batches"))
def c5(t: Tables):
    files = N.parse_batches(A.answer_files(answer_texts(t, questions(t))))
    return files.select(
        "model", F.substring("batch_id", 7, 20).cast("long").alias("custkey"), (F.col("parsed").isNotNull() & ~F.col("repaired")).alias("original_ok"), "outcome"
    )


@query(
    "c6_typed_items",
    ssql("""SELECT k, CASE WHEN k % 23 <> 0 THEN TRUE ELSE FALSE END AS has_value, CASE WHEN k % 37 <> 0 THEN k % 19 = 0 ELSE FALSE END AS refused, round((k % 100) / 100.0::DOUBLE, 4) AS confidence,
            array_to_string(list_filter([CASE WHEN k % 23 = 0 THEN 'value_not_number' END, CASE WHEN k % 37 = 0 THEN 'refused_missing' END], lambda x: x IS NOT NULL), ';') AS flags
        FROM (SELECT i.*, row_number() OVER (PARTITION BY i.model, i.custkey ORDER BY k) - 1 AS pos FROM items i) i JOIN batches b ON b.model = i.model AND b.custkey = i.custkey WHERE outcome = 'parsed'"""),
)
def c6(t: Tables):
    q = questions(t)
    items = N.parsed_items(N.parse_batches(A.answer_files(answer_texts(t, q))))
    keys = t.orders.filter("NOT (o_custkey % 17 = 0 AND o_orderpriority = '5-LOW')").select(
        F.col("o_orderpriority").alias("model"), F.concat(F.lit("batch-"), F.col("o_custkey").cast("string")).alias("batch_id"), order_key()
    )
    # the n-th element of a batch is its n-th order
    nth = keys.groupBy("model", "batch_id").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks")).select("model", "batch_id", F.posexplode("ks").alias("pos", "k"))
    typed = N.typed_fields(items.join(nth, ["model", "batch_id", "pos"]).select("k", "item"), "item")
    return typed.select(
        "k", F.col("value").isNotNull().alias("has_value"), "refused", F.round("confidence", 4).alias("confidence"), F.array_join("parse_flags", ";").alias("flags")
    )


@query(
    "j12_answer_alignment",
    ssql("""SELECT model, qid, k IS NULL AS format_failure, CASE WHEN k IS NULL THEN CASE WHEN outcome = 'parsed' THEN 'qid_missing_from_output' ELSE outcome END END AS failure_reason, repaired FROM aligned"""),
)
def j12(t: Tables):
    answers, _ = aligned(t, questions(t))
    return answers.select("model", "qid", "format_failure", "failure_reason", "repaired")


@query(
    "x4_extraneous_answers",
    ssql("SELECT i.model, 'batch-' || CAST(i.custkey AS VARCHAR) AS batch_id, 'X' || CAST(k AS VARCHAR) AS qid FROM items i JOIN batches b ON b.model = i.model AND b.custkey = i.custkey WHERE k % 31 = 0 AND outcome = 'parsed'"),
)
def x4(t: Tables):
    _, extra = aligned(t, questions(t))
    return extra.select("model", "batch_id", "qid")


@query(
    "a13_batch_statistics",
    ssql("""SELECT m.model, 'batch-' || CAST(c.custkey AS VARCHAR) AS batch_id, coalesce(b.outcome, 'missing_raw') AS outcome, coalesce(b.repaired, FALSE) AS repaired,
            CASE WHEN b.outcome = 'parsed' THEN b.n_items ELSE 0 END AS n_items, CASE WHEN b.outcome = 'parsed' THEN coalesce(s.n_known, 0) ELSE 0 END AS n_aligned,
            CASE WHEN b.outcome = 'parsed' THEN b.n_items - coalesce(s.n_ok, 0) ELSE 0 END AS n_extraneous, CASE WHEN b.outcome = 'parsed' THEN coalesce(s.n_ok - s.n_known, 0) ELSE 0 END AS n_duplicates
        FROM (SELECT DISTINCT custkey FROM questions) c CROSS JOIN models m LEFT JOIN batches b ON b.model = m.model AND b.custkey = c.custkey
        LEFT JOIN (SELECT model, custkey, count(DISTINCT year) AS n_known, count(*) AS n_ok FROM items WHERE k % 31 <> 0 GROUP BY 1, 2) s ON s.model = m.model AND s.custkey = c.custkey"""),
)
def a13(t: Tables):
    q = questions(t)
    exp = expected(q)
    out = N.batch_statistics(exp, A.answer_files(answer_texts(t, q)))
    return out.select("model", "batch_id", "outcome", "repaired", *[F.col(c).cast("long").alias(c) for c in ("n_items", "n_aligned", "n_extraneous", "n_duplicates")])


@query(
    "c7_answer_status",
    ssql("SELECT model, qid, status, claimed AS normalized_value FROM scored"),
)
def c7(t: Tables):
    return scored(t).select("model", "qid", "status", "normalized_value")


@query("c8_class_bands", ssql(f"SELECT k AS o_orderkey, m.mult AS multiplier, {class_judge_sql('claimed', 'official', 'kind', 'cls', 'm.mult')} AS verdict FROM claimed_answers CROSS JOIN (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) m(mult) WHERE claimed IS NOT NULL AND official IS NOT NULL"))
def c8(t: Tables):
    s = scored(t).filter("normalized_value IS NOT NULL AND official_value IS NOT NULL").withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in J.SWEEP_MULTIPLIERS])))
    first = t.orders.filter("o_orderkey % 31 <> 0").groupBy(
        F.col("o_orderpriority").alias("model"), F.concat(F.lit("Q"), F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string")).alias("qid")
    ).agg(F.min("o_orderkey").alias("o_orderkey"))
    v = J.judge_by_class(F.col("normalized_value"), F.col("official_value"), F.col("kind"), F.col("revision_class"), F.col("multiplier"))
    return s.join(first, ["model", "qid"]).select("o_orderkey", "multiplier", v.alias("verdict"))


_ADJ = "CASE WHEN {v} IS NOT NULL AND " + "({j}) <> 'mismatch' THEN 'adjacent_year:{n}:' || CAST(year {d} AS VARCHAR) END"
_NEARF = "abs(ratio - {f}) / {f} <= 0.02::DOUBLE OR abs(ratio - 1.0::DOUBLE / {f}) / (1.0::DOUBLE / {f}) <= 0.02::DOUBLE"
_SLIP = "CASE " + " ".join(f"WHEN ratio > 0 AND ({_NEARF.format(f=f'{f}::DOUBLE')}) THEN 'scale_slip:' || (CASE WHEN ratio > 1 THEN '{n}' ELSE '1/{n}' END)" for f, n in (("100.0", "100"), ("1e3", "1000"), ("1e6", "1000000"), ("1e9", "1000000000"), ("1e12", "1000000000000"))) + " END"


@query(
    "c9_mismatch_labels",
    ssql(f"""SELECT model, qid, array_to_string(list_filter([{_SLIP}, CASE WHEN ratio < 0 AND abs(-ratio - 1) <= 0.02::DOUBLE THEN 'sign_error' END,
            {_ADJ.format(v='prev', j=class_judge_sql('claimed', 'prev', 'kind', 'cls'), n='prev', d='- 1')}, {_ADJ.format(v='nxt', j=class_judge_sql('claimed', 'nxt', 'kind', 'cls'), n='next', d='+ 1')}], lambda x: x IS NOT NULL), ';') AS diagnostics,
            custkey % 5 = 0 AND ({class_judge_sql('claimed', '(base * 1.2::DOUBLE)', 'kind', 'cls')}) <> 'mismatch' AS revision_affected,
            CASE custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'cell_missing_in_vintage' ELSE 'not_targeted' END AS vintage_status
        FROM (SELECT *, CASE WHEN official <> 0 THEN claimed / official END AS ratio FROM scored WHERE segment = 'headline' AND status = 'mismatch')"""),
)
def c9(t: Tables):
    m = scored(t).filter("segment = 'headline' AND status = 'mismatch'")
    return m.select("model", "qid", F.array_join("diagnostics", ";").alias("diagnostics"), "revision_affected", "vintage_status")


_ECHO = class_judge_sql("claimed", "(CASE WHEN custkey % 5 <= 1 THEN base * 1.003::DOUBLE END)", "kind", "cls")


@query("c10_projection_echo", ssql(f"SELECT model, qid, CASE WHEN custkey % 5 <= 1 THEN ({_ECHO}) <> 'mismatch' END AS projection_echo FROM scored WHERE segment = 'recency' AND early IS NULL"))
def c10(t: Tables):
    return scored(t).filter("segment = 'recency' AND normalized_value IS NOT NULL").select("model", "qid", "projection_echo")


@query("c11_signed_error", ssql("SELECT model, qid, round(rel, 6) + 0.0::DOUBLE AS signed_rel_error FROM scored WHERE rel IS NOT NULL"))
def c11(t: Tables):
    return scored(t).filter("signed_rel_error IS NOT NULL").select("model", "qid", F.round("signed_rel_error", 6).alias("signed_rel_error"))


def _count(*statuses):
    return f"count(*) FILTER (WHERE status IN ({', '.join(repr(s) for s in statuses)}))"


_WITHIN, _ATT = _count("match", "close"), _count("match", "close", "mismatch")
_SCN = "(count(*) - " + _count("format_failure") + ")"


@query(
    "a1_wilson_rates",
    ssql(f"""SELECT model, count(*) AS n_questions, {_count('format_failure')} AS format_failures, {_SCN} AS scoreable, {_count('match')} AS "match", {_count('close')} AS "close", {_count('mismatch')} AS mismatch,
            {_count('refusal')} AS refusals, {_count('answer_failure')} AS answer_failures, {_ATT} AS attempted,
            count(*) FILTER (WHERE status = 'mismatch' AND custkey % 5 = 0 AND vin <> 'mismatch') AS revision_affected, count(*) FILTER (WHERE status = 'mismatch' AND custkey % 5 = 0) AS vintage_eligible_misses,
            {wilson_sql(_WITHIN, _SCN, 'wtr')}, {wilson_sql(_count('match'), _SCN, 'strict')}, {wilson_sql(_count('mismatch'), _ATT, 'cr')}, {wilson_sql(_ATT, _SCN, 'answer')},
            {wilson_sql(_WITHIN, _ATT, 'accuracy')}, {wilson_sql(_count('format_failure'), 'count(*)', 'format_failure')}
        FROM (SELECT *, {class_judge_sql('claimed', '(base * 1.2::DOUBLE)', 'kind', 'cls')} AS vin FROM scored WHERE segment = 'headline') GROUP BY model"""),
)
def a1(t: Tables):
    return S.headline_rates(scored(t))


@query(
    "a2_strata",
    ssql("""SELECT model, s AS stratum, v AS stratum_value, count(*) AS n, count(*) FILTER (WHERE status IN ('match', 'close')) AS within, count(*) FILTER (WHERE status = 'match') AS strict,
            count(*) FILTER (WHERE status = 'mismatch') AS mismatch, count(*) FILTER (WHERE status = 'refusal') AS refusal, round(count(*) FILTER (WHERE status IN ('match', 'close'))::DOUBLE / count(*), 4) AS wtr
        FROM (SELECT model, status, unnest(['revision_class', 'tier', 'year', 'batch_position']) AS s, unnest([cls, tier, CAST(year AS VARCHAR), CAST(place AS VARCHAR)]) AS v
              FROM head JOIN places USING (model, qid)) GROUP BY 1, 2, 3""",
        places=f"""SELECT m.model, q.qid, row_number() OVER (PARTITION BY m.model, q.custkey ORDER BY sha256('{SEED}:' || m.model || ':batch-' || CAST(q.custkey AS VARCHAR) || ':' || q.qid)) AS place
            FROM questions q CROSS JOIN models m"""),
)
def a2(t: Tables):
    return S.strata(scored(t), ["revision_class", "tier", "year", "batch_position"])


@query(
    "a3_tolerance_sweep",
    ssql(f"""SELECT model, multiplier, count(*) AS n, {wilson_sql("count(*) FILTER (WHERE ok)", "count(*)", 'wtr')} FROM (
          SELECT model, m.mult AS multiplier, coalesce(status IN ('match', 'close', 'mismatch') AND ({class_judge_sql('claimed', 'official', 'kind', 'cls', 'm.mult')}) <> 'mismatch', FALSE) AS ok
          FROM head CROSS JOIN (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) m(mult)) GROUP BY 1, 2"""),
)
def a3(t: Tables):
    return S.tolerance_sweep(scored(t))


def weights(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("C"), k.cast("string")).alias("iso3"), F.when(k % 7 != 0, (k % 100 + 1).cast("double")).alias("gdp"),
        F.when(k % 11 != 0, (k % 50 + 1).cast("double")).alias("population"),
    )


def _wt(col):
    return f"round((coalesce(sum({col}) FILTER (WHERE ok), 0) + avg({col}) * count(*) FILTER (WHERE ok AND {col} IS NULL)) / (sum({col}) + avg({col}) * count(*) FILTER (WHERE {col} IS NULL)), 4)"


_WEIGHTED = """SELECT model, iso3, status IN ('match', 'close') AS ok, CASE WHEN custkey % 7 <> 0 THEN (custkey % 100 + 1)::DOUBLE END AS g, CASE WHEN custkey % 11 <> 0 THEN (custkey % 50 + 1)::DOUBLE END AS p FROM head"""


@query(
    "a5_reweighted_rates",
    ssql(f"SELECT model, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 4) AS wtr_equal, {_wt('g')} AS wtr_gdp_weighted, {_wt('p')} AS wtr_population_weighted FROM weighted GROUP BY model", weighted=_WEIGHTED),
)
def a5(t: Tables):
    return S.reweighted(scored(t), weights(t))


@query("a5_null_weight_economies", ssql("SELECT DISTINCT model, iso3 FROM weighted WHERE g IS NULL OR p IS NULL", weighted=_WEIGHTED))
def a5_null(t: Tables):
    return S.unweighted_economies(scored(t), weights(t))


@query(
    "a6_error_quantiles",
    ssql("""SELECT model, n, p.p AS p, list_extract(e, CAST(least(n - 1, floor(p.p * n)) AS BIGINT) + 1) AS value
        FROM (SELECT model, count(*) AS n, list(round(rel, 6) + 0.0::DOUBLE ORDER BY round(rel, 6) + 0.0::DOUBLE) AS e FROM head WHERE rel IS NOT NULL GROUP BY model)
        CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) p(p)"""),
)
def a6(t: Tables):
    return S.error_quantiles(scored(t))


@query(
    "a7_calibration",
    ssql("""SELECT model, round(avg(c) FILTER (WHERE status IN ('match', 'close')), 3) AS mean_confidence_within, round(avg(c) FILTER (WHERE status = 'mismatch'), 3) AS mean_confidence_mismatch,
            round(avg(c) FILTER (WHERE status = 'refusal'), 3) AS mean_confidence_refused FROM (SELECT *, (k % 100) / 100.0::DOUBLE AS c FROM head) GROUP BY model"""),
)
def a7(t: Tables):
    return S.calibration(scored(t))


_ANSWERED = "status NOT IN ('format_failure', 'refusal', 'answer_failure')"


@query(
    "a8_recency_summary",
    ssql(f"""SELECT model, count(*) AS n, {_SCN} AS scoreable, {_count('refusal')} AS refusals, count(*) FILTER (WHERE {_ANSWERED}) AS answered, {_WITHIN} AS within, {_count('mismatch')} AS mismatch,
            {_count('uncorroborated_answer')} AS uncorroborated, count(*) FILTER (WHERE {_ANSWERED} AND coalesce(({_ECHO}) <> 'mismatch', FALSE)) AS projection_echoes FROM scored WHERE segment = 'recency' GROUP BY model"""),
)
def a8(t: Tables):
    return S.recency_summary(scored(t))


@query("a9_fabrication_rate", ssql(f"SELECT model, count(*) AS n, {_SCN} AS scoreable, {wilson_sql(_count('fabricated'), _SCN, 'fabrication')} FROM scored WHERE segment = 'null_probe' GROUP BY model"))
def a9(t: Tables):
    return S.fabrication(scored(t))


_YD = f"""official IS NOT NULL AND coalesce(({class_judge_sql('prev', 'official', 'kind', 'cls')}) = 'mismatch', TRUE) AND coalesce(({class_judge_sql('nxt', 'official', 'kind', 'cls')}) = 'mismatch', TRUE)"""


@query(
    "a10_year_discrimination",
    ssql(f"""SELECT model, count(*) FILTER (WHERE yd) AS n_yd, {wilson_sql("count(*) FILTER (WHERE yd AND ok)", "count(*) FILTER (WHERE yd)", 'wtr_yd')}, count(*) AS n, {wilson_sql("count(*) FILTER (WHERE ok)", "count(*)", 'wtr_all')}
        FROM (SELECT model, status IN ('match', 'close') AS ok, {_YD} AS yd FROM head) GROUP BY model"""),
)
def a10(t: Tables):
    return S.year_discrimination(scored(t))


@query(
    "a15_interpretation_grid",
    ssql("""SELECT model, CASE WHEN wtr >= 0.85 AND cr <= 0.08 THEN 'A' WHEN wtr >= 0.65 THEN 'B' ELSE 'C' END AS branch, ar >= 0.7 AS valid FROM (
          SELECT model, round(w::DOUBLE / n, 4) AS wtr, round(mm::DOUBLE / a, 4) AS cr, round(a::DOUBLE / n, 4) AS ar FROM (
            SELECT model, count(*) AS n, count(*) FILTER (WHERE status IN ('match', 'close')) AS w, count(*) FILTER (WHERE status = 'mismatch') AS mm, count(*) FILTER (WHERE status IN ('match', 'close', 'mismatch')) AS a FROM head GROUP BY model))"""),
)
def a15(t: Tables):
    return S.interpretation_grid(S.headline_rates(scored(t)))


@query(
    "a17_contamination_gap",
    ssql("""SELECT model, count(*) FILTER (WHERE core) AS n_core, count(*) FILTER (WHERE NOT core) AS n_fresh, round(a, 4) AS wtr_core, round(b, 4) AS wtr_fresh, round(a - b, 4) AS gap FROM (
          SELECT *, count(*) FILTER (WHERE core AND ok) OVER w::DOUBLE / count(*) FILTER (WHERE core) OVER w AS a, count(*) FILTER (WHERE NOT core AND ok) OVER w::DOUBLE / count(*) FILTER (WHERE NOT core) OVER w AS b
          FROM (SELECT *, status IN ('match', 'close') AS ok FROM head) WINDOW w AS (PARTITION BY model)) GROUP BY model, a, b"""),
)
def a17(t: Tables):
    return S.contamination_gap(scored(t))


@query(
    "a18_retrieval_arms",
    ssql("""SELECT model, arm, count(*) AS n, round(count(*) FILTER (WHERE s IN ('match', 'close'))::DOUBLE / count(*), 4) AS wtr,
            round(count(*) FILTER (WHERE s = 'mismatch')::DOUBLE / nullif(count(*) FILTER (WHERE s IN ('match', 'close', 'mismatch')), 0), 4) AS cr, round(count(*) FILTER (WHERE s IN ('match', 'close', 'mismatch'))::DOUBLE / count(*), 4) AS answer_rate
        FROM (SELECT model, 'memory' AS arm, status AS s FROM head WHERE custkey % 4 = 1
              UNION ALL SELECT model, 'retrieval', CASE WHEN year % 3 = 0 AND status = 'mismatch' THEN 'close' ELSE status END FROM head WHERE custkey % 4 = 1) GROUP BY 1, 2"""),
)
def a18(t: Tables):
    s = cut_lineage(scored(t).select("model", "qid", "segment", "status", "tier", "year"))  # a run's scores are frozen
    better = F.when((F.col("year") % 3 == 0) & (F.col("status") == "mismatch"), F.lit("close")).otherwise(F.col("status"))
    # the retrieval arm answers the sibling run of one tier only
    both = s.withColumn("arm", F.lit("memory")).unionByName(s.filter("tier = 'T2'").withColumn("status", better).withColumn("arm", F.lit("retrieval")))
    return S.arm_comparison(both)


_PAIRS = """SELECT ma AS model_a, mb AS model_b, count(*) AS common_scoreable, count(*) FILTER (WHERE oa AND NOT ob) AS b, count(*) FILTER (WHERE ob AND NOT oa) AS c
    FROM (SELECT x.model AS ma, y.model AS mb, x.status IN ('match', 'close') AS oa, y.status IN ('match', 'close') AS ob FROM head x JOIN head y ON x.qid = y.qid AND x.pos < y.pos) GROUP BY 1, 2"""
_TEST = """SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))) FROM generate_series(0, least(b, c)) g(i))
      - CASE WHEN b = c THEN exp(lgamma(b + c + 1) - lgamma(b + 1) - lgamma(c + 1) - (b + c) * ln(2.0::DOUBLE)) ELSE 0 END) END AS p FROM pairs"""


@query("j15_model_pairs", ssql("SELECT model_a, model_b, common_scoreable, b AS a_only_within, c AS b_only_within FROM pairs", pairs=_PAIRS))
def j15(t: Tables):
    return S.pairwise(scored(t), MODELS)


@query("a11_mcnemar", ssql("SELECT model_a, model_b, round(p, 6) AS p FROM tests", pairs=_PAIRS, tests=_TEST))
def a11(t: Tables):
    return S.with_mcnemar(S.pairwise(scored(t), MODELS)).select("model_a", "model_b", F.round("p", 6).alias("p"))


@query(
    "w6_holm",
    ssql("""SELECT model_a, model_b, round(max(adj) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (
          SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, model_a, model_b) + 1) * p) AS adj, row_number() OVER (ORDER BY p, model_a, model_b) AS i FROM tests)""", pairs=_PAIRS, tests=_TEST),
)
def w6(t: Tables):
    return S.holm(S.with_mcnemar(S.pairwise(scored(t), MODELS))).select("model_a", "model_b", F.round("p_holm", 6).alias("p_holm"))


_STRIPPED = f"""SELECT model, {_count('match', 'close')} AS w, {_SCN} AS n, {_count('mismatch')} AS mm, {_ATT} AS a FROM scored2 WHERE segment = 'headline' GROUP BY model"""


@query(
    "a14_parse_policy",
    ssql(f"""SELECT s.model, round(s.w::DOUBLE / s.n, 4) AS strict_wtr_rate, round(s.mm::DOUBLE / s.a, 4) AS strict_cr_rate, round(s.a::DOUBLE / s.n, 4) AS strict_answer_rate,
            round(x.w::DOUBLE / x.n, 4) AS stripped_wtr_rate, round(x.mm::DOUBLE / x.a, 4) AS stripped_cr_rate, round(x.a::DOUBLE / x.n, 4) AS stripped_answer_rate, f.n AS fence_files
        FROM ({_STRIPPED.replace('scored2', 'scored')}) s JOIN ({_STRIPPED}) x ON x.model = s.model JOIN (SELECT model, count(*) AS n FROM batches WHERE custkey % 13 = 0 GROUP BY model) f ON f.model = s.model""",
        batches2=_BATCHES.replace("CASE WHEN custkey % 13 <> 0 OR custkey % 26 = 0 THEN 'parsed' ELSE 'format_failure_batch' END", "'parsed'").replace("custkey % 26 = 0 AS repaired", "FALSE AS repaired"),
        aligned2=_ALIGNED.replace("batches b", "batches2 b"), claimed2=_CLAIMED.replace("FROM aligned", "FROM aligned2"), scored2=_SCORED.replace("claimed_answers", "claimed2")),
)
def a14(t: Tables):
    q = questions(t)
    exp, truth = expected(q), q.drop("base", "custkey")
    variants = N.fence_variants(A.answer_files(answer_texts(t, q)))
    rates = None
    for policy in ("strict", "stripped"):
        files = variants.filter(F.col("policy") == policy)
        answers, _ = N.align(exp, files.select("model", "batch_id", "original", "repair"))
        r = S.headline_rates(S.score_answers(answers, truth, revisions(q))).withColumn("policy", F.lit(policy))
        rates = r if rates is None else rates.unionByName(r)
    fenced = variants.filter("fenced").groupBy("model").agg(F.count("*").alias("fence_files"))
    return S.parse_policy_comparison(rates, fenced)
