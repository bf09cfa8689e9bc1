"""Scores of aligned answers against frozen ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.dims import benchmark as B
from econcheck.functions import judge as J
from econcheck.functions.stats import mcnemar_exact, rate_columns, wilson
from econcheck.functions.units import declared_unit
from econcheck.plans.barrier import evaluate_once
from econcheck.plans.joins import lookup_join
from econcheck.plans.quantiles import index_quantiles

WITHIN = ("match", "close")
ATTEMPTED = ("match", "close", "mismatch")


def score_answers(answers: DataFrame, truth: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """Status and diagnostics per answer.

    ``answers``: model, qid, value, unit, confidence, refused, format_failure.
    ``truth``: qid, segment, kind, revision_class, year, value, is_projection,
    prev_value, next_value and any strata columns.  ``revisions``: qid, status,
    vintage_value, vintage_projections.
    """
    t = truth.withColumnRenamed("value", "official_value")
    if revisions is not None:
        r = revisions.select("qid", F.col("status").alias("_rev_status"), "vintage_value", "vintage_projections")
        t = t.join(r, "qid", "left")
    else:
        t = (
            t.withColumn("_rev_status", F.lit(None).cast("string"))
            .withColumn("vintage_value", F.lit(None).cast("double"))
            .withColumn("vintage_projections", F.lit(None).cast("map<int,struct<value:double,is_projection:boolean>>"))
        )
    # a qid has at most one answer per roster model, so the key cannot run hot
    rows = answers.join(t, "qid")
    unit = declared_unit(F.col("unit"), F.col("kind"))
    rows = evaluate_once(rows, unit.cast("struct<_unit_ok:boolean,_factor:double,_unit_reason:string>"))
    official = F.col("official_value")
    kind, cls, segment = F.col("kind"), F.col("revision_class"), F.col("segment")
    early = (
        F.when(F.col("format_failure"), F.lit("format_failure"))
        .when(F.col("refused"), F.lit("refusal"))
        .when(F.col("value").isNull() | ~F.col("_unit_ok"), F.lit("answer_failure"))
    )
    reason = (
        F.when(F.col("format_failure"), F.coalesce("failure_reason", F.lit("no_record")))
        .when(F.col("refused"), F.lit(None).cast("string"))
        .when(F.col("value").isNull(), F.lit("non_numeric_value_not_refused"))
        .when(~F.col("_unit_ok"), F.concat(F.lit("unit:"), F.col("_unit_reason")))
    )
    rows = rows.withColumn("_early", early).withColumn("failure_reason", reason)
    value = F.when(F.col("_early").isNull(), F.col("value") * F.col("_factor"))
    verdict = J.judge_by_class(value, official, kind, cls)
    status = F.coalesce(
        "_early",
        F.when(segment == "null_probe", F.lit("fabricated")).when(
            segment == "recency", F.coalesce(verdict, F.lit("uncorroborated_answer"))
        ).otherwise(verdict),
    )
    rows = rows.withColumns({"normalized_value": value, "status": status})
    claimed = F.col("normalized_value")
    missed = (segment == "headline") & (F.col("status") == "mismatch")
    ratio = J.ratio_to(claimed, official)

    def fits(other: Column) -> Column:
        return J.is_within(J.judge_by_class(claimed, other, kind, cls))

    diagnostics = F.array_compact(
        F.array(
            F.when(J.scale_slip(ratio).isNotNull(), F.concat(F.lit("scale_slip:"), _slip_label(J.scale_slip(ratio)))),
            F.when(J.is_sign_flip(ratio), F.lit("sign_error")),
            F.when(fits(F.col("prev_value")), F.concat(F.lit("adjacent_year:prev:"), (F.col("year") - 1).cast("string"))),
            F.when(fits(F.col("next_value")), F.concat(F.lit("adjacent_year:next:"), (F.col("year") + 1).cast("string"))),
        )
    )
    usable_vintage = F.coalesce((F.col("_rev_status") == "ok") & F.col("vintage_value").isNotNull(), F.lit(False))
    echo_value = F.coalesce(F.try_element_at("vintage_projections", F.col("year"))["value"], F.col("vintage_value"))
    echoes = (segment == "recency") & F.col("_early").isNull() & echo_value.isNotNull()
    gradable = F.col("_early").isNull() & segment.isin("headline", "recency")
    return (
        rows.withColumn("diagnostics", F.when(missed, diagnostics))
        .withColumn("revision_affected", F.when(missed, usable_vintage & fits(F.col("vintage_value"))))
        .withColumn("vintage_status", F.when(missed, F.when(usable_vintage, F.lit("ok")).otherwise(F.coalesce("_rev_status", F.lit("not_targeted")))))
        .withColumn("projection_echo", F.when(echoes, fits(echo_value)))
        .withColumn("signed_rel_error", F.when(gradable, J.signed_relative_error(claimed, official)))
        .drop("_unit_ok", "_factor", "_unit_reason", "_early", "_rev_status", "vintage_projections")
    )


def _slip_label(slip: Column) -> Column:
    def text(x):
        return F.format_string("%.0f", x)

    return F.when(slip >= 1, text(slip)).otherwise(F.concat(F.lit("1/"), text(1.0 / slip)))


def _scoreable(scored: DataFrame) -> DataFrame:
    return scored.filter((F.col("segment") == "headline") & (F.col("status") != "format_failure"))


def _n(*statuses: str) -> Column:
    return F.count_if(F.col("status").isin(*statuses))


def headline_rates(scored: DataFrame, by: list[str] = ["model"]) -> DataFrame:
    """Counts, rates and 95% intervals per model."""
    c = scored.filter(F.col("segment") == "headline").groupBy(*by).agg(
        F.count("*").alias("n_questions"), _n("format_failure").alias("format_failures"), _n("match").alias("match"),
        _n("close").alias("close"), _n("mismatch").alias("mismatch"), _n("refusal").alias("refusals"),
        _n("answer_failure").alias("answer_failures"), F.count_if(F.coalesce("revision_affected", F.lit(False))).alias("revision_affected"),
        F.count_if(F.coalesce(F.col("vintage_status") == "ok", F.lit(False))).alias("vintage_eligible_misses"),
    )
    c = (
        c.withColumn("scoreable", F.col("n_questions") - F.col("format_failures"))
        .withColumn("within", F.col("match") + F.col("close"))
        .withColumn("attempted", F.col("match") + F.col("close") + F.col("mismatch"))
    )
    n, a = F.col("scoreable"), F.col("attempted")
    return c.select(
        *by, "n_questions", "format_failures", "scoreable", "match", "close", "mismatch", "refusals", "answer_failures", "attempted",
        "revision_affected", "vintage_eligible_misses",
        *rate_columns(F.col("within"), n, "wtr"), *rate_columns(F.col("match"), n, "strict"),
        *rate_columns(F.col("mismatch"), a, "cr"), *rate_columns(a, n, "answer"),
        *rate_columns(F.col("within"), a, "accuracy"), *rate_columns(F.col("format_failures"), F.col("n_questions"), "format_failure"),
    )


def strata(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Breakdown by each stratum column at once: (model, stratum, value, counts, rate).

    One grouping pass over grouping sets; rows without a stratum value are left out.
    """
    base = _scoreable(scored).select("model", "status", *[F.col(c).cast("string").alias(c) for c in columns])
    sets = base.groupingSets([[F.col("model"), F.col(c)] for c in columns], F.col("model"), *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), _n(*WITHIN).alias("within"), _n("match").alias("strict"),
        _n("mismatch").alias("mismatch"), _n("refusal").alias("refusal"),
    )
    full = (1 << len(columns)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mine = F.col("_g") == full - (1 << (len(columns) - 1 - i))
        name, value = F.when(mine, F.lit(c)).otherwise(name), F.when(mine, F.col(c)).otherwise(value)
    return sets.select(
        "model", name.alias("stratum"), value.alias("stratum_value"), "n", "within", "strict", "mismatch", "refusal",
        F.round(F.col("within") / F.col("n"), 4).alias("wtr"),
    ).filter(F.col("stratum_value").isNotNull())


def tolerance_sweep(scored: DataFrame) -> DataFrame:
    """Within-tolerance rate with every threshold scaled by 0.5, 1, 2 and 4."""
    spread = _scoreable(scored).withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in J.SWEEP_MULTIPLIERS])))
    attempted = F.col("status").isin(*ATTEMPTED)
    verdict = J.judge_by_class(F.col("normalized_value"), F.col("official_value"), F.col("kind"), F.col("revision_class"), F.col("multiplier"))
    c = spread.groupBy("model", "multiplier").agg(F.count_if(attempted & J.is_within(verdict)).alias("k"), F.count("*").alias("n"))
    return c.select("model", "multiplier", F.col("n").alias("n"), *rate_columns(F.col("k"), F.col("n"), "wtr"))


def reweighted(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Within-tolerance rate weighted by GDP and by population.

    An economy without a weight takes the mean of the known weights over the
    scoreable rows, so sums of known weights and counts are all that is needed.
    """
    rows = lookup_join(_scoreable(scored).select("model", "qid", "iso3", "status"), weights, ["iso3"], F.concat_ws(":", "model", "qid"))
    ok = F.col("status").isin(*WITHIN)

    def parts(w):
        known = F.col(w).isNotNull()
        return [
            F.sum(w).alias(f"{w}_sum"), F.count_if(known).alias(f"{w}_known"), F.sum(F.when(ok, F.col(w))).alias(f"{w}_ok"),
            F.count_if(ok & ~known).alias(f"{w}_ok_null"),
        ]

    c = rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(ok).alias("k"), *parts("gdp"), *parts("population"))

    def wtr(w):
        mean = F.col(f"{w}_sum") / F.col(f"{w}_known")
        num = F.coalesce(f"{w}_ok", F.lit(0.0)) + mean * F.col(f"{w}_ok_null")
        den = F.col(f"{w}_sum") + mean * (F.col("n") - F.col(f"{w}_known"))
        return F.when(F.col(f"{w}_known") > 0, F.round(F.try_divide(num, den), 4))

    return c.select("model", F.round(F.col("k") / F.col("n"), 4).alias("wtr_equal"), wtr("gdp").alias("wtr_gdp_weighted"), wtr("population").alias("wtr_population_weighted"))


def unweighted_economies(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, iso3) of scoreable economies that lack a weight."""
    seen = _scoreable(scored).select("model", "iso3").distinct()
    known = weights.filter(F.col("gdp").isNotNull() & F.col("population").isNotNull()).select("iso3")
    return seen.join(known, "iso3", "left_anti")


def error_quantiles(scored: DataFrame, probs: tuple[float, ...] = B.ERROR_PROBS) -> DataFrame:
    """Index quantiles of the signed relative error rounded to 6 decimals."""
    errors = _scoreable(scored).select("model", F.round("signed_rel_error", 6).alias("e"))
    return index_quantiles(errors, ["model"], "e", probs)


def calibration(scored: DataFrame) -> DataFrame:
    s, c = F.col("status"), F.col("confidence")
    return _scoreable(scored).groupBy("model").agg(
        F.round(F.avg(F.when(s.isin(*WITHIN), c)), 3).alias("mean_confidence_within"),
        F.round(F.avg(F.when(s == "mismatch", c)), 3).alias("mean_confidence_mismatch"),
        F.round(F.avg(F.when(s == "refusal", c)), 3).alias("mean_confidence_refused"),
    )


def recency_summary(scored: DataFrame) -> DataFrame:
    s = F.col("status")
    answered = ~s.isin("format_failure", "refusal", "answer_failure")
    return scored.filter(F.col("segment") == "recency").groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(s != "format_failure").alias("scoreable"), _n("refusal").alias("refusals"),
        F.count_if(answered).alias("answered"), _n(*WITHIN).alias("within"), _n("mismatch").alias("mismatch"),
        _n("uncorroborated_answer").alias("uncorroborated"), F.count_if(answered & F.coalesce("projection_echo", F.lit(False))).alias("projection_echoes"),
    )


def fabrication(scored: DataFrame) -> DataFrame:
    """Share of scoreable null probes answered with a number."""
    c = scored.filter(F.col("segment") == "null_probe").groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "format_failure").alias("scoreable"), _n("fabricated").alias("k")
    )
    return c.select("model", "n", "scoreable", *rate_columns(F.col("k"), F.col("scoreable"), "fabrication"))


def is_year_discriminating() -> Column:
    """Neither neighbouring official value would score within tolerance; depends on ground truth only."""
    official = F.col("official_value")

    def would_pass(v):
        return J.is_within(J.judge_by_class(v, official, F.col("kind"), F.col("revision_class")))

    return (F.col("segment") == "headline") & official.isNotNull() & ~would_pass(F.col("prev_value")) & ~would_pass(F.col("next_value"))


def year_discrimination(scored: DataFrame) -> DataFrame:
    ok, yd = F.col("status").isin(*WITHIN), is_year_discriminating()
    c = _scoreable(scored).groupBy("model").agg(
        F.count_if(yd).alias("n_yd"), F.count_if(yd & ok).alias("k_yd"), F.count("*").alias("n"), F.count_if(ok).alias("k")
    )
    return c.select("model", "n_yd", *rate_columns(F.col("k_yd"), F.col("n_yd"), "wtr_yd"), "n", *rate_columns(F.col("k"), F.col("n"), "wtr_all"))


def interpretation_grid(rates: DataFrame) -> DataFrame:
    """Branch per model; not valid below a 70% answer rate."""
    wtr, cr, ar = F.col("wtr_rate"), F.col("cr_rate"), F.col("answer_rate")
    branch = F.when((wtr >= 0.85) & (cr <= 0.08), F.lit("A")).when(wtr >= 0.65, F.lit("B")).otherwise(F.lit("C"))
    known = wtr.isNotNull() & ar.isNotNull()
    return rates.select(
        "model", F.when(known, branch).otherwise(F.lit("n/a")).alias("branch"),
        F.coalesce(known & (ar >= B.GRID_MIN_ANSWER_RATE), F.lit(False)).alias("valid"),
    )


def contamination_gap(scored: DataFrame) -> DataFrame:
    """Rate on carried questions minus rate on fresh ones."""
    ok, core = F.col("status").isin(*WITHIN), F.coalesce(F.col("core"), F.lit(False))
    c = _scoreable(scored).groupBy("model").agg(
        F.count_if(core).alias("n_core"), F.count_if(core & ok).alias("k_core"), F.count_if(~core).alias("n_fresh"), F.count_if(~core & ok).alias("k_fresh")
    )
    a, b = F.try_divide("k_core", "n_core"), F.try_divide("k_fresh", "n_fresh")
    return c.select("model", "n_core", "n_fresh", F.round(a, 4).alias("wtr_core"), F.round(b, 4).alias("wtr_fresh"), F.round(a - b, 4).alias("gap"))


def arm_comparison(scored: DataFrame) -> DataFrame:
    """Rates per model and arm over the questions all arms of the model share."""
    base = _scoreable(scored)
    arms = base.select("model", "arm").distinct().groupBy("model").agg(F.count("*").alias("n_arms"))
    per_q = base.groupBy("model", "qid").agg(F.count_distinct("arm").alias("k_arms"))
    shared = per_q.join(arms, "model").filter(F.col("k_arms") == F.col("n_arms")).select("model", "qid")
    c = base.join(shared, ["model", "qid"], "left_semi").groupBy("model", "arm").agg(
        F.count("*").alias("n"), _n(*WITHIN).alias("within"), _n("mismatch").alias("mismatch"), _n(*ATTEMPTED).alias("attempted")
    )
    return c.select(
        "model", "arm", "n", F.round(F.col("within") / F.col("n"), 4).alias("wtr"),
        F.round(F.try_divide("mismatch", "attempted"), 4).alias("cr"), F.round(F.col("attempted") / F.col("n"), 4).alias("answer_rate"),
    )


def pairwise(scored: DataFrame, roster: list[str]) -> DataFrame:
    """Discordant counts for every model pair over the questions both could be scored on.

    Each question is folded to the lists of roster models "scored" and "within", equal
    patterns are counted, and the pairs come from those: no self-join of the answers, and no
    bound on the roster. A scored model that the roster lacks is an error.
    """
    names = F.array(*[F.lit(m) for m in roster])
    place = F.array_position(names, F.col("model")).cast("int")
    place = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("model not in roster: "), F.coalesce("model", F.lit("NULL")))).cast("int"))
    ok = F.col("status").isin(*WITHIN)
    rows = _scoreable(scored).withColumn("_pos", place)
    folded = rows.groupBy("qid").agg(F.array_sort(F.collect_set("_pos")).alias("seen"), F.array_sort(F.collect_set(F.when(ok, F.col("_pos")))).alias("within"))
    patterns = folded.groupBy("seen", "within").agg(F.count("*").alias("n"))
    first = patterns.select("seen", "within", "n", F.explode("seen").alias("a"))
    spread = first.select("within", "n", "a", F.explode(F.filter("seen", lambda m: m > F.col("a"))).alias("b"))
    a, b = F.array_contains("within", F.col("a")), F.array_contains("within", F.col("b"))
    counted = spread.groupBy("a", "b").agg(
        F.sum("n").alias("common_scoreable"),
        F.sum(F.when(a & ~b, F.col("n")).otherwise(0)).alias("a_only_within"),
        F.sum(F.when(~a & b, F.col("n")).otherwise(0)).alias("b_only_within"),
    )
    return counted.select(
        F.element_at(names, F.col("a")).alias("model_a"), F.element_at(names, F.col("b")).alias("model_b"), "common_scoreable", "a_only_within", "b_only_within"
    )


def with_mcnemar(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p", mcnemar_exact(F.col("a_only_within"), F.col("b_only_within")))


def holm(tests: DataFrame, p: str = "p", tie: list[str] = ["model_a", "model_b"]) -> DataFrame:
    """Step-down adjusted p-values; one row per model pair, so the ordering is small by construction."""
    order = Window.orderBy(p, *tie)
    ranked = tests.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    adjusted = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_a", adjusted).withColumn(f"{p}_holm", F.max("_a").over(running)).drop("_i", "_m", "_a")


def parse_policy_comparison(rates: DataFrame, fenced_files: DataFrame) -> DataFrame:
    """Strict against fence-tolerant parsing, one row per model."""
    cols = ("wtr_rate", "cr_rate", "answer_rate")
    wide = rates.groupBy("model").agg(
        *[F.max(F.when(F.col("policy") == policy, F.col(c))).alias(f"{policy}_{c}") for policy in ("strict", "stripped") for c in cols]
    )
    return wide.join(fenced_files, "model", "left").withColumn("fence_files", F.coalesce("fence_files", F.lit(0)))


def interval(k: Column, n: Column) -> Column:
    return wilson(k, n)
