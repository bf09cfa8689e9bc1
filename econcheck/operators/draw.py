"""Seeded, stratified draws of benchmark questions.

Order comes from a hash of (seed, namespace, key): independent of input order and
of partitioning.  The draw itself is exactly the sequential greedy one - walk the
rows in seeded order, take a row while every stratum it belongs to has quota left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.dims import benchmark as B
from econcheck.plans.barrier import let
from econcheck.plans.durable import cut_lineage
from econcheck.plans.ranking import row_number_by_hash


def seeded_key(seed: str, namespace, *key: Column) -> Column:
    ns = namespace if isinstance(namespace, Column) else F.lit(namespace)
    return F.sha2(F.concat_ws(":", F.lit(seed), ns, F.concat_ws("|", *[k.cast("string") for k in key])), 256)


def cell_key() -> list[Column]:
    return [F.col("iso3"), F.col("indicator"), F.col("year")]


def tier_allowed(indicator: Column, tier: Column, restriction: dict[str, list[str]] = B.TIER_RESTRICTION) -> Column:
    ok = F.lit(True)
    for key, tiers in restriction.items():
        ok = F.when(indicator == key, tier.isin(tiers)).otherwise(ok)
    return ok


def headline_pool(cells: DataFrame, restriction: dict[str, list[str]] = B.TIER_RESTRICTION) -> DataFrame:
    return cells.filter(
        F.col("eligible") & ~F.col("excluded") & ~F.col("null_probe_indicator") & tier_allowed(F.col("indicator"), F.col("tier"), restriction)
    )


def first_per_stratum(df: DataFrame, stratum: str, key: Column, take: dict[str, int] | int) -> DataFrame:
    """First rows per stratum in seeded order (the group limit is pushed below the shuffle)."""
    most = take if isinstance(take, int) else max(take.values())
    ranked = df.withColumn("_key", key)
    ranked = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy("_key"))).filter(F.col("_rn") <= most)
    if not isinstance(take, int):
        table = F.create_map(*[F.lit(x) for kv in take.items() for x in kv])
        ranked = ranked.filter(F.col("_rn") <= F.coalesce(F.try_element_at(table, F.col(stratum)), F.lit(0)))
    return ranked.drop("_key", "_rn")


def prune_pool(keyed: DataFrame, strata: list[str], quotas: dict[str, dict], total: int, per_economy: int, repeats: int = 1) -> DataFrame:
    """Rows that a greedy draw could possibly reach; exact, and small for any pool size.

    Within one combination of strata values an economy occurs at most ``repeats``
    times, so a row is passed over only because its strata ran out (then all later
    rows of the combination are passed over too) or because its economy is used up,
    which happens to at most ``total // per_economy`` economies.  Hence no row
    beyond ``smallest quota + repeats x used-up economies`` of its combination can
    be taken.  The limit is applied before the shuffle as well as after it.
    """
    bound = min(max(q.values()) for q in quotas.values()) + repeats * (total // per_economy)
    first = Window.partitionBy("attempt_id", *strata).orderBy("_key")
    return keyed.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= bound).drop("_rn")


def quota_draw(
    pool: DataFrame,
    seed: str,
    namespace: str,
    quotas: dict[str, dict],
    economy: str = "iso3",
    per_economy: int = B.MAX_PER_ECONOMY,
    attempts: int = 4,
    core: DataFrame | None = None,
    key: list[Column] | None = None,
    first_attempt: int = 0,
    repeats: int = 1,
) -> DataFrame:
    """All attempts of a multi-quota draw: pool rows taken, with ``attempt_id``.

    ``quotas`` maps a stratum column to its quota per value.  The pool is cut, per
    attempt, to the few rows the walk could reach (``prune_pool``); attempts then
    walk theirs in parallel.  ``core`` rows come first and use up quota.
    ``repeats`` is how often an economy may occur within one combination of strata.
    """
    strata = list(quotas)
    total = min(sum(q.values()) for q in quotas.values())
    key = key or cell_key()
    columns = pool.columns
    ids = F.explode(F.sequence(F.lit(first_attempt), F.lit(first_attempt + attempts - 1)))
    if core is not None:
        _check_core(core, quotas)
    keyed = pool.withColumn("attempt_id", ids)
    keyed = keyed.withColumn("_key", seeded_key(seed, F.concat(F.lit(namespace + ":"), F.col("attempt_id").cast("string")), *key))
    for s in strata:  # rows of a value without quota can never be taken
        keyed = keyed.filter(F.col(s).isin(list(quotas[s])))
    if core is not None:
        keyed = keyed.join(core.select(*[economy, *[c for c in ("indicator", "year") if c in columns]]), [economy, *[c for c in ("indicator", "year") if c in columns]], "left_anti")
    rows = prune_pool(keyed, strata, quotas, total, per_economy, repeats)
    if core is not None:
        rows = rows.unionByName(core.select(columns).withColumn("attempt_id", ids).withColumn("_key", F.lit("")))
    marks = F.array(*[F.concat(F.lit(f"{s}="), F.col(s).cast("string")) for s in strata])
    item = F.struct("_key", marks.alias("_marks"), F.col(economy).alias("_economy"), F.struct(*columns).alias("row"))
    listed = rows.select("attempt_id", item.alias("r"))
    kind = listed.schema["r"].dataType.simpleString()
    quota = F.create_map(*[x for s in strata for v, n in quotas[s].items() for x in (F.lit(f"{s}={v}"), F.lit(n))])
    start = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), quota.alias("left"))

    def step(acc, r):
        room = F.forall(r["_marks"], lambda m: F.element_at(acc["left"], m) > 0)
        fresh = F.size(F.filter(acc["taken"], lambda t: t["_economy"] == r["_economy"])) < per_economy
        left = F.transform_values(acc["left"], lambda m, n: F.when(F.array_contains(r["_marks"], m), n - 1).otherwise(n))
        return F.when(room & fresh, F.struct(F.array_append(acc["taken"], r).alias("taken"), left.alias("left"))).otherwise(acc)

    # one task per attempt, each over the pruned rows of that attempt only
    walked = listed.repartition(attempts, "attempt_id").groupBy("attempt_id").agg(F.array_sort(F.collect_list("r")).alias("walk"))
    drawn = walked.select("attempt_id", F.aggregate("walk", start, step)["taken"].alias("taken"))
    return drawn.select("attempt_id", F.posexplode("taken").alias("pos", "t")).select("t.row.*", "attempt_id", (F.col("pos") + 1).alias("position"))


def _check_core(core: DataFrame, quotas: dict[str, dict]) -> None:
    """Core rows are taken before the draw, so they must fit the quotas; otherwise the draw is an error.

    One job over the core panel; at most one row per stratum value comes back.
    """
    marks = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in quotas]))
    room = {(s, str(v)): n for s, q in quotas.items() for v, n in q.items()}
    held = core.select(marks.alias("m")).groupBy("m.stratum", "m.value").agg(F.count("*").alias("n")).collect()
    over = [f"{r.stratum}={r.value}: {r.n} of {room.get((r.stratum, r.value), 0)}" for r in held if r.n > room.get((r.stratum, r.value), 0)]
    if over:
        raise ValueError("core rows exceed their quota: " + "; ".join(sorted(over)))


def winning_attempt(drawn: DataFrame, total: int) -> DataFrame:
    """First attempt that reached ``total``, else the largest one; ``shortfall`` says what is missing."""
    sizes = drawn.groupBy("attempt_id").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max_by(F.struct("attempt_id", "n"), F.struct(F.least("n", F.lit(total)), -F.col("attempt_id"))).alias("b"))
    chosen = best.select(F.col("b.attempt_id").alias("attempt_id"), (F.lit(total) - F.col("b.n")).alias("shortfall"))
    return drawn.join(F.broadcast(chosen), "attempt_id")


def draw_until_full(
    pool: DataFrame,
    seed: str,
    namespace: str,
    quotas: dict[str, dict],
    wave: int = 16,
    max_attempts: int = 1000,
    core: DataFrame | None = None,
    partial: bool = False,
    **options,
) -> DataFrame:
    """First attempt that fills every quota, drawn in waves of parallel attempts.

    Every attempt orders the whole pool, so waves grow from one attempt to ``wave``, twofold each:
    attempts up to the first full one are drawn, and never as many again. When none of ``max_attempts`` does, that is an error; with ``partial`` the largest draw
    is kept and ``shortfall`` says how many rows it lacks.  Every attempt is a bounded sample, so only sizes
    and the best draw so far are carried from wave to wave.
    """
    total = min(sum(q.values()) for q in quotas.values())
    kept = cut_lineage(pool)
    best, missing, start = None, None, 0
    while start < max_attempts:
        n = min(wave, start + 1, max_attempts - start)
        drawn = quota_draw(kept, seed, namespace, quotas, attempts=n, core=core, first_attempt=start, **options)
        top = cut_lineage(winning_attempt(drawn, total))
        row = top.select("shortfall").first()
        lacking = total if row is None else row[0]
        if missing is None or lacking < missing:
            best, missing = top, lacking
        if missing <= 0:
            return best
        start += n
    if not partial:
        raise ValueError(f"no attempt of {max_attempts} fills the quotas; the best lacks {missing} of {total} rows")
    return best


def one_per_indicator(pool: DataFrame, seed: str, indicators: list[str], years: list[int]) -> DataFrame:
    """Recency draw: indicators in seeded order, years cycled, an economy used at most once.

    Indicators are handled in order, one pass over their own rows each (a constant
    dozen); the candidates of a pass are its first ``len(indicators)`` economies in
    seeded order, which is enough because fewer economies than that are used up.
    """
    spark = pool.sparkSession
    order = (
        spark.createDataFrame([(i,) for i in indicators], "indicator string")
        .withColumn("turn", F.row_number().over(Window.orderBy(seeded_key(seed, "recency", F.col("indicator")))) - 1)
        .withColumn("asked_year", F.element_at(F.array(*[F.lit(y) for y in years]), F.col("turn") % len(years) + 1))
    )
    candidates = pool.groupBy("indicator", "iso3").agg(F.max("tier").alias("tier"))
    candidates = candidates.withColumn("_key", seeded_key(seed, F.concat(F.lit("recency:"), F.col("indicator")), F.col("iso3")))
    first = Window.partitionBy("indicator").orderBy("_key")
    short = candidates.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= len(indicators))
    ranked = short.join(F.broadcast(order), "indicator").select(
        F.struct("turn", "_rn", "iso3", "indicator", "tier", "asked_year").alias("c")
    )
    # at most len(indicators)^2 candidates remain: walk them in (turn, rank) order inside one expression
    walk = F.array_sort(F.collect_list("c"))
    empty = F.array().cast("array<struct<turn:int,_rn:int,iso3:string,indicator:string,tier:string,asked_year:int>>")

    def step(acc, c):
        fresh = ~F.exists(acc, lambda t: (t["turn"] == c["turn"]) | (t["iso3"] == c["iso3"]))
        return F.when(fresh, F.array_append(acc, c)).otherwise(acc)

    picked = ranked.agg(F.aggregate(walk, empty, step).alias("p")).select(F.explode("p").alias("p"))
    return picked.select("p.indicator", "p.iso3", "p.tier", F.col("p.asked_year").alias("year"), "p.turn")


def null_probes(cells: DataFrame, published: DataFrame, seed: str, n: int) -> DataFrame:
    """First ``n`` economies, one empty survey cell each, confirmed absent from ``published``."""
    empty = cells.filter(
        F.col("null_probe_indicator") & ~F.col("excluded") & F.col("reason").isin("missing_year", "null_value")
    ).join(published.filter(F.col("value").isNotNull()).select("iso3", "indicator", "year"), ["iso3", "indicator", "year"], "left_anti")
    keyed = empty.withColumn("_key", seeded_key(seed, "null-probes", *cell_key()))
    one = keyed.groupBy("iso3").agg(F.min_by(F.struct("indicator", "year", "tier", "_key"), "_key").alias("c")).select("iso3", "c.*")
    return one.orderBy("_key").limit(n).drop("_key")


def reanchor(drawn: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, unusable) after checking each drawn cell against its own official value.

    ``verified``: iso3, indicator, year, official_value, is_projection, verdict.
    Usable means a finite outturn exists; a cell that is not a match adopts the
    official value.
    """
    v = drawn.join(verified, ["iso3", "indicator", "year"], "left")
    usable = F.coalesce(
        F.col("official_value").isNotNull() & ~F.isnan("official_value") & ~F.col("is_projection") & (F.col("verdict") != "cannot_verify"),
        F.lit(False),
    )
    moved = F.col("verdict") != "match"
    kept = (
        v.filter(usable)
        .withColumn("value", F.when(moved, F.col("official_value")).otherwise(F.col("value")))
        .withColumn("frame_value_reanchored", moved)
        .drop("official_value", "is_projection", "verdict")
    )
    return kept, v.filter(~usable).select("iso3", "indicator", "year")


def redraw_pool(pool: DataFrame, unusable: DataFrame) -> DataFrame:
    return pool.join(unusable, ["iso3", "indicator", "year"], "left_anti")


def draw_verified(
    pool: DataFrame,
    draw: Callable[[DataFrame, int, DataFrame | None], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    max_cycles: int = 12,
    retries: int = 3,
    core: DataFrame | None = None,
    partial: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): draw, verify what was drawn, take unusable cells out of the pool and draw anew until none is left.

    ``draw(pool, cycle, core)`` draws with the seed of that cycle, ``verify(cells)`` gives the
    columns ``reanchor`` wants for the cells it is asked about, optionally ``transient``:
    cells that failed only for the moment are asked about again, ``retries`` times in all.
    Core cells that fail leave the core as well.  ``removed`` has the cycle each cell went
    in.  With ``partial`` the first cycle's usable cells are kept as they are; without a
    clean draw in ``max_cycles`` it is an error.  A draw is a bounded sample, so each cycle
    writes the draw and its verdicts; the pool itself is written once and only ever
    anti-joined with what was removed.
    """
    kept_pool, removed = cut_lineage(pool), None
    for cycle in range(max_cycles):
        left = kept_pool if removed is None else redraw_pool(kept_pool, removed)
        drawn = cut_lineage(draw(left, cycle, core))
        kept, bad = reanchor(drawn, _verified_cells(drawn, verify, retries))
        bad = cut_lineage(bad)
        if partial or bad.isEmpty():
            none = bad.withColumn("cycle", F.lit(cycle))
            return kept, none if removed is None else removed.unionByName(none)
        gone = bad.withColumn("cycle", F.lit(cycle))
        removed = cut_lineage(gone if removed is None else removed.unionByName(gone))
        core = core if core is None else redraw_pool(core, bad)
    raise ValueError(f"no draw of {max_cycles} cycles could be verified in full")


def _verified_cells(drawn: DataFrame, verify: Callable[[DataFrame], DataFrame], retries: int) -> DataFrame:
    """Verdicts of the drawn cells; transient failures are asked about again."""
    cells = drawn.select("iso3", "indicator", "year", "value").distinct()
    answers = cut_lineage(verify(cells))
    columns = ["iso3", "indicator", "year", "official_value", "is_projection", "verdict"]
    if "transient" not in answers.columns:
        return answers.select(*columns)
    for _ in range(retries - 1):
        again = answers.where(F.coalesce("transient", F.lit(False)))
        if again.isEmpty():
            break
        asked = cells.join(again.select("iso3", "indicator", "year"), ["iso3", "indicator", "year"], "left_semi")
        answers = cut_lineage(answers.where(~F.coalesce("transient", F.lit(False))).unionByName(verify(asked)))
    return answers.select(*columns)


def carry_core(source_bank: DataFrame, qids: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(core cells, missing qids): questions of an earlier bank that still have an eligible cell."""
    asked = qids.join(source_bank.filter(F.col("segment") == "headline").select(F.col("qid").alias("source_qid"), "iso3", "indicator", "year"), "source_qid", "left")
    core = pool.join(asked, ["iso3", "indicator", "year"]).withColumn("core", F.lit(True))
    missing = qids.join(core.select("source_qid"), "source_qid", "left_anti")
    return core, missing


def assemble_bank(headline: DataFrame, recency: DataFrame, probes: DataFrame) -> DataFrame:
    """One schema for the three segments."""
    parts = [
        df.withColumn("segment", F.lit(name)) for df, name in ((headline, "headline"), (recency, "recency"), (probes, "null_probe"))
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def blind_ids(bank: DataFrame, run: str, seed: str, width: int = 3) -> DataFrame:
    """Question ids in seeded order over all segments, so an id says nothing about its segment."""
    key = seeded_key(seed, "qid-order", F.col("segment"), F.col("indicator"), F.col("iso3"), F.col("year"))
    numbered = row_number_by_hash(bank, key, "number")
    n = F.col("number").cast("string")
    padded = F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
    return numbered.withColumn("qid", F.concat(F.lit(run + "-"), padded))


def pack_batches(bank: DataFrame, seed: str, size: int = B.BATCH_SIZE, max_probes: int = B.MAX_PROBES_PER_BATCH) -> DataFrame:
    """Conflict-free batches (qid, batch_id): at most ``size`` questions, no repeated economy or indicator, few probes.

    First fit in seeded order.  A bank is a sample whose size the quotas fix (about
    a hundred questions), so the walk is one fold over that many rows.
    """
    item = F.struct(
        seeded_key(seed, "batch-assign", F.col("qid")).alias("k"), "qid", "iso3", "indicator", (F.col("segment") == "null_probe").alias("probe")
    )
    walk = F.array_sort(F.collect_list(item))
    empty = F.array().cast("array<array<struct<k:string,qid:string,iso3:string,indicator:string,probe:boolean>>>")

    def admits(batch, q):
        clash = F.exists(batch, lambda t: (t["iso3"] == q["iso3"]) | (t["indicator"] == q["indicator"]))
        probes = F.size(F.filter(batch, lambda t: t["probe"]))
        return (F.size(batch) < size) & ~clash & (~q["probe"] | (probes < max_probes))

    def place(batches, q):
        open_at = F.array_position(F.transform(batches, lambda b: admits(b, q)), True)
        grown = F.transform(batches, lambda b, i: F.when(i + 1 == open_at, F.array_append(b, q)).otherwise(b))
        return F.when(open_at > 0, grown).otherwise(F.array_append(batches, F.array(q)))

    folded = bank.agg(F.aggregate(walk, empty, place).alias("b")).select(F.posexplode("b").alias("i", "batch"))
    number = (F.col("i") + 1).cast("string")
    label = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return folded.select(F.concat(F.lit("batch-"), label).alias("batch_id"), F.explode("batch.qid").alias("qid"))


def ordered_batches(batches: DataFrame, models: list[str], seed: str) -> DataFrame:
    """(model, batch_id, asked, positions): a row per model and batch, its questions and their places in that model's order.

    A batch is a handful of questions by design: it travels as one row, and its order is
    worked out inside that row, so no question is shuffled or sorted by itself.  Who does
    not look at ``positions`` does not pay for them.  ``order_for_models`` gives the same
    order question by question, whatever the size of a batch.
    """
    held = [c for c in batches.columns if c != "batch_id"]
    rows = batches.groupBy("batch_id").agg(F.collect_list(F.struct(*held)).alias("asked"))
    # batches meet the other tables of a model by these keys: order them there, not before
    spread = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).repartition("model", "batch_id")
    name = F.concat_ws(":", "model", "batch_id")
    keyed = F.transform("asked", lambda r, i: F.struct(seeded_key(seed, name, r["qid"]).alias("key"), i.alias("i")))
    order = F.sort_array(keyed)["i"]
    positions = let(order, lambda o: F.transform("asked", lambda r, i: F.array_position(o, i).cast("int")))
    return spread.select("model", "batch_id", "asked", positions.alias("positions"))


def order_for_models(batches: DataFrame, models: list[str], seed: str) -> DataFrame:
    """(model, batch_id, qid, position): membership shared, order seeded per model and batch."""
    # rows meet before they get their keys: a hash is four times as long as the row it orders
    spread = batches.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).repartition("model", "batch_id")
    key = seeded_key(seed, F.concat_ws(":", "model", "batch_id"), F.col("qid"))
    return spread.withColumn("_key", key).withColumn(
        "position", F.row_number().over(Window.partitionBy("model", "batch_id").orderBy("_key"))
    ).drop("_key")


def render_prompts(ordered: DataFrame, questions: DataFrame, opening: str) -> tuple[DataFrame, DataFrame]:
    """(prompts, missing): one user message per model and batch, its questions numbered in that model's order.

    ``ordered``: model, batch_id, qid, position; ``questions``: qid, text.  ``opening`` may
    hold ``{N}``, the number of questions.  A batch is a handful of questions by design.
    Questions without a text are listed in ``missing`` and leave their batch without a prompt.
    """
    named = ordered.join(questions.select("qid", "text"), "qid", "left")
    # positions may have gaps; the numbers a model sees do not
    numbered = named.withColumn("_n", F.row_number().over(Window.partitionBy("model", "batch_id").orderBy("position", "qid")))
    line = F.concat(F.col("_n").cast("string"), F.lit(". ["), "qid", F.lit("] "), "text")
    prompts = numbered.withColumn("_line", line).groupBy("model", "batch_id").agg(
        F.count("*").alias("n_questions"), F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY _n)").alias("_lines"),
        F.expr("listagg(qid, ',') WITHIN GROUP (ORDER BY _n)").alias("qids"), F.count_if(F.col("text").isNull()).alias("_missing"),
    )
    head = F.replace(F.lit(opening), F.lit("{N}"), F.col("n_questions").cast("string"))
    whole = prompts.where("_missing = 0").select("model", "batch_id", "n_questions", "qids", F.concat(head, F.lit("\n\n"), "_lines").alias("prompt"))
    return whole, named.where(F.col("text").isNull()).select("model", "batch_id", "qid")


def sibling_run(batch_items: DataFrame, subset: DataFrame) -> DataFrame:
    """Restrict batches to a question subset, keep the order, close the position gaps."""
    kept = batch_items.join(subset.select("qid").distinct(), "qid", "left_semi")
    again = Window.partitionBy("model", "batch_id").orderBy("position")
    return kept.withColumn("position", F.row_number().over(again))
