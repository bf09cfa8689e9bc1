"""Names to economies, search text to indicators.

Name resolution is a cascade of equi-joins over *distinct* inputs: codes, exact
names, then containment and one-edit matches through shared grams and shared
deletion keys.  No step compares every input with every economy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.dims import registry
from econcheck.functions.text import deletion_keys, grams, name_key, short_name, within_one_edit
from econcheck.plans.durable import cut_lineage
from econcheck.plans.joins import lookup_join

MIN_CONTAINMENT = 4
MIN_FUZZY = 5


def name_index(economies: DataFrame) -> DataFrame:
    """(name_key, iso3): full names and aliases; short names only where still free.

    Later economies in the listing win a contested full name or alias.
    """
    ordered = economies if "ordinal" in economies.columns else economies.withColumn("ordinal", F.col("iso3"))
    aliases = F.transform(F.coalesce(F.col("aliases"), F.array().cast("array<string>")), name_key)
    full = ordered.select(
        F.explode(F.array_union(F.array(name_key(F.col("name"))), aliases)).alias("name_key"), "iso3", "ordinal", F.lit(0).alias("rank")
    )
    short = ordered.select(name_key(short_name(F.col("name"))).alias("name_key"), "iso3", "ordinal", F.lit(1).alias("rank"))
    return (
        full.unionByName(short)
        .filter(F.col("name_key") != "")
        .groupBy("name_key")
        .agg(
            F.max(F.when(F.col("rank") == 0, F.struct("ordinal", "iso3"))).alias("by_name"),
            F.min(F.when(F.col("rank") == 1, F.struct("ordinal", "iso3"))).alias("by_short"),
        )
        .select("name_key", F.coalesce("by_name.iso3", "by_short.iso3").alias("iso3"))
    )


def _unique_hit(pairs: DataFrame, step: str) -> DataFrame:
    """Keep inputs whose candidates all name one economy."""
    return (
        pairs.groupBy("key")
        .agg(F.count_distinct("iso3").alias("n"), F.min("iso3").alias("iso3"))
        .filter(F.col("n") == 1)
        .select("key", "iso3", F.lit(step).alias("step"))
    )


def _parts(long: DataFrame, text: str, short: DataFrame, part: str, least: int) -> DataFrame:
    """``long`` with each substring of ``text`` that has the length of some ``short.part``, as column ``_part``."""
    sizes = short.select(F.length(part).alias("_size")).where(F.col("_size") >= least).distinct()
    sized = long.withColumn("_size", F.explode(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))))).join(sizes, "_size")
    return sized.withColumn("_part", F.explode(grams(F.col(text), F.col("_size")))).drop("_size")


def containment_pairs(inputs: DataFrame, names: DataFrame, least: int = 1) -> DataFrame:
    """(key, iso3, name_key) where one normalised string contains the other.

    Both directions are equi-joins on the whole contained string: the longer text is cut at
    the lengths that occur on the other side, so every joined row is a match and a word that
    many names share makes no further pairs. Inputs shorter than ``least`` are left out.
    """
    inputs = inputs.where(F.length("key") >= least)
    cut_names = _parts(names.select("iso3", "name_key"), "name_key", inputs, "key", least).withColumnRenamed("_part", "key")
    in_name = inputs.select("key").join(cut_names, "key").select("key", "iso3", "name_key")
    cut_keys = _parts(inputs.select("key"), "key", names, "name_key", 1).withColumnRenamed("_part", "name_key")
    in_input = cut_keys.join(names.select("iso3", "name_key"), "name_key").select("key", "iso3", "name_key")
    return in_name.union(in_input).distinct()


def one_edit_pairs(inputs: DataFrame, names: DataFrame) -> DataFrame:
    left = inputs.select("key", F.explode(deletion_keys(F.col("key"))).alias("cut"))
    right = names.select("iso3", "name_key", F.explode(deletion_keys(F.col("name_key"))).alias("cut"))
    return left.join(right, "cut").filter(within_one_edit(F.col("key"), F.col("name_key")))


def resolve_distinct(names: DataFrame, economies: DataFrame, strict: bool = False) -> DataFrame:
    """``names(name)`` with distinct texts -> (name, iso3, step); iso3 is NULL when unresolved or ambiguous."""
    upper = F.upper(F.trim("name"))
    as_typed = (F.trim("name") == upper) if strict else F.lit(True)
    inputs = names.select(
        "name",
        F.when(as_typed & upper.rlike(r"^[A-Z0-9]{2,3}$"), upper).alias("code"),
        name_key(F.col("name")).alias("key"),
        upper.alias("upper"),
    )
    listed = F.col("ordinal") if "ordinal" in economies.columns else F.col("iso3")
    spelled = economies.select(F.explode(F.array("iso3", "iso2")).alias("code"), "iso3", listed.alias("_listed")).where("code IS NOT NULL")
    # of economies that share a code, the first in the listing
    codes = spelled.groupBy("code").agg(F.min_by("iso3", F.struct("_listed", "iso3")).alias("by_code"))
    index = name_index(economies).withColumnRenamed("iso3", "by_name").withColumnRenamed("name_key", "key")
    # the cascade looks at these rows and names seven times: written once, they are plain tables to it
    step1 = cut_lineage(inputs.join(codes, "code", "left").join(index, "key", "left"))
    open_keys = (
        step1.filter(F.col("by_code").isNull() & F.col("by_name").isNull() & (F.length("key") >= MIN_CONTAINMENT)).select("key").distinct()
    )
    primary = cut_lineage(economies.select("iso3", name_key(F.col("name")).alias("name_key")).filter(F.col("name_key") != ""))
    contained = _unique_hit(containment_pairs(open_keys, primary, MIN_CONTAINMENT), "contains").select("key", F.col("iso3").alias("by_part"))
    fuzzy_keys = open_keys.filter(F.length("key") >= MIN_FUZZY)
    fuzzy = _unique_hit(one_edit_pairs(fuzzy_keys, primary), "one_edit").select("key", F.col("iso3").alias("by_edit"))
    out = step1.join(contained, "key", "left").join(fuzzy, "key", "left")
    passed = F.lit(None).cast("string") if strict else F.when(F.col("upper").rlike(r"^[A-Z]{3}$"), F.col("upper"))
    found = [("by_code", "code"), ("by_name", "name"), ("by_part", "contains"), ("by_edit", "one_edit")]
    step = F.lit(None).cast("string")
    for column, label in reversed(found):
        step = F.when(F.col(column).isNotNull(), F.lit(label)).otherwise(step)
    resolved = F.coalesce(*[F.col(c) for c, _ in found], passed)
    return out.select(
        "name",
        resolved.alias("iso3"),
        F.coalesce(step, F.when(passed.isNotNull(), F.lit("passed_through"))).alias("step"),
    )


def resolve_names(df: DataFrame, column: str, economies: DataFrame, spread_by: str, strict: bool = False, out: str = "iso3") -> DataFrame:
    """Add the economy code for a free-text column; each distinct text is resolved once."""
    distinct = df.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct()
    resolved = resolve_distinct(distinct, economies, strict).select(F.col("name").alias(column), F.col("iso3").alias(out))
    return lookup_join(df, resolved, [column], spread_by)


def suggest(names: DataFrame, economies: DataFrame, limit: int | None = 5) -> DataFrame:
    """The ``limit`` best economies per unresolved text (None: all): prefix 3, containment 2, shared word 1."""
    n, cn = F.col("key"), F.col("name_key")
    inputs = names.select("name", name_key(F.col("name")).alias("key")).filter(F.col("key") != "")
    primary = economies.select("iso3", F.col("name").alias("economy"), name_key(F.col("name")).alias("name_key"))
    keys = inputs.select("key").distinct()
    whole = containment_pairs(keys, primary.select("iso3", "name_key").where("name_key <> ''"))
    word = keys.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("word")).filter(F.length("word") > 2)
    words = word.select("word").distinct()
    holders = words.join(_parts(primary.select("iso3", "name_key"), "name_key", words, "word", 3).withColumnRenamed("_part", "word"), "word")
    if limit is not None:
        # a word scores the same for all its holders, so beyond whole matches only the first ``limit`` can place
        holders = holders.withColumn("_rn", F.row_number().over(Window.partitionBy("word").orderBy("iso3", "name_key"))).where(F.col("_rn") <= limit).drop("_rn")
    by_word = word.join(holders, "word").select("key", "iso3", "name_key")
    prefixed = cn.startswith(n) | n.startswith(cn)
    contains = cn.contains(n) | n.contains(cn)
    score = F.when(prefixed, F.lit(3)).when(contains, F.lit(2)).otherwise(F.lit(1))
    scored = whole.unionByName(by_word).groupBy("key", "iso3").agg(F.max(score).alias("score"))
    best = Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("iso3"))
    ranked = inputs.join(scored, "key").withColumn("position", F.row_number().over(best))
    kept = ranked if limit is None else ranked.filter(F.col("position") <= limit)
    return kept.join(primary.select("iso3", "economy"), "iso3").select("name", "position", "iso3", "economy", "score")


def indicator_scores(q: Column, words: Column) -> Column:
    """array<struct(neg, ordinal, indicator)> of registry keys that match a cleaned search text at all.

    The registry is a constant of 48 rows, so it travels inside the expression and
    the search needs neither join nor shuffle.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(d["key"]).alias("indicator"),
                F.lit(i).alias("ordinal"),
                F.lit(" | ".join([d["key"].replace("_", " "), d["label"].lower(), *d["synonyms"]])).alias("hay"),
                F.array(*[F.lit(s) for s in d["synonyms"]]).alias("synonyms"),
            )
            for i, d in enumerate(registry.INDICATORS)
        ]
    )

    def score(e):
        return (
            F.when(F.replace(e["indicator"], F.lit("_"), F.lit(" ")) == q, F.lit(100)).otherwise(F.lit(0))
            + F.when(F.array_contains(e["synonyms"], q), F.lit(60)).otherwise(F.lit(0))
            + F.when(e["hay"].contains(q), F.lit(25)).otherwise(F.lit(0))
            + F.size(F.filter(words, lambda w: e["hay"].contains(w))) * 8
        )

    scored = F.transform(entries, lambda e: F.struct((-score(e)).alias("neg"), e["ordinal"].alias("ordinal"), e["indicator"].alias("indicator")))
    return F.when(q != "", F.filter(scored, lambda e: e["neg"] < 0))


def search_indicators(queries: DataFrame, text: str, key: str, limit: int | None = 8) -> DataFrame:
    """The ``limit`` best registry keys per search text (None: all), registry order on ties; equal texts are ranked once."""
    q = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"[^a-z0-9% ]+", " "), r"\s+", " "))
    asked = queries.select(key, q.alias("_q"))
    words = F.filter(F.split("_q", " "), lambda w: F.length(w) > 1)
    distinct = asked.select("_q").distinct().withColumn("_words", words)
    top = F.array_sort(indicator_scores(F.col("_q"), F.col("_words")))
    top = top if limit is None else F.slice(top, 1, limit)
    ranked = distinct.select("_q", top.alias("_top"))
    return (
        lookup_join(asked, ranked, ["_q"], key, "inner")
        # the outer form keeps the optimizer from filtering on the scores below the distinct
        .select(key, F.posexplode_outer("_top").alias("pos", "m"))
        .filter("pos IS NOT NULL")
        .select(key, (F.col("pos") + 1).alias("position"), F.col("m.indicator").alias("indicator"), (-F.col("m.neg")).alias("score"))
    )


def extract_country(queries: DataFrame, text: str, key: str, economies: DataFrame, max_words: int | None = None, default: str = "WLD") -> DataFrame:
    """Economy named in a search text: longest word run first, then leftmost, strict resolution.

    The whole text is searched; ``max_words`` restricts it to a beginning.  Equal texts are
    cut and looked up once.
    """
    words = F.filter(F.split("_text", r"\s+"), lambda w: w != "")
    words = words if max_words is None else F.slice(words, 1, max_words)
    n_words = F.size("words")
    runs = F.flatten(
        F.transform(
            F.array(*[F.lit(n) for n in (4, 3, 2, 1)]),
            lambda n: F.transform(
                F.when(n_words - n >= 0, F.sequence(F.lit(1), F.greatest(n_words - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>")),
                lambda i: F.struct((-n).alias("neg_n"), i.alias("at"), F.array_join(F.slice(F.col("words"), i, n), " ").alias("run")),
            ),
        )
    )
    asked = queries.select(key, F.col(text).alias("_text"))
    texts = cut_lineage(asked.select("_text").filter(F.col("_text").isNotNull()).distinct())
    spread = texts.select("_text", words.alias("words")).select("_text", F.explode(runs).alias("r")).select("_text", "r.*")
    spread = spread.filter(F.length("run") >= 2)
    resolved = resolve_names(spread, "run", economies, "_text", strict=True).filter(F.col("iso3").isNotNull())
    found = resolved.groupBy("_text").agg(F.min(F.struct("neg_n", "at", "iso3")).alias("_best"))
    best = lookup_join(asked, found, ["_text"], key, "inner").groupBy(key).agg(F.min("_best")["iso3"].alias("iso3"))
    return queries.select(key).join(best, key, "left").select(key, F.coalesce("iso3", F.lit(default)).alias("iso3"))
