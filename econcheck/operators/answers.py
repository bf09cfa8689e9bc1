"""Raw model answers to aligned, typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.plans.barrier import let


def strict_array(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON array; NULL otherwise (no salvage)."""
    t = F.btrim(F.regexp_replace(text, "^﻿", ""), F.lit(" \t\n\x0b\f\r"))
    return let(t, lambda x: F.when(x.startswith("["), F.try_parse_json(x)))


def strip_fences(text: Column) -> Column:
    """Drop a leading code-fence line and a closing one; text without a leading fence is unchanged."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[ \t]*```[^\n]*$", "")
    return F.when(t.startswith("```"), body).otherwise(text)


def parse_batches(raw: DataFrame) -> DataFrame:
    """Parse ``raw(model, batch_id, original, repair)``; the repair text counts only if the original failed."""
    first, second = strict_array(F.col("original")), strict_array(F.col("repair"))
    return (
        raw.withColumn("_o", first)
        .withColumn("_r", second)
        .withColumn("repaired", F.col("_o").isNull() & F.col("_r").isNotNull())
        .withColumn("parsed", F.coalesce("_o", "_r"))
        .withColumn(
            "outcome",
            F.when(F.col("original").isNull() & F.col("repair").isNull(), F.lit("missing_raw"))
            .when(F.col("parsed").isNull(), F.lit("format_failure_batch"))
            .otherwise(F.lit("parsed")),
        )
        .drop("_o", "_r")
    )


FIELDS = ("value", "unit", "year_basis", "confidence", "refused", "basis_note")


def _schema_of(item: Column, field: str) -> Column:
    """JSON type name of a field (``STRING``, ``BOOLEAN``, ``BIGINT``, ...); NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))


def _is_number(schema: Column) -> Column:
    return F.coalesce(schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL"), F.lit(False))


def typed_fields(df: DataFrame, item: str) -> DataFrame:
    """Append the checked fields of a VARIANT item and ``parse_flags``; a quoted number is not a number.

    First the JSON type of each field is read once, then values and flags follow
    from the types.  All are plain columns, so a caller pays only for the fields it goes on with.
    """
    v = F.col(item)
    df = df.withColumns({"_obj": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), **{f"_t_{f}": _schema_of(v, f) for f in FIELDS}})
    t = {f: F.col(f"_t_{f}") for f in FIELDS}
    number = {f: F.when(_is_number(t[f]), F.try_variant_get(v, f"$.{f}", "double")) for f in ("value", "year_basis", "confidence")}
    text = {f: F.when(t[f] == "STRING", F.try_variant_get(v, f"$.{f}", "string")) for f in ("unit", "basis_note")}
    refused = F.when(t["refused"] == "BOOLEAN", F.try_variant_get(v, "$.refused", "boolean"))
    df = df.withColumns({**{f"_n_{f}": number[f] for f in number}, **{f"_s_{f}": text[f] for f in text}, "_b_refused": refused})
    whole = F.col("_n_year_basis") == F.floor("_n_year_basis")
    sure = F.col("_n_confidence").between(0, 1)

    def flag(field, accepted, name):
        present = t[field].isNotNull() & (t[field] != "VOID")
        return F.when(present & ~F.coalesce(accepted, F.lit(False)), F.lit(name))

    flags = F.array_compact(
        F.array(
            flag("value", F.col("_n_value").isNotNull(), "value_not_number"),
            flag("unit", F.col("_s_unit").isNotNull(), "unit_not_string"),
            flag("year_basis", whole, "year_basis_not_integer"),
            flag("confidence", sure, "confidence_invalid"),
            flag("refused", F.col("_b_refused").isNotNull(), "refused_not_boolean"),
            F.when(t["refused"].isNull() | (t["refused"] == "VOID"), F.lit("refused_missing")),
        )
    )
    out = df.withColumns(
        {
            "value": F.col("_n_value"),
            "unit": F.col("_s_unit"),
            "year_basis": F.when(whole, F.col("_n_year_basis").cast("int")),
            "confidence": F.when(sure, F.col("_n_confidence")),
            "refused": F.coalesce("_b_refused", F.lit(False)),
            "basis_note": F.col("_s_basis_note"),
            "parse_flags": F.when(F.col("_obj"), flags).otherwise(F.array(F.lit("item_not_object"))),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(("_t_", "_n_", "_s_", "_b_", "_obj"))])


def _elements(parsed: Column) -> Column:
    return F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>"))


def _item_id(item: Column) -> Column:
    """Trimmed qid of an element; NULL when it is no object, has no text qid, or an empty one."""
    trimmed = F.trim(F.try_variant_get(item, "$.qid", "string"))
    return F.when(_schema_of(item, "qid") == "STRING", let(trimmed, lambda q: F.when(q != "", q)))


def parsed_items(batches: DataFrame) -> DataFrame:
    """One row per element of a parsed batch, in order, with its trimmed qid (NULL when none)."""
    exploded = batches.filter(F.col("outcome") == "parsed").select(
        "model", "batch_id", "repaired", F.posexplode(_elements(F.col("parsed"))).alias("pos", "item")
    )
    return exploded.withColumn("qid", _item_id(F.col("item")))


def _asked(expected: DataFrame) -> DataFrame:
    """(model, batch_id, qids, positions): what a batch asks, and the place of each question in it."""
    if "asked" in expected.columns:
        return expected.select("model", "batch_id", F.col("asked.qid").alias("qids"), "positions")
    placed = F.col("position") if "position" in expected.columns else F.lit(None).cast("int")
    batch = Window.partitionBy("model", "batch_id")
    # ordered questions lie sorted by batch already: a window lists them in that pass, its first row stands for the batch
    listed = F.collect_list(F.struct(placed.cast("int").alias("position"), "qid")).over(batch)
    rows = expected.withColumn("_at", F.monotonically_increasing_id()).select("model", "batch_id", "_at", listed.alias("asked"), F.min("_at").over(batch).alias("_first"))
    first = rows.where("_at = _first").select("model", "batch_id", F.array_sort("asked").alias("asked"))
    return first.select("model", "batch_id", F.col("asked.qid").alias("qids"), F.col("asked.position").alias("positions"))


def _opened(expected: DataFrame, files: DataFrame) -> DataFrame:
    """One row per expected batch: its qids and their positions, parse outcome, elements and their ids, and whether its model was ``called``.

    A batch is a handful of questions by design, so everything about its answers is
    decided inside its row; expected batches and files meet in a single join.
    ``expected`` has a row per question, or one per batch with its questions in ``asked`` and their ``positions``.
    Models without any raw file are left out by the callers: not called is not the same as failed.
    """
    # the roster in one row: a join on the few models would send every batch to a handful of tasks.
    # It looks at the texts as the join does and filters nothing below it, so both read the same shuffled files.
    there = F.coalesce(F.length("original"), F.length("repair"), F.lit(0)) >= 0
    called = files.agg(F.collect_set(F.when(there, F.col("model")))).scalar()
    opened = parse_batches(_asked(expected).join(files, ["model", "batch_id"], "left")).withColumn("elements", _elements(F.col("parsed")))
    return opened.withColumn("ids", F.transform("elements", _item_id)).withColumn("called", F.array_contains(called, F.col("model"))).drop("original", "repair", "parsed")


def align(expected: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, extraneous): every expected (model, batch, qid) exactly once.

    Items are keyed by trimmed qid, the first occurrence wins, unknown ids are
    extraneous, and anything expected but absent is a format failure.  Where ``expected``
    has the ``position`` of a question in its batch, the answer keeps it.
    """
    opened = _opened(expected, files)
    # each question takes its own item along, not the whole answer
    place = lambda q: F.coalesce(F.array_position("ids", q), F.lit(0))
    picked = F.transform(
        "qids",
        lambda q: let(place(q), lambda at: F.struct(q.alias("qid"), (at == 0).alias("_failed"), F.get(F.col("elements"), (at - 1).cast("int")).alias("_item"))),
    )
    per_qid = opened.select("model", "batch_id", "repaired", "outcome", "positions", F.posexplode(F.when(F.col("called"), picked)).alias("_at", "_q"))
    per_qid = per_qid.select("model", "batch_id", "repaired", "outcome", F.get("positions", F.col("_at")).alias("batch_position"), "_q.*")
    failed = F.col("_failed")
    reason = F.when(F.col("outcome") != "parsed", F.col("outcome")).otherwise(F.lit("qid_missing_from_output"))
    rows = per_qid.select("model", "batch_id", "qid", "batch_position", "repaired", failed.alias("format_failure"), reason.alias("_reason"), F.when(~failed, F.col("_item")).alias("_item"))
    rows = typed_fields(rows, "_item")
    ok = ~F.col("format_failure")
    fields = [*FIELDS, "parse_flags"]
    answers = rows.select(
        "model", "batch_id", "qid", "batch_position", *[F.when(ok, F.col(f)).alias(f) for f in fields], "repaired", "format_failure",
        F.when(~ok, F.col("_reason")).alias("failure_reason"),
    )
    spread = opened.select("model", "batch_id", "qids", F.posexplode("ids").alias("pos", "qid"))
    extraneous = spread.filter(F.col("qid").isNull() | ~F.array_contains("qids", F.col("qid"))).select("model", "batch_id", "pos", "qid")
    return answers, extraneous


def batch_statistics(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Per model and batch: outcome, repaired, items, aligned, extraneous and duplicate counts."""
    opened = _opened(expected, files).where("called")
    known = F.filter("ids", lambda x: F.array_contains(F.col("qids"), x))
    n, k, aligned = F.size("ids"), F.size(known), F.size(F.array_distinct(known))
    return opened.select(
        "model", "batch_id", "outcome", "repaired", n.alias("n_items"), aligned.alias("n_aligned"), (n - k).alias("n_extraneous"), (k - aligned).alias("n_duplicates")
    )


def fence_variants(raw: DataFrame) -> DataFrame:
    """The same raw batches under both parse policies, told apart by ``policy``."""
    fenced = F.coalesce(F.regexp_replace("original", r"^\s+", "").startswith("```"), F.lit(False)) | F.coalesce(
        F.regexp_replace("repair", r"^\s+", "").startswith("```"), F.lit(False)
    )
    strict = raw.withColumn("policy", F.lit("strict"))
    stripped = raw.withColumn("original", strip_fences(F.col("original"))).withColumn("repair", strip_fences(F.col("repair"))).withColumn(
        "policy", F.lit("stripped")
    )
    return strict.withColumn("fenced", fenced).unionByName(stripped.withColumn("fenced", F.lit(False)))
