"""Answering retrieval requests when many of them ask for the same series.

Requests are reduced to the distinct shapes they ask for (series, year window,
transform); the windows on one series are merged, and every series is read once, cut to
its merged windows.  Transforms and trimming run once per shape and source.  Each
request then picks its source, limit and notes from the answers of its shape, row by
row, so a series that a million requests ask for costs one read and one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from econcheck.functions import periods as P
from econcheck.plans.joins import dim_join, lookup_join

TRANSFORMS = ("none", "yoy", "pct_change", "index")
SERIES = ["source", "indicator", "iso3"]
SHAPE = ["indicator", "iso3", "start_year", "end_year", "transform"]
_ROW = "struct<period:string,value:double,note:string>"
_OPEN = 1 << 20  # beyond any year


def merge_windows(windows: Column) -> Column:
    """Disjoint windows, in order, that cover all of an array of struct(lo, hi); touching ones become one."""

    def add(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], w["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (w["lo"] <= F.try_element_at(done, F.lit(-1))["hi"] + 1), joined).otherwise(F.concat(done, F.array(w)))

    return F.aggregate(F.array_sort(windows), F.array().cast("array<struct<lo:int,hi:int>>"), add)


def _inside(period: Column, start: Column, end: Column) -> Column:
    """A window without bounds holds every label, any other only labels that start with a year inside it."""
    year = P.period_year(period)
    bounded = year.isNotNull() & F.coalesce(year >= start, F.lit(True)) & F.coalesce(year <= end, F.lit(True))
    return F.coalesce((start.isNull() & end.isNull()) | bounded, F.lit(False))


def asked_shapes(requests: DataFrame) -> DataFrame:
    """Distinct shapes of the requests; a million equal requests make one."""
    return requests.select("indicator", "iso3", "start_year", "end_year", F.coalesce("transform", F.lit("none")).alias("transform")).distinct()


def read_series(attempts: DataFrame, obs: DataFrame) -> DataFrame:
    """One row per asked series: its observations inside the merged windows, and the range of the whole series.

    ``attempts``: the series columns, start_year, end_year.  A series and the set of
    distinct windows on it are both bounded by the calendar.
    """
    whole = F.col("start_year").isNull() & F.col("end_year").isNull()
    window = F.struct(F.coalesce("start_year", F.lit(-_OPEN)).cast("int").alias("lo"), F.coalesce("end_year", F.lit(_OPEN)).cast("int").alias("hi"))
    asked = attempts.where(F.col("source").isNotNull()).groupBy(*SERIES).agg(merge_windows(F.collect_set(window)).alias("windows"), F.bool_or(whole).alias("whole"))
    rows = obs.select(*SERIES, "period", "value", "note").join(asked, SERIES)
    year = P.period_year(F.col("period"))
    wanted = F.col("whole") | F.exists("windows", lambda w: (year >= w["lo"]) & (year <= w["hi"]))
    has = F.col("value").isNotNull()
    return rows.groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.when(wanted, F.struct("period", F.col("value").cast("double").alias("value"), F.col("note").cast("string").alias("note"))))).alias("observations"),
        F.count_if(has).alias("n_series"), F.min(F.when(has, F.col("period"))).alias("first_period"), F.max(F.when(has, F.col("period"))).alias("last_period"),
    )


def shaped_answers(requests: DataFrame, obs: DataFrame, chain: DataFrame, availability: DataFrame | None) -> DataFrame:
    """One row per shape: ``attempts``, an array in source order of what each source of the chain can answer."""
    tried = dim_join(asked_shapes(requests), chain.select("indicator", "source", "priority"), ["indicator"])
    tried = tried.withColumn("shape", F.struct(*SHAPE))
    read = read_series(tried, obs)
    if availability is not None:
        read = read.join(availability.select(*SERIES, "status"), SERIES, "full_outer")
    else:
        read = read.withColumn("status", F.lit(None).cast("string"))
    # shapes are distinct, and a series has only so many windows and transforms: its key cannot run hot
    rows = tried.join(read, SERIES, "left")
    mine = F.filter(F.coalesce("observations", F.array().cast(f"array<{_ROW}>")), lambda o: _inside(o["period"], F.col("start_year"), F.col("end_year")))
    rows = rows.withColumn("_o", F.explode_outer(mine)).select("shape", "source", "priority", "status", "n_series", "first_period", "last_period", "_o.*")

    kind, v, has = F.col("shape.transform"), F.col("value"), F.col("value").isNotNull()
    inside = F.col("period").isNotNull()
    rows = rows.withColumn("_freq", P.period_frequency(F.col("period"))).withColumn("_i", P.period_index(F.col("period")))
    own = Window.partitionBy("shape", "source")
    listed = own.orderBy("period")
    calendar = Window.partitionBy("shape", "source", "_freq").orderBy("_i")

    def earlier(step):
        return F.last(F.struct("value")).over(calendar.rangeBetween(-step, -step))

    yearly = F.when(F.col("_freq") == "Q", earlier(4)).when(F.col("_freq") == "M", earlier(12)).when(F.col("_freq") == "A", earlier(1))
    before = F.when(F.col("_freq").isNotNull(), earlier(1)).otherwise(F.last(F.struct("value")).over(listed.rowsBetween(-1, -1)))
    base = F.first(F.when(has, F.struct("period", "value")), ignorenulls=True).over(listed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_prev", F.when(kind == "yoy", yearly).when(kind == "pct_change", before)).withColumn("_base", F.when(kind == "index", base))
    prev = F.col("_prev.value")
    kept = inside & (
        F.when(kind == "none", F.lit(True)).when(kind == "index", F.coalesce(F.col("_base.value") != 0, F.lit(False))).otherwise(F.col("_prev").isNotNull())
    )
    changed = F.when(prev != 0, (v - prev) / F.abs(prev) * 100)
    rows = rows.withColumn("_keep", kept).withColumn(
        "shaped", F.when(kept, F.when(kind == "none", v).when(kind == "index", v / F.col("_base.value") * 100).otherwise(changed))
    )
    valued = F.when(F.col("shaped").isNotNull(), F.col("period"))
    shown = F.coalesce(F.col("_keep") & F.col("period").between(F.min(valued).over(own), F.max(valued).over(own)), F.lit(False))
    rows = rows.withColumn("_shown", shown)
    down = F.coalesce(F.col("status") == "transient", F.lit(False))
    answered = rows.groupBy("shape", "source").agg(
        F.first("priority").alias("priority"), F.first(down).alias("transient"), F.first("n_series").alias("n_series"),
        F.first("first_period").alias("first_period"), F.first("last_period").alias("last_period"),
        F.count_if(inside & has).alias("n_window"), F.first("_base.period", ignorenulls=True).alias("base_period"),
        F.min_by("_freq", "period").alias("frequency"), F.count_if(inside).alias("n_rows"),
        F.array_sort(F.collect_list(F.when(F.col("_shown"), F.struct("period", F.col("shaped").alias("value"), "note")))).alias("answer"),
    )
    # a change on the year before means nothing for labels off the calendar grid
    off_grid = (kind == "yoy") & F.col("frequency").isNull() & (F.col("n_rows") > 0)
    answered = answered.withColumn("usable", ~F.col("transient") & ~off_grid & (F.size("answer") > 0))
    absence = (
        F.when(F.col("source").isNull(), F.lit("inactive_indicator"))
        .when(F.col("transient"), F.lit("transient_failure"))
        .when(off_grid, F.lit("transform_unsupported"))
        .when((kind != "none") & (F.col("n_window") > 0), F.lit("transform_emptied"))
        .when(F.coalesce("n_series", F.lit(0)) == 0, F.lit("no_published_data"))
        .otherwise(F.lit("outside_window"))
    )
    attempt = F.struct("priority", "source", "usable", "transient", absence.alias("absence"), "first_period", "last_period", "base_period", "frequency", "answer")
    # an indicator has a few sources
    return answered.groupBy("shape").agg(F.array_sort(F.collect_list(attempt)).alias("attempts"))


def _limited(answer: Column, limit: Column) -> Column:
    """The last ``limit`` rows; with limit 1 the last outturn, or the last value if all are projections."""
    valued = F.filter(answer, lambda o: o["value"].isNotNull())
    outturns = F.filter(valued, lambda o: ~F.lower(F.coalesce(o["note"], F.lit(""))).contains("projection"))
    latest = F.slice(F.when(F.size(outturns) > 0, outturns).otherwise(valued), -1, 1)
    latest = F.when(F.size(valued) > 0, latest).otherwise(F.array().cast(f"array<{_ROW}>"))
    n = F.greatest(limit, F.lit(0))
    tail = F.slice(answer, F.greatest(F.size(answer) - n + 1, F.lit(1)), n)
    return F.when(limit.isNull(), answer).when(limit == 1, latest).otherwise(tail)


def _notes(served: Column, shown: Column, kind: Column, limit: Column) -> Column:
    """Codes of what a reader has to know about the answer: how it was computed and what is a projection."""
    lag = F.when(served["frequency"] == "M", F.lit("12")).when(served["frequency"] == "Q", F.lit("4")).otherwise(F.lit("1"))
    projected = F.filter(shown, lambda o: P.is_projection_note(o["note"]))
    valued = F.filter(served["answer"], lambda o: o["value"].isNotNull())
    skipped = F.exists(valued, lambda o: F.lower(F.coalesce(o["note"], F.lit(""))).contains("projection") & (o["period"] > F.element_at(shown, 1)["period"]))
    return F.array_compact(
        F.array(
            F.when(kind == "yoy", F.concat(F.lit("computed:yoy:lag="), lag)).when(kind == "pct_change", F.lit("computed:pct_change"))
            .when(kind == "index", F.concat(F.lit("computed:index:base="), served["base_period"])),
            F.when(F.size(projected) > 0, F.concat(F.lit("projections_from:"), F.array_min(F.transform(projected, lambda o: o["period"])))),
            F.when((limit == 1) & (F.size(shown) > 0) & skipped, F.lit("latest_without_projections")),
        )
    )


def get_series(
    requests: DataFrame, obs: DataFrame, chain: DataFrame, availability: DataFrame | None = None, series_meta: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Answer retrieval requests: (rows, outcomes).

    ``requests``: request_id, indicator, iso3, start_year, end_year, transform,
    limit, strict (all nullable but the first three).  Usability is decided after
    window and transform, so an empty window falls through to the next source.
    ``outcomes`` has one row per request: source served, fallback disclosure, notes,
    or the absence class with the range where data exists.  ``series_meta``: source,
    indicator, iso3 and columns to attach to outcomes, such as a citation.
    """
    asked = requests.withColumns({"transform": F.coalesce("transform", F.lit("none")), "strict": F.coalesce("strict", F.lit(False))})
    asked = asked.select("request_id", "indicator", "iso3", "limit", "strict", "transform", F.struct(*SHAPE).alias("shape"))
    found = lookup_join(asked, shaped_answers(requests, obs, chain, availability), ["shape"], "request_id")
    tried = F.when(F.col("strict"), F.slice("attempts", 1, 1)).otherwise(F.col("attempts"))
    found = found.withColumn("_tried", tried).withColumn("_served", F.try_element_at(F.filter("_tried", lambda a: a["usable"]), F.lit(1)))
    found = found.withColumn("_shown", _limited(F.col("_served.answer"), F.col("limit")))
    rows = found.select("request_id", F.col("_served.source").alias("source"), F.explode("_shown").alias("o")).select("request_id", "source", "o.*")

    served, first = F.col("_served"), F.element_at("_tried", 1)
    none = served.isNull()
    fell_back = F.coalesce(served["priority"] > first["priority"], F.lit(False))
    waits = F.exists("_tried", lambda a: ~a["usable"] & a["transient"] & (a["priority"] < F.col("_served.priority")))
    outcomes = found.select(
        "request_id", "indicator", "iso3", served["source"].alias("source"), fell_back.alias("fallback_used"),
        F.when(fell_back, F.when(waits, F.lit("transient")).otherwise(F.lit("definitive"))).alias("fallback_reason"),
        F.when(none, first["absence"]).alias("absence"), F.when(none, first["first_period"]).alias("available_from"),
        F.when(none, first["last_period"]).alias("available_to"),
        F.when(~none, _notes(served, F.col("_shown"), F.col("transform"), F.col("limit"))).alias("notes"),
    )
    if series_meta is not None:
        outcomes = with_citation(outcomes, series_meta)
    return rows, outcomes


def with_citation(rows: DataFrame, series_meta: DataFrame) -> DataFrame:
    """Attach what is known about the series that answered a request, such as its citation."""
    return lookup_join(rows, series_meta, SERIES, "request_id")
