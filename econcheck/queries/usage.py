"""Queries on the usage feed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from econcheck.functions.text import latency_bucket
from econcheck.operators import usage as U
from econcheck.plans.durable import ensure_checkpoint_dir
from econcheck.streaming.usage import read_event_stream, read_usage, start_usage_sink, windowed_roll_up
from econcheck.queries.cte import sql
from econcheck.queries.inputs import INDICATORS, Tables
from econcheck.queries.registry import query

CODES = [f"N{i:02d}" for i in range(25)]


def raw_events(t: Tables, events=None):
    """Raw usage records from events, hostile fields included."""
    k = F.col("event_id")
    return (t.events if events is None else events).select(
        "ts",
        F.when(k % 3 == 0, F.lit("rest")).otherwise(F.lit("stdio")).alias("transport"),
        F.when(k % 7 == 0, F.lit("DROP TABLE x;")).otherwise(F.col("event_type")).alias("op"),
        F.when(k % 5 == 0, F.lit("order_value")).when(k % 5 == 1, F.lit("WorldBank/NY.X")).when(k % 5 == 2, F.concat(F.lit("my ssn is "), k.cast("string"))).alias("indicator"),
        F.when(k % 2 == 0, F.concat(F.lit("N"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0"))).otherwise(F.lit("jane@example.com")).alias("country"),
        F.when(k % 4 == 0, F.lit("match")).when(k % 4 == 1, F.lit("<script>")).alias("verdict"),
        F.when(F.col("event_type") == "error", F.lit("tool_error")).when(F.col("event_type") == "signup", F.lit("exploded")).otherwise(F.lit("ok")).alias("outcome"),
        F.when(k % 11 == 0, F.lit(-1.0)).otherwise(F.col("value") * 10).alias("duration_ms"),
    )


_BUCKET = """CASE WHEN ms < 50 THEN 'lt50ms' WHEN ms < 200 THEN 'lt200ms' WHEN ms < 500 THEN 'lt500ms' WHEN ms < 1000 THEN 'lt1s' WHEN ms < 3000 THEN 'lt3s' ELSE 'gte3s' END"""
_CLEAN = f"""SELECT event_id, ts, transport, op, indicator, country, verdict, outcome, {_BUCKET} AS bucket, CAST(ms AS BIGINT) AS duration_ms, CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END AS ok
    FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'rest' ELSE 'mcp' END AS transport, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS op,
        CASE event_id % 5 WHEN 0 THEN 'order_value' WHEN 1 THEN 'worldbank/*' WHEN 2 THEN 'other' ELSE '' END AS indicator,
        CASE WHEN event_id % 2 = 0 AND user_id % 30 < 25 THEN 'N' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') ELSE '' END AS country,
        CASE WHEN event_id % 4 = 0 THEN 'match' ELSE '' END AS verdict,
        CASE event_type WHEN 'error' THEN 'tool_error' WHEN 'signup' THEN 'crash' ELSE 'ok' END AS outcome,
        CASE WHEN event_id % 11 = 0 THEN 0 ELSE round(value * 10) END AS ms FROM events)"""


def clean_events(t: Tables):
    return U.anonymise(raw_events(t), CODES, INDICATORS)


@query(
    "f16_anonymised_usage",
    sql("""SELECT transport, op, indicator, country, verdict, outcome, bucket, duration_ms, count(*) AS n FROM clean GROUP BY ALL""", clean=_CLEAN),
)
def f16(t: Tables):
    cols = ["transport", "op", "indicator", "country", "verdict", "outcome", "bucket", "duration_ms"]
    return clean_events(t).groupBy(*cols).agg(F.count("*").alias("n"))


@query("c14_latency_bucket", sql(f"SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE {_BUCKET} END AS bucket FROM (SELECT event_id, value * 10 AS ms FROM events)"))
def c14(t: Tables):
    ms = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 10)
    return t.events.select("event_id", latency_bucket(ms).alias("bucket"))


_MEASURES = "count(*) AS events, CAST(sum(duration_ms) AS BIGINT) AS total_ms, CAST(sum(ok) AS BIGINT) AS ok_events, round(sum(duration_ms)::DOUBLE / count(*), 3) AS mean_ms, round(sum(ok)::DOUBLE / count(*), 4) AS ok_rate"


@query("a16_usage_roll_up", sql(f"SELECT op, indicator, country, verdict, bucket, {_MEASURES} FROM clean GROUP BY op, indicator, country, verdict, bucket", clean=_CLEAN))
def a16(t: Tables):
    return U.roll_up(clean_events(t), ["op", "indicator", "country", "verdict", "bucket"])


@query(
    "a16_usage_all_levels",
    sql(f"SELECT op, outcome, bucket, CAST(grouping_id(op, outcome, bucket) AS BIGINT) AS level, {_MEASURES} FROM clean GROUP BY CUBE (op, outcome, bucket)", clean=_CLEAN),
)
def a16_levels(t: Tables):
    return U.roll_up_all_levels(clean_events(t), ["op", "outcome", "bucket"])


@query(
    "st1_usage_windows",
    sql(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start, op, outcome, bucket, {_MEASURES} FROM clean GROUP BY ALL", clean=_CLEAN),
)
def st1(t: Tables):
    out = windowed_roll_up(clean_events(t), ["op", "outcome", "bucket"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


_WINDOWS = f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start, op, outcome, bucket, {_MEASURES} FROM clean GROUP BY ALL"


@query("st1_usage_stream", sql(_WINDOWS, clean=_CLEAN))
def st1_stream(t: Tables):
    """The same windows from a stream over the events, whose partial sums land in the shared folder."""
    spark = t.events.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/usage-{uuid.uuid4().hex}"
    by = ["op", "outcome", "bucket"]
    stream = raw_events(t, read_event_stream(spark, f"{t.dir}/events.parquet*", t.events.schema))
    running = start_usage_sink(stream, CODES, by, f"{folder}/sums", f"{folder}/progress", INDICATORS)
    running.awaitTermination()
    out = read_usage(spark, f"{folder}/sums", by)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


_PATHS = ["/v1/verify", "/v1/indicator/gdp_growth", "/v1/snapshot/Some%20Where/", "/v1/", "/v1/indicator/GDP!", "/admin"]
_OPS = ["verify", "indicator", "snapshot", "index", "unknown", "unknown"]


def _spelled(key) -> F.Column:
    """A name in letters for a nation key, so that no name is part of another or one letter off."""
    return F.initcap(F.substring(F.translate(F.sha2(key.cast("string"), 256), "0123456789", "ghijklmnop"), 1, 9))


def named_events(t: Tables, events=None):
    """Usage records whose country is a name, a code, an alias or something hostile, and whose operation is a path."""
    k, nk = F.col("event_id"), F.col("user_id") % 25
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("_nk"), _spelled(F.col("n_nationkey")).alias("_name"))
    source = t.events if events is None else events
    place = (
        F.when(k % 6 == 0, F.col("_name")).when(k % 6 == 1, F.concat(F.lit("N"), F.lpad(nk.cast("string"), 2, "0"))).when(k % 6 == 2, F.concat(F.lit("old "), F.lower("_name")))
        .when(k % 6 == 3, F.concat(F.col("_name"), F.lit("; DROP TABLE x"))).when(k % 6 == 4, F.repeat(F.col("_name"), 12))
    )
    joined = source.withColumn("_nk", nk.cast("long")).join(F.broadcast(names), "_nk")  # one row per nation
    return joined.select(
        "ts", F.lit("rest").alias("transport"), F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (k % len(_PATHS) + 1).cast("int")).alias("path"), F.lit(None).cast("string").alias("indicator"),
        place.alias("country"), F.lit("match").alias("verdict"), F.lit("ok").alias("outcome"), (F.col("value") * 10).alias("duration_ms"),
    )


def named_economies(t: Tables):
    return t.nation.select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"), F.lit(None).cast("string").alias("iso2"), _spelled(F.col("n_nationkey")).alias("name"),
        F.array(F.concat(F.lit("Old "), _spelled(F.col("n_nationkey")))).alias("aliases"), F.col("n_nationkey").alias("ordinal"),
    )


_NAMED = f"""SELECT date_trunc('hour', ts) AS hour, (ARRAY{_OPS})[event_id % {len(_OPS)} + 1] AS op, CASE WHEN event_id % 6 <= 2 THEN 'N' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') ELSE '' END AS country,
    CAST(round(value * 10) AS BIGINT) AS duration_ms, 1 AS ok FROM events"""


@query("f16_named_usage", sql(f"SELECT op, country, {_MEASURES} FROM named GROUP BY op, country", named=_NAMED))
def f16_named(t: Tables):
    return U.roll_up(U.anonymise(named_events(t), named_economies(t)), ["op", "country"])


@query("st1_named_stream", sql(f"SELECT strftime(hour, '%Y-%m-%d %H') AS window_start, op, country, {_MEASURES} FROM named GROUP BY ALL", named=_NAMED))
def st1_named(t: Tables):
    """The same records from a stream, each distinct country text resolved once and kept in a dictionary."""
    spark = t.events.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/named-{uuid.uuid4().hex}"
    by = ["op", "country"]
    stream = named_events(t, read_event_stream(spark, f"{t.dir}/events.parquet*", t.events.schema))
    running = start_usage_sink(stream, named_economies(t), by, f"{folder}/sums", f"{folder}/progress", dictionary=f"{folder}/names")
    running.awaitTermination()
    out = read_usage(spark, f"{folder}/sums", by)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))
