"""URL allow and block rules as a sort-merge range join on reversed hosts; DataFrame functions only.

A host's key lists its labels from the right, each closed by U+0001, so a rule's host and all
its subdomains are one interval of keys. The intervals of rules are nested or apart. One
sorted sweep over hosts and interval bounds carries the stack of rules that are open: the
bound passed last says which. Sweeps run side by side on shares of the distinct hosts, each
with all bounds, so a hot host or domain is swept once and no share grows with a domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP, END = "\u0001", "\U0010ffff"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def host_key(host: Column) -> Column:
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(x, F.lit(STOP)))
    return F.when(host == "", F.lit("")).otherwise(F.concat_ws("", labels))


def _bounds(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): where a rule's interval opens or closes and the rules that are open behind it."""
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "path", "verdict")
    hosts = rules.groupBy("host").agg(F.collect_set(rule).alias("own"))
    # a rule's host and what stands above it: a.b.c, b.c, c and the empty host
    labels = F.split("host", r"\.")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))), F.array(F.lit("")))
    lines = hosts.select(F.col("host").alias("of"), F.explode(F.array_distinct(above)).alias("host")).join(hosts, "host")
    stacks = lines.groupBy(F.col("of").alias("host")).agg(
        F.flatten(F.collect_list("own")).alias("open"), F.flatten(F.collect_list(F.when(F.col("host") != F.col("of"), F.col("own")))).alias("outer")
    )
    key = host_key(F.col("host"))
    return stacks.select(key.alias("key"), F.lit(0).alias("kind"), F.col("open").alias("stack")).union(
        stacks.select(F.concat(key, F.lit(END)), F.lit(2), F.col("outer"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)``: a rule fits its host and every subdomain if the url's path
    starts with the rule's. The longest ``host + path`` wins; among equal lengths the longer
    host, then ``block``. No fitting rule: null and ``default``. A null url, or one without
    ``://``, has an empty host and path. No rules: every verdict is ``default``. Rows, also
    repeated ones, come back one for one; other columns are ignored.
    """
    spark = pages.sparkSession
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    bounds = _bounds(rules.select("host", "path", "verdict"))
    hosts = urls.select("host").distinct().select(F.pmod(F.xxhash64("host"), F.lit(shares)).cast("int").alias("share"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host")
    everywhere = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "key", "kind", "stack")
    sweep = Window.partitionBy("share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = hosts.unionByName(everywhere, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").select("host", "stack")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["host_size"], (r["verdict"] == "block").alias("blocks"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = urls.join(swept, "host", "left").withColumn("best", best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
