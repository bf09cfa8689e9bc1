"""Join shapes shared by the operators.

* ``dim_join``   - a dimension the caller supplies: a plain join, so Spark broadcasts it by
  its measured bytes or not at all.
* ``lookup_join`` - a fact table against a table with one row per key.  Neither
  side is assumed small and one key may hold a large share of the facts.  A sketch over
  all fact keys names the heavy ones; only their facts are spread over several tasks and
  only their lookup rows are repeated, everything else is joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: counters of the sketch: a key with more than 3 / TRACKED of all facts is always in it
TRACKED = 8192


def dim_join(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a dimension without a hint: nothing bounds what a caller supplies."""
    return df.join(dim, on, how)


def _key(on: list[str]) -> Column:
    return F.xxhash64(*on)


def heavy_keys(facts: DataFrame, on: list[str], parts: int) -> DataFrame:
    """One row with ``keys``: hashes of the keys that hold more than two tasks' even share of all facts.

    One aggregation with partial sketches below the shuffle; it reads the key columns only.
    There are fewer than ``parts`` / 2 such keys, however many facts.  Rows with a NULL
    key match nothing and are not counted.
    """
    most = min(max(parts, 2), TRACKED // 4)
    counted = facts.select(*on).dropna().select(_key(on).alias("k"))
    sketch = counted.agg(F.call_function("approx_top_k", "k", F.lit(most), F.lit(TRACKED)).alias("top"), F.count("*").alias("n"))
    share = F.col("n") * 2 / parts
    return sketch.select(F.transform(F.filter("top", lambda x: x["count"] > share), lambda x: x["item"]).alias("keys"))


def salted_sides(facts: DataFrame, lookup: DataFrame, on: list[str], spread_by: Column, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: heavy keys over ``salts`` values, every other key at 0.

    The lookup side has one row per key and ``salts`` - 1 more per heavy key.
    """
    heavy = heavy_keys(facts, on, salts).scalar()
    is_heavy = F.array_contains(F.coalesce(heavy, F.array().cast("array<bigint>")), _key(on))
    spread = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    salted = facts.withColumn("_salt", F.when(is_heavy, spread).otherwise(F.lit(0)))
    repeated = lookup.withColumn("_salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted, repeated


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: Column | str,
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join of facts to a one-row-per-key lookup; the result does not depend on ``salts``.

    By default a heavy key is spread over as many tasks as the session shuffles to.
    """
    salts = salts or max(1, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if salts == 1:
        return facts.join(lookup, on, how)
    salted, repeated = salted_sides(facts, lookup, on, F.col(spread_by) if isinstance(spread_by, str) else spread_by, salts)
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def null_safe_lookup_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], spread_by: Column | str, how: str = "left", salts: int | None = None
) -> DataFrame:
    """As ``lookup_join`` where key columns may be NULL on both sides (compared as text)."""
    marked = [f"_k_{c}" for c in on]

    def mark(df):
        for c, m in zip(on, marked):
            df = df.withColumn(m, F.coalesce(F.col(c).cast("string"), F.lit("\u0000")))
        return df

    joined = lookup_join(mark(facts), mark(lookup).drop(*on), marked, spread_by, how, salts)
    return joined.drop(*marked)
