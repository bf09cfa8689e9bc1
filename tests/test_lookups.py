"""Lookups by heavy keys: what is repeated, what is spread, and that results stay the same."""

from pyspark.sql import functions as F

from econcheck.plans import joins


def _sides(spark, n=40_000, keys=2_000):
    facts = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % keys).cast("long").alias("k"), F.lit("x").alias("g"))
    lookup = spark.range(keys).select(F.col("id").alias("k"), F.lit("x").alias("g"), (F.col("id") * 10).alias("v"))
    return facts, lookup


def test_only_heavy_lookup_rows_are_repeated(spark):
    facts, lookup = _sides(spark)
    for salts in (8, 64):
        left, right = joins.salted_sides(facts, lookup, ["k", "g"], F.col("id"), salts)
        assert joins.heavy_keys(facts, ["k", "g"], salts).first()["keys"] == [facts.where("k = 7").select(F.xxhash64("k", "g")).first()[0]]
        assert right.count() == 2_000 + salts - 1 and right.where("k <> 7").count() == 1_999
        # the hot third of the facts is spread evenly, the rest is not
        per = {r["_salt"]: r["count"] for r in left.where("k = 7").groupBy("_salt").count().collect()}
        assert len(per) == salts and max(per.values()) < 3 * 40_000 / 3 / salts
        assert left.where("k <> 7 and _salt <> 0").count() == 0


def test_even_keys_are_joined_once(spark):
    facts = spark.range(10_000).select("id", (F.col("id") % 500).alias("k"))
    lookup = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("v"))
    _, right = joins.salted_sides(facts, lookup, ["k"], F.col("id"), 16)
    assert right.count() == 500


def test_lookup_row_count_in_the_plan_is_bounded_for_many_heavy_keys(spark):
    # four keys with a fifth each, and a thousand more
    facts = spark.range(50_000).select("id", F.when(F.col("id") % 5 < 4, F.col("id") % 5).otherwise(100 + F.col("id") % 1000).alias("k"))
    lookup = spark.range(2_000).select(F.col("id").alias("k"))
    salts = 32
    _, right = joins.salted_sides(facts, lookup, ["k"], F.col("id"), salts)
    assert right.count() <= 2_000 + salts * 4
    assert joins.lookup_join(facts, lookup, ["k"], "id", "inner", salts).count() == 50_000


def test_results_do_not_depend_on_salts(spark):
    facts, lookup = _sides(spark, 5_000, 100)
    facts = facts.unionByName(spark.createDataFrame([(90_001, None, "x"), (90_002, 7, None), (90_003, 12_345, "x")], "id long, k long, g string"))
    seen = []
    for salts in (1, 2, 8, 50):
        out = joins.lookup_join(facts, lookup, ["k", "g"], "id", salts=salts)
        seen.append(sorted((r.id, -1 if r.v is None else r.v) for r in out.collect()))
    assert all(s == seen[0] for s in seen) and len(seen[0]) == 5_003
    assert dict(seen[0])[90_001] == dict(seen[0])[90_002] == dict(seen[0])[90_003] == -1


def test_empty_sides(spark):
    facts, lookup = _sides(spark, 100, 10)
    assert joins.lookup_join(facts.where("false"), lookup, ["k", "g"], "id").count() == 0
    assert joins.lookup_join(facts, lookup.where("false"), ["k", "g"], "id").where("v is null").count() == 100
    assert joins.lookup_join(facts.where("false"), lookup, ["k", "g"], "id", "inner").count() == 0


def test_null_safe_lookup(spark):
    facts = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(200)], "id int, k string")
    lookup = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    got = {r.id: r.v for r in joins.null_safe_lookup_join(facts, lookup, ["k"], "id").collect()}
    assert got == {i: 1 if i % 2 else 2 for i in range(200)}
