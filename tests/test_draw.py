import hashlib
import random

import pytest
from pyspark.sql import functions as F

from econcheck.operators import draw as D
from econcheck.operators import frame as B
from econcheck.plans.ranking import rank_descending, row_number_by_hash


def key(seed, ns, *parts):
    return hashlib.sha256(f"{seed}:{ns}:{'|'.join(map(str, parts))}".encode()).hexdigest()


def greedy(cells, seed, ns, attempt, quotas, per_economy, core=()):
    """The sequential walk the operator must equal."""
    left = {s: dict(q) for s, q in quotas.items()}
    used, out = {}, []
    walk = [*core, *sorted((c for c in cells if c not in core), key=lambda c: key(seed, f"{ns}:{attempt}", c["iso3"], c["indicator"], c["year"]))]
    for c in walk:
        if all(left[s].get(c[s], 0) > 0 for s in quotas) and used.get(c["iso3"], 0) < per_economy:
            out.append((c["iso3"], c["indicator"], c["year"]))
            used[c["iso3"]] = used.get(c["iso3"], 0) + 1
            for s in quotas:
                left[s][c[s]] -= 1
    return out


def make_pool(n, seed=1):
    rng = random.Random(seed)
    tiers = {f"E{i}": rng.choice(["T1", "T2", "T2", "T3"]) for i in range(n)}
    cells = [dict(iso3=e, indicator=i, year=y, tier=t) for e, t in tiers.items() for i in ("a", "b", "c") for y in (2018, 2019) if rng.random() < 0.7]
    rng.shuffle(cells)
    return cells


QUOTAS = {"indicator": {"a": 6, "b": 4, "c": 4}, "tier": {"T1": 5, "T2": 5, "T3": 4}, "year": {2018: 7, 2019: 7}}


def frame(spark, cells, parts=None):
    df = spark.createDataFrame([(c["iso3"], c["indicator"], c["year"], c["tier"]) for c in cells], "iso3 string, indicator string, year int, tier string")
    return df.repartition(parts) if parts else df


@pytest.mark.parametrize("n", [8, 60, 400])
def test_draw_equals_sequential_greedy(spark, n):
    cells = make_pool(n, n)
    got = {}
    for r in D.quota_draw(frame(spark, cells), "ab", "draw", QUOTAS, attempts=3).orderBy("attempt_id", "position").collect():
        got.setdefault(r.attempt_id, []).append((r.iso3, r.indicator, r.year))
    assert got == {a: greedy(cells, "ab", "draw", a, QUOTAS, 2) for a in range(3)}


def test_draw_ignores_input_order_and_carries_core(spark):
    cells = make_pool(80, 5)
    core = [c for c in cells if c["indicator"] == "a"][:2]
    core_df = frame(spark, core)
    runs = []
    for parts in (1, 7):
        rows = D.quota_draw(frame(spark, random.Random(parts).sample(cells, len(cells)), parts), "s", "d", QUOTAS, attempts=1, core=core_df).collect()
        runs.append({(r.iso3, r.indicator, r.year) for r in rows})
    assert runs[0] == runs[1] and {(c["iso3"], c["indicator"], c["year"]) for c in core} <= runs[0]


def test_draw_until_full_or_best(spark):
    cells = make_pool(300, 9)
    full = D.draw_until_full(frame(spark, cells), "s", "d", QUOTAS, wave=4, max_attempts=40)
    assert full.count() == 14 and full.first().shortfall == 0
    tiny = [c for c in cells if c["indicator"] == "a"][:3]
    best = D.draw_until_full(frame(spark, tiny), "s", "d", QUOTAS, wave=2, max_attempts=2, partial=True)
    assert best.first().shortfall == 14 - best.count()


def test_few_attempts_behind_the_first_full_one_are_drawn(spark, monkeypatch):
    drawn, one = [], D.quota_draw

    def counted(*a, **k):
        drawn.extend(range(k["first_attempt"], k["first_attempt"] + k["attempts"]))
        return one(*a, **k)

    df = frame(spark, make_pool(300, 9))
    every = {r.attempt_id: r["count"] for r in one(df, "s", "d", QUOTAS, attempts=16).groupBy("attempt_id").count().collect()}
    first = min(a for a, n in every.items() if n == max(every.values()))
    monkeypatch.setattr(D, "quota_draw", counted)
    full = D.draw_until_full(df, "s", "d", QUOTAS)
    assert full.select("attempt_id").distinct().collect()[0][0] == first
    assert drawn == list(range(len(drawn))) and len(drawn) <= 2 * first + 1
    drawn.clear()
    impossible = {"tier": {"t1": 9}, "indicator": {"x": 9}}
    with pytest.raises(ValueError):
        D.draw_until_full(df, "s", "d", impossible, wave=3, max_attempts=7)
    assert drawn == list(range(7))


def test_batches_respect_every_rule(spark):
    rng = random.Random(2)
    bank = [(f"R-{i:03d}", f"E{rng.randint(0, 40)}", f"i{rng.randint(0, 13)}", "null_probe" if i % 8 == 0 else "headline") for i in range(90)]
    df = spark.createDataFrame(bank, "qid string, iso3 string, indicator string, segment string")
    info = {b[0]: b for b in bank}
    packed = {}
    for r in D.pack_batches(df, "s").collect():
        packed.setdefault(r.batch_id, []).append(info[r.qid])
    assert sorted(q[0] for b in packed.values() for q in b) == sorted(info)
    for b in packed.values():
        assert len(b) <= 10 and len({q[1] for q in b}) == len(b) and len({q[2] for q in b}) == len(b) and sum(q[3] == "null_probe" for q in b) <= 2
    # first fit in seeded order
    want = []
    for q in sorted(bank, key=lambda q: key("s", "batch-assign", q[0])):
        for b in want:
            if len(b) < 10 and all(q[1] != o[1] and q[2] != o[2] for o in b) and (q[3] != "null_probe" or sum(o[3] == "null_probe" for o in b) < 2):
                b.append(q)
                break
        else:
            want.append([q])
    assert [sorted(q[0] for q in packed[f"batch-{i + 1:02d}"]) for i in range(len(want))] == [sorted(q[0] for q in b) for b in want]
    ordered = D.order_for_models(D.pack_batches(df, "s"), ["m1", "m2"], "s").collect()
    per = {}
    for r in ordered:
        per.setdefault((r.model, r.batch_id), []).append((r.position, r.qid))
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in per.values())
    assert any([q for _, q in sorted(per[("m1", b)])] != [q for _, q in sorted(per[("m2", b)])] for b in packed)


def test_recency_draw_uses_each_economy_once(spark):
    cells = make_pool(30, 4)
    got = D.one_per_indicator(frame(spark, cells), "s", ["a", "b", "c"], [2023, 2024]).orderBy("turn").collect()
    order = sorted("abc", key=lambda i: key("s", "recency", i))
    used, want = set(), []
    for turn, ind in enumerate(order):
        names = sorted({c["iso3"] for c in cells if c["indicator"] == ind}, key=lambda e: key("s", f"recency:{ind}", e))
        pick = next(e for e in names if e not in used)
        used.add(pick)
        want.append((ind, pick, [2023, 2024][turn % 2]))
    assert [(r.indicator, r.iso3, r.year) for r in got] == want


def test_ranks_match_a_plain_sort(spark):
    rng = random.Random(8)
    data = [(f"E{i:04d}", None if i % 3 == 0 else float(rng.randint(0, 50))) for i in range(700)]
    df = spark.createDataFrame(data, "iso3 string, gdp double")
    got = [r.iso3 for r in rank_descending(df, "gdp", "iso3").orderBy("rank").collect()]
    assert got == [d[0] for d in sorted(data, key=lambda d: (d[1] is None, -(d[1] or 0), d[0]))]
    h = [r.iso3 for r in row_number_by_hash(df, D.seeded_key("s", "n", F.col("iso3"))).orderBy("position").collect()]
    assert h == sorted((d[0] for d in data), key=lambda e: key("s", "n", e))


def test_frame_reasons_and_exclusions(spark):
    econ = spark.createDataFrame([("USA", "T1"), ("VEN", "T2"), ("TWN", "T2"), ("XXX", "T4")], "iso3 string, tier string")
    grid = B.complete_grid(econ, ["gdp_growth", "gini"], [2018, 2019])
    obs = spark.createDataFrame(
        [("USA", "gdp_growth", 2018, 2.9, None, "worldbank"), ("USA", "gdp_growth", 2019, 2.3, "IMF WEO estimate/projection", "worldbank"), ("VEN", "gdp_growth", 2018, None, None, "worldbank"),
         ("TWN", "gdp_growth", 2018, 2.8, None, "imf"), ("USA", "gini", 2018, 41.0, None, "worldbank"), ("VEN", "gdp_growth", 2019, 1.0, None, "worldbank")],
        "iso3 string, indicator string, year int, value double, note string, source string",
    )
    loads = spark.createDataFrame([("USA", "gdp_growth", "ok"), ("VEN", "gdp_growth", "ok"), ("TWN", "gdp_growth", "ok"), ("USA", "gini", "ok"), ("TWN", "gini", "transient")], "iso3 string, indicator string, status string")
    cells = B.enumerate_frame(grid, obs, loads)
    stated = spark.createDataFrame([("VEN", ["gdp_growth"], [2018, 2019], "contested_official_data")], "iso3 string, indicators array<string>, years array<int>, reason string")
    marked = B.apply_exclusions(cells, stated, B.derived_exclusions(cells, "worldbank", ["imf"]))
    got = {(r.iso3, r.indicator, r.year): (r.eligible, r.reason, r.exclusion_reason) for r in marked.collect()}
    assert got[("USA", "gdp_growth", 2018)] == (True, None, None) and got[("USA", "gdp_growth", 2019)][1] == "projection"
    assert got[("VEN", "gdp_growth", 2018)] == (False, "null_value", "contested_official_data") and got[("VEN", "gdp_growth", 2019)] == (True, None, "contested_official_data")
    assert got[("TWN", "gdp_growth", 2018)] == (True, None, "weo_only_entity") and got[("TWN", "gdp_growth", 2019)][1] == "missing_year"
    assert got[("TWN", "gini", 2018)][1] == "fetch_failed_transient" and got[("USA", "gini", 2018)][1] == "null_probe_indicator" and got[("XXX", "gdp_growth", 2018)][1] == "no_series_in_window"


def test_reanchor(spark):
    drawn = spark.createDataFrame([("A", "i", 2018, 1.0), ("B", "i", 2018, 1.0), ("C", "i", 2018, 1.0), ("D", "i", 2018, 1.0)], "iso3 string, indicator string, year int, value double")
    seen = spark.createDataFrame([("A", "i", 2018, 1.0, False, "match"), ("B", "i", 2018, 2.0, False, "mismatch"), ("C", "i", 2018, 1.0, True, "match")], "iso3 string, indicator string, year int, official_value double, is_projection boolean, verdict string")
    kept, bad = D.reanchor(drawn, seen)
    assert {(r.iso3, r.value, r.frame_value_reanchored) for r in kept.collect()} == {("A", 1.0, False), ("B", 2.0, True)}
    assert {r.iso3 for r in bad.collect()} == {"C", "D"} and {r.iso3 for r in D.redraw_pool(drawn, bad).collect()} == {"A", "B"}


def test_draw_refuses_silent_shortfalls(spark):
    cells = [("A", "t1", "x", 2000), ("B", "t1", "x", 2001)]
    df = spark.createDataFrame(cells, "iso3 string, tier string, indicator string, year int")
    quotas = {"tier": {"t1": 1}, "indicator": {"x": 5}}
    with pytest.raises(ValueError, match="core rows exceed"):
        D.quota_draw(df, "s", "d", quotas, attempts=1, core=df)
    with pytest.raises(ValueError, match="lacks"):
        D.draw_until_full(df, "s", "d", {"tier": {"t1": 9}, "indicator": {"x": 9}}, wave=2, max_attempts=2)


def test_ranges_are_even_and_numbers_exact(spark):
    """Equal values, a common prefix of all names and NULLs alone spread; the numbers are those of one big sort."""
    from econcheck.plans import ranking

    for value in (lambda i: None, lambda i: 5.0 if i % 3 else float(i % 7), lambda i: float(i)):
        data = [(f"aaaa{i * 7919 % 5000:05d}", value(i)) for i in range(5000)]
        df = spark.createDataFrame(data, "iso3 string, gdp double")
        got = [(r.iso3, r["rank"]) for r in rank_descending(df, "gdp", "iso3").orderBy("rank").collect()]
        want = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
        assert got == [(name, i) for i, (name, _) in enumerate(want, 1)]
        dealt = df.repartitionByRange(8, F.col("gdp").desc_nulls_last(), F.col("iso3").asc_nulls_first())
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 5000 / 8
    assert ranking.number_rows(spark.createDataFrame([], "k int"), [F.col("k")], "n").count() == 0


def _cells(spark, n=60):
    return spark.createDataFrame([(f"E{i % 20:02d}", f"i{i // 20}", 2000 + i % 3, float(i), f"T{i % 2}") for i in range(n)], "iso3 string, indicator string, year int, value double, tier string")


def _verdicts(bad, moved=()):
    def verify(cells):
        n = F.col("value")
        return cells.select(
            "iso3", "indicator", "year", F.when(~n.isin(*bad, -1.0), F.when(n.isin(*moved, -1.0), n + 100).otherwise(n)).alias("official_value"), F.lit(False).alias("is_projection"),
            F.when(n.isin(*bad, -1.0), "cannot_verify").when(n.isin(*moved, -1.0), "mismatch").otherwise("match").alias("verdict"),
        )

    return verify


def _by_tier(take):
    def draw(left, cycle, core):
        fresh = left if core is None else left.join(core.select("iso3", "indicator", "year"), ["iso3", "indicator", "year"], "left_anti")
        drawn = D.first_per_stratum(fresh, "tier", D.seeded_key("s", f"d:{cycle}", *D.cell_key()), take).select("iso3", "indicator", "year", "value", "tier")
        return drawn if core is None else drawn.unionByName(core)

    return draw


def test_redraw_until_every_cell_is_verified(spark):
    """The loop as a plain program over the same seeded order gives the same cells, cycles and removals."""
    cells = _cells(spark)
    bad, moved = [float(i) for i in range(2, 60, 4)], [1.0, 5.0, 9.0]
    kept, removed = D.draw_verified(cells, _by_tier(5), _verdicts(bad, moved))
    rows = [tuple(r) for r in cells.collect()]
    left, gone, cycle = list(rows), [], 0
    while True:
        key = {r[0]: r[1] for r in spark.createDataFrame(rows, cells.schema).select("value", D.seeded_key("s", f"d:{cycle}", *D.cell_key())).collect()}
        drawn = [r for t in ("T0", "T1") for r in sorted((r for r in left if r[4] == t), key=lambda r: key[r[3]])[:5]]
        failed = [r for r in drawn if r[3] in bad]
        gone += [(r[0], r[1], r[2], cycle) for r in failed]
        if not failed:
            break
        left, cycle = [r for r in left if r not in failed], cycle + 1
    assert cycle > 0 and sorted(tuple(r) for r in removed.select("iso3", "indicator", "year", "cycle").collect()) == sorted(gone)
    got = {(r.iso3, r.indicator, r.year): (r.value, r.frame_value_reanchored) for r in kept.collect()}
    assert got == {r[:3]: (r[3] + 100, True) if r[3] in moved else (r[3], False) for r in drawn}


def test_redraw_drops_core_cells_and_gives_up(spark):
    cells = _cells(spark)
    core = cells.where("value in (0.0, 3.0)")
    kept, removed = D.draw_verified(cells, _by_tier(2), _verdicts([0.0]), core=core)
    values = {r.value for r in kept.collect()}
    assert 3.0 in values and 0.0 not in values and [r.cycle for r in removed.collect()] == [0]
    with pytest.raises(ValueError, match="2 cycles"):
        D.draw_verified(cells, lambda left, c, k: left.limit(5), _verdicts([float(i) for i in range(60)]), max_cycles=2)
    some, gone = D.draw_verified(cells, _by_tier(3), _verdicts([float(i) for i in range(0, 60, 2)]), partial=True)
    assert some.count() + gone.count() == 6 and all(r.value % 2 for r in some.collect())


def test_transient_verdicts_are_asked_again(spark):
    cells = _cells(spark, 10)
    asked = []

    def verify(some):
        asked.append(some.count())
        flaky = F.lit(len(asked) < 3) & (F.col("value") < 2)
        return some.select(
            "iso3", "indicator", "year", F.when(~flaky, F.col("value")).alias("official_value"), F.lit(False).alias("is_projection"),
            F.when(flaky, "cannot_verify").otherwise("match").alias("verdict"), flaky.alias("transient"),
        )

    kept, removed = D.draw_verified(cells, lambda left, c, k: left, verify)
    assert asked == [10, 2, 2] and kept.count() == 10 and removed.count() == 0


def test_prompts_are_numbered_in_each_models_order(spark):
    ordered = spark.createDataFrame([("m", "b1", "Q1", 7), ("m", "b1", "Q2", 3), ("m", "b1", "Q3", 5), ("n", "b1", "Q1", 1), ("n", "b2", "Q9", 1), ("n", "b2", "Q1", 2)], "model string, batch_id string, qid string, position int")
    questions = spark.createDataFrame([("Q1", "one?"), ("Q2", "two?"), ("Q3", "three?")], "qid string, text string")
    prompts, missing = D.render_prompts(ordered, questions, "Answer {N}.")
    got = {(r.model, r.batch_id): r for r in prompts.collect()}
    assert got["m", "b1"].prompt == "Answer 3.\n\n1. [Q2] two?\n2. [Q3] three?\n3. [Q1] one?" and got["m", "b1"].qids == "Q2,Q3,Q1"
    assert got["n", "b1"].prompt == "Answer 1.\n\n1. [Q1] one?" and len(got) == 2
    assert [tuple(r) for r in missing.collect()] == [("n", "b2", "Q9")]
