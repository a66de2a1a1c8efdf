from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators import selection


def make(seed: int, n: int):
    rng = random.Random(seed)
    return [(f"c{i:02d}", rng.randint(100, 900) * 1.0, rng.randint(50, 600) * 1.0) for i in range(n)]


def brute(items, budget, k):
    best = 0.0
    for size in range(1, k + 1):
        for chosen in itertools.combinations(items, size):
            if sum(c[2] for c in chosen) <= budget:
                best = max(best, sum(c[1] - c[2] for c in chosen))
    return best


@pytest.fixture(scope="module")
def answers(spark):
    items = {f"t{s}": make(s, 14) for s in range(4)}
    rows = [(t, c, r, p) for t, group in items.items() for c, r, p in group]
    candidates = spark.createDataFrame(rows, "type string, postal_code string, revenue double, avg_price_m2 double")
    cases = [(i, t, float(b), 12.0, k) for i, (t, b, k) in enumerate(
        itertools.product(items, [60, 300, 800, 1500, 100_000], [1, 2, 3, 5]))]
    scenarios = spark.createDataFrame(cases, "scenario_id int, type string, budget double, area_m2 double, k int")
    got: dict = {}
    for r in selection.select_locations(candidates, scenarios).collect():
        got.setdefault(r.scenario_id, []).append(r)
    return items, cases, got


def test_choices_are_affordable_and_near_the_best(answers):
    items, cases, got = answers
    gaps = []
    for i, t, budget, _, k in cases:
        chosen = got.get(i, [])
        best = brute(items[t], budget, k)
        value = sum(r.profit for r in chosen)
        assert len({r.postal_code for r in chosen}) == len(chosen) <= k
        assert sum(r.total_cost for r in chosen) <= budget + 1e-9
        assert all(r.profit > 0 for r in chosen)
        assert value <= best + 1e-6
        if chosen:
            assert best <= chosen[0].bound + 1e-6
        else:
            assert best == 0
        if best:
            gaps.append(1 - value / best)
        if k == 1 and best:
            assert value == pytest.approx(best)
    assert max(gaps) <= 0.09, max(gaps)


def test_no_gap_is_the_best_set(spark, answers):
    items, cases, _ = answers
    rows = [(t, c, r, p) for t, group in items.items() for c, r, p in group]
    candidates = spark.createDataFrame(rows, "type string, postal_code string, revenue double, avg_price_m2 double")
    scenarios = spark.createDataFrame(cases, "scenario_id int, type string, budget double, area_m2 double, k int")
    got: dict = {}
    for r in selection.select_locations(candidates, scenarios, max_gap=0.0).collect():
        got.setdefault(r.scenario_id, []).append(r)
    for i, t, budget, _, k in cases:
        value = sum(r.profit for r in got.get(i, []))
        assert value == pytest.approx(brute(items[t], budget, k))
        assert all(r.gap == pytest.approx(0, abs=1e-9) and r.bound == pytest.approx(value) for r in got.get(i, []))


def test_three_hundred_codes_within_the_gap_and_exact_pairs(spark):
    groups = {f"g{s}": make(40 + s, 300) for s in range(3)}
    rows = [(t, f"{t}{c}", r, p) for t, group in groups.items() for c, r, p in group]
    candidates = spark.createDataFrame(rows, "type string, postal_code string, revenue double, avg_price_m2 double")
    cases = [(i, t, float(b), 12.0, k) for i, (t, b, k) in enumerate(itertools.product(groups, [130, 400, 900, 2500, 9000], [2, 3, 6, 12]))]
    scenarios = spark.createDataFrame(cases, "scenario_id int, type string, budget double, area_m2 double, k int")
    got: dict = {}
    for r in selection.select_locations(candidates, scenarios).collect():
        got.setdefault(r.scenario_id, []).append(r)
    for i, t, budget, _, k in cases:
        chosen = got[i]
        value = sum(r.profit for r in chosen)
        assert len({r.postal_code for r in chosen}) == len(chosen) <= k
        assert sum(r.total_cost for r in chosen) <= budget + 1e-9
        assert {r.gap for r in chosen} == {chosen[0].gap} and 0 <= chosen[0].gap <= selection.MAX_GAP + 1e-9
        assert chosen[0].gap == pytest.approx(1 - value / chosen[0].bound)
    pairs = scenarios.where("k = 2")
    best: dict = {}
    for r in selection.select_locations(candidates, pairs, max_gap=0.0).collect():
        best[r.scenario_id] = best.get(r.scenario_id, 0) + r.profit
    for i, t, budget, _, k in cases:
        if k == 2:
            group = candidates.where(F.col("type") == t).withColumn("total_cost", F.col("avg_price_m2"))
            exact = selection.select_locations_exact_k2(group, budget).collect()
            single = max((r - c for _, r, c in groups[t] if c <= budget), default=0)
            assert best[i] == pytest.approx(max([single, *[e.profit for e in exact]]))


def test_many_scenarios_meet_no_prefix_rows(spark):
    """Budgets meet running costs in one stream: rows are scenarios times multipliers."""
    candidates = spark.createDataFrame([("t", *c) for c in make(7, 60)], "type string, postal_code string, revenue double, avg_price_m2 double")
    asked = spark.range(50).select(F.col("id").alias("scenario_id"), F.lit("t").alias("type"), F.lit(12.0).alias("area_m2"), (F.col("id") * 40.0).alias("budget"), F.lit(8).alias("k"))
    items = candidates.select("type", F.lit(12.0).alias("area_m2"), "postal_code", "revenue", F.col("avg_price_m2").alias("cost")).withColumn("profit", F.col("revenue") - F.col("cost")).where("profit > 0")
    paths = selection._paths(items, 8, 200).cache()
    multipliers = paths.select("lam").distinct().count()
    met = selection._best_prefixes(asked, paths)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    by = ["type", "area_m2", "lam"]
    asks = asked.join(paths.select(*by).distinct(), ["type", "area_m2"])
    assert selection._latest(asks, paths.select(*by, F.col("sum_cost").alias("at"), F.struct("rank").alias("offer")), by).count() == 50 * multipliers
    assert met.count() == 50 and "Window" in plan and "CartesianProduct" not in plan


def test_exact_pair(spark):
    for seed in range(8):
        items = make(100 + seed, 25)
        df = spark.createDataFrame(items, "postal_code string, revenue double, total_cost double")
        for budget in (120.0, 500.0, 1e6):
            pairs = [(a, b) for a, b in itertools.combinations(items, 2) if a[2] + b[2] <= budget]
            got = selection.select_locations_exact_k2(df, budget).collect()
            if not pairs:
                assert got == []
                continue
            want = max(a[1] - a[2] + b[1] - b[2] for a, b in pairs)
            assert got[0].profit == pytest.approx(want)


def test_top_k_and_totals(spark):
    df = spark.createDataFrame([("a", 10.0, 4.5), ("b", 10.0, 4.5), ("c", 3.0, 4.0), ("d", 99.0, 50.0)],
                               "postal_code string, revenue double, total_cost double")
    best = selection.top_k_profit(df, 10.0, 2)
    assert [r.postal_code for r in best.collect()] == ["a", "b"]
    assert selection.selection_totals(best).first().asDict() == {"n": 2, "total_cost": 10, "total_profit": 11.0}
    assert selection.selection_totals(best.where(F.lit(False))).first().n == 0
