from __future__ import annotations

import random

from pyspark.sql import functions as F

from placewise.operators import demand, registry, shops
from placewise.params import Params


def test_till_components_against_union_find(spark):
    rng = random.Random(0)
    rows = []
    for group in range(25):
        for _ in range(rng.randint(1, 8)):
            nums = sorted({rng.choice(["", *map(str, range(15))]) for _ in range(rng.randint(2, 4))})
            if len(nums) > 1:
                rows.append((f"B{group}", "P", f"3000{rng.randint(0, 9)}", 202501, nums))
    df = spark.createDataFrame(rows, "base string, place string, pc5 string, month int, nums array<string>")
    got = {(r.base, r.num): r.rep for r in registry.till_components(df).collect()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for base, _, _, _, nums in rows:
        for n in nums[1:]:
            parent[root((base, n))] = root((base, nums[0]))
    members: dict = {}
    for node in list(parent):
        members.setdefault(root(node), []).append(node[1])
    want = {(r[0], n): min(ns) for r, ns in members.items() for n in ns}
    assert got == want


def test_month_bits_count_months(spark):
    window = (202411, 202602)
    months = [202410, 202411, 202411, 202412, 202501, 202602, 202603]
    df = spark.createDataFrame([(m,) for m in months], "month int")
    n = df.agg(F.bit_count(F.bit_or(registry.month_bit(F.col("month"), window))).alias("n")).first().n
    assert n == 4


def tx(spark):
    rng = random.Random(5)
    names = ["SMOK", "SMOK 2", "SMOK 3", "ANNA", "KFC 1", "KFC"]
    rows = [
        (f"C{rng.randint(0, 30)}", rng.choice([202501, 202502, 202503, 202504]), rng.choice([5812, 5814]), 1,
         rng.choice(names), rng.choice(["KRAKOW", "LODZ"]), rng.choice(["30001", "30002", "30003", None]), rng.randint(1, 900) / 4)
        for _ in range(1500)
    ]
    return spark.createDataFrame(
        rows, "card string, month int, mcc int, cp int, nm1 string, city string, pc5 string, amt double"
    ).withColumn("amt", F.col("amt").cast("decimal(18,2)"))


def geonames(spark):
    rows = [
        ("PL", "30-001", "Kraków", "MP", "Kraków", 50.06, 19.93, 0),
        ("PL", "30-002", "Łódź", "LD", "Łódź", 51.75, 19.45, 1),
        ("PL", "30-002", "Łódź", "LD", "Łódź", 51.77, 19.47, 2),
        ("PL", "30-009", "Kraków", "MP", "inny", 50.0, 19.9, 3),
    ]
    return spark.createDataFrame(
        rows, "country_code string, postal_code string, place_name string, admin_name1 string, admin_name2 string, "
        "latitude double, longitude double, row_no long"
    ).withColumn("admin_code2", F.lit("1"))


def merchants_of(rows, geo):
    hubs = registry.hub_postcodes(rows, 6)
    centroids, cities = registry.postcode_centroids(geo), registry.unambiguous_city_county(geo)
    placed = registry.name_parts_join(registry.resolve_place(registry.flag_hub_rows(rows, hubs), centroids, cities))
    stored = registry.till_rep_join(placed, registry.till_components(registry.till_cooccurrence(placed)))
    keyed = registry.multi_outlet_merchants(stored, registry.multi_outlets(stored))
    return keyed, registry.merchant_dim(keyed, registry.merchant_location(keyed), centroids)


def test_name_months_give_the_row_level_registry(spark):
    rows, geo = registry.card_present(tx(spark)), geonames(spark)
    _, by_row = merchants_of(rows, geo)
    _, by_month = merchants_of(registry.name_months(rows), geo)
    assert by_row.count() > 5
    assert sorted(map(str, by_row.collect())) == sorted(map(str, by_month.collect()))


def test_unambiguous_city(spark):
    got = {r.city_norm: r.powiat_key for r in registry.unambiguous_city_county(geonames(spark)).collect()}
    assert got == {"LODZ": "LD|Łódź"}  # Kraków is in two counties here


def test_one_aggregate_equals_join_of_two(spark):
    rows, geo = registry.card_present(tx(spark)), geonames(spark)
    keyed, _ = merchants_of(rows, geo)
    marked = keyed.withColumns(
        {"weekend": F.col("amt") > 100, "dinner": F.col("amt") < 50, "home_pc5": F.lit("30001"),
         "is_foreign": F.lit(False), "is_premium": F.col("month") % 2 == 0, "is_business": F.lit(None).cast("boolean")}
    )
    known = keyed.select(F.col("merchant").alias("store"), F.lit("30001").alias("shop_pc"), F.lit("train").alias("split")).distinct()
    window = (202502, 202504)
    rollup = registry.month_window(marked, window).groupBy("card", "month", "mcc", "pc5", "nm1").agg(*demand._rollup_sums())
    joined = demand.nullsafe_key_join(rollup, demand.merchant_key(keyed, window), known)
    direct = demand.shop_card_months(marked, known, window)
    assert joined.count() > 100
    assert sorted(map(str, joined.collect())) == sorted(map(str, direct.collect()))


def test_location_prefers_first_month_then_count_then_code(spark):
    rows = [("m", 202502, "30009", 9), ("m", 202501, "30003", 2), ("m", 202501, "30002", 2), ("m", 202501, "30001", 1)]
    df = spark.createDataFrame(rows, "merchant string, month int, pc5 string, n int").withColumns(
        {"hub": F.lit(False), "pc_known": F.lit(True)}
    )
    assert registry.merchant_location(df).first().asDict() == {"merchant": "m", "loc_pc5": "30002", "loc_month": 202501}


def test_till_revenue_main_category_and_refunds(spark):
    rows = [("R", "m", "c1", 5812, 202501, 10.0), ("R", "m", "c1", 5814, 202502, 10.0), ("R", "m", "c2", 5814, 202503, -5.0),
            ("S", "m", "c1", 5814, 202501, -3.0), ("S", "m", "c1", 5812, 202412, 99.0)]
    df = spark.createDataFrame(rows, "mrch_nm_raw string, merchant string, card string, mcc int, month int, amt double")
    got = {r.mrch_nm_raw: r for r in shops.till_revenue(df.withColumn("amt", F.col("amt").cast("decimal(18,2)")), Params()).collect()}
    assert got["R"].mrch_catg_cd == 5812 and got["R"].cards_2025 == 2 and got["R"].months_active_2025 == 3
    assert float(got["R"].revenue_2025) == 15.0 and got["R"].revenue_h2_2025 is None
    assert got["S"].mrch_catg_cd == 5814 and float(got["S"].revenue_2025) == -3.0


def test_leave_one_out_of_a_single_shop_area_is_zero(spark):
    cols = {c: F.col("id") * 1.5 + i for i, c in enumerate(demand.SUM_COLUMNS)}
    comp = spark.range(6).withColumns(cols).withColumns(
        {"store": F.col("id").cast("string"), "shop_pc": F.when(F.col("id") < 5, F.when(F.col("id") < 4, "30001").otherwise("30002")),
         "split": F.when(F.col("id") == 3, "test").otherwise("train")}
    )
    got = {r.store: r.spend for r in demand.leave_one_out(comp).collect()}
    assert got["4"] == 0.0  # alone in its postcode
    assert got["5"] == -7.5  # no postcode: nothing but its own part taken away
    assert got["3"] == 0 + 1.5 + 3.0  # a test shop keeps all training shops
    assert got["0"] == 1.5 + 3.0


def test_a_window_of_six_years(spark):
    window = (202001, 202512)
    months = [year * 100 + month for year in range(2019, 2027) for month in range(1, 13)]
    df = spark.createDataFrame([(m,) for m in months], "month int").withColumn("half", F.col("month") % 2)
    parts = df.groupBy("half").agg(*registry.month_words(window))
    assert parts.agg(registry.months_seen(window).alias("n")).first().n == 72


def test_each_spelling_of_a_place_is_cleaned_once(spark):
    rows = [("Łódź", "a", "b", n) for n in range(5)] + [("LODZ", "a", "b", 9), ("Kraków", "a", None, 0), ("Kraków", "a", "b", 7), (None, "a", "b", None), ("nan", "a", "c", 3)]
    geo = spark.createDataFrame(rows, "place_name string, admin_name1 string, admin_name2 string, row_no long")
    found = registry.unambiguous_city_county(geo)
    # The first row of Kraków has no county; a missing name and "nan" are one, in two counties.
    assert [tuple(r) for r in found.collect()] == [("LODZ", "a|b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[place_name" in plan  # counted by spelling before any is cleaned
