from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewise.operators import common


def numbers(seed: int, n: int) -> list[float]:
    rng = random.Random(seed)
    odd = [0.0, 0.0, -1.5, 1e-12, 1e12, -1e9, 7.25, 7.25, 7.25]
    return odd + [float(rng.choice([rng.gauss(0, 1000), rng.randint(-5, 5), rng.lognormvariate(5, 3)])) for _ in range(n)]


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [("hot" if i % 3 else f"g{i % 40}", v) for i, v in enumerate(numbers(1, 1500))]
    rows += [("none", None), (None, 3.0), (None, 5.0)]
    return spark.createDataFrame(rows, "k string, v double"), pd.DataFrame(rows, columns=["k", "v"])


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_quantile_equals_numpy(grouped, q):
    df, pdf = grouped
    got = {r.k: r.v for r in common.grouped_quantile(df, ["k"], "v", q).collect()}
    want = pdf.dropna(subset=["v"]).groupby("k", dropna=False)["v"].quantile(q)
    want = {(None if isinstance(k, float) else k): v for k, v in want.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12)


def test_quantile_of_everything(grouped):
    df, pdf = grouped
    assert common.grouped_quantile(df, [], "v").first()[0] == pytest.approx(np.median(pdf["v"].dropna()), rel=1e-12)


def test_medians_of_columns(spark):
    pdf = pd.DataFrame({"k": [1, 1, 1, 2, 2, 3], "a": [1.0, 9, 4, 2, None, None], "b": [5.0, 5, 6, None, 1, None]})
    rows = [(r.k, None if pd.isna(r.a) else r.a, None if pd.isna(r.b) else r.b) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = {r.k: (r.a, r.b) for r in common.grouped_medians(df, ["k"], ["a", "b"]).collect()}
    assert got == {1: (4.0, 5.0), 2: (2.0, 1.0), 3: (None, None)}


def test_bucket_never_falls(spark):
    df = spark.createDataFrame([(v,) for v in numbers(2, 500)], "v double").withColumn("b", common.order_bucket(F.col("v")))
    rows = sorted((r.v, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))


def test_average_rank(spark):
    values = numbers(3, 400)
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = {r.id: r["rank"] for r in common.average_rank(df, "v").collect()}
    want = pd.Series(values).rank(method="average")
    assert all(got[i] == want[i] for i in range(len(values)))


def test_running_best(spark):
    rng = random.Random(4)
    rows = [("a" if i % 3 else "b", rng.choice(numbers(5, 60)), i, rng.randint(0, 100)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, key double, id int, v int")
    got = {r.id: r.best for r in common.running_best(df, ["g"], "key", ["id"], "v", "best").collect()}
    for g, key, i, _ in rows:
        before = [v for h, k, j, v in rows if h == g and (k, j) < (key, i)]
        assert got[i] == (max(before) if before else None)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [(), ("k2",)])
@pytest.mark.parametrize("marked", [False, True])
def test_skew_join_equals_plain_join(spark, how, null_safe, marked):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k1"),
        F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("k2"),
        "id",
    )
    lookup = spark.createDataFrame(
        [("hot", None, 1), ("hot", "1", 2), ("7", "1", 3), ("7", None, 4), ("8", "0", 5), ("99", "0", 6)],
        "k1 string, k2 string, v int",
    )
    hot = common.hot_keys(big.groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"]) if marked else None
    got = common.skew_join(big, lookup, ["k1", "k2"], how, null_safe=null_safe, hot=hot)
    other = lookup.toDF("a1", "a2", "v")
    test = big.k2.eqNullSafe(other.a2) if null_safe else big.k2 == other.a2
    want = big.join(other, (big.k1 == other.a1) & test, how).select("k1", "k2", "id", "v")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_keys_are_few(spark):
    counts = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") == 7, 10_000).otherwise(1).alias("n"))
    # 10,000 of 14,999 rows fill 2.7 of four partitions.
    assert [tuple(r) for r in common.hot_keys(counts, ["k"]).collect()] == [(7, 3)]


def test_a_third_of_the_rows_does_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(initial, None)
    spark.conf.set(initial, "32")
    try:
        big = spark.range(0, 32_000, 1, 8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
        hot = common.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"])
        joined = common.skew_join(big, big.select("k").distinct().withColumn("v", F.lit(1)), ["k"], hot=hot)
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(tasks) == 32_000 and max(tasks) < 32_000 / 6
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set(initial, before) if before else spark.conf.unset(initial)


def test_table_bytes(spark):
    df = spark.createDataFrame([("ab", [(1.0, "x")], 3), (None, None, None)], "s string, a array<struct<d:double,t:string>>, n int")
    # Text 8 + 2 and 8; array 8 + (8 + 8 + 9) and 8; number 8 each.
    assert common.table_bytes(df) == 10 + 33 + 8 + 8 + 8 + 8
    assert common.table_bytes(df.limit(0)) == 0


def test_skewed_key_is_spread(spark):
    """One key with all rows lands in several partitions of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(0, 4000, 1, 4).select(F.lit("hot").alias("k"), "id")
        lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
        joined = common.skew_join(big, lookup, ["k"]).withColumn("p", F.spark_partition_id())
        assert joined.select("p").distinct().count() >= 3
        assert joined.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dedupe_keeps_first_with_null_keys(spark):
    rows = [(3, 1.0, None), (1, 1.0, None), (2, 1.0, "s"), (4, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, price double, street string")
    assert sorted(r.id for r in common.dedupe_keep_first(df, ["price", "street"], "id").collect()) == [1, 2, 4]


def test_hash_split_share(spark):
    df = common.hash_split(spark.range(20_000).select(F.col("id").cast("string").alias("k")), "k")
    assert 0.68 < df.where("split = 'train'").count() / 20_000 < 0.72


def test_rename_recode_unknown_code_is_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "m double")
    got = [r.x for r in common.rename_recode(df.withColumnRenamed("m", "x"), {}, {"x": {1: "one", 2: "two"}}).collect()]
    assert got == ["one", "two", None, None]
