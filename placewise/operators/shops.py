"""Shops: raw till rows re-keyed to merchants, revenue windows, brand tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import text
from placewise.operators.common import hash_split, hot_keys, skew_join
from placewise.operators.registry import (
    RAW_KEY,
    domestic_purchases,
    in_window,
    month_words,
    months_seen,
    row_count,
    sum_where,
)
from placewise.params import MODEL_MCCS, TRAIN_SHARE, Params, months_in


def key_store(rest_cp: DataFrame, mccs: Sequence[int] = MODEL_MCCS) -> DataFrame:
    """Which merchant a (name, city, postcode, month) belongs to, and its payments."""
    return (
        rest_cp.where(F.col("mcc").isin(*mccs))
        .groupBy("nm1", "city", "pc5", "month")
        .agg(F.min("merchant").alias("merchant"), F.bool_or("hub").alias("hub"), row_count(rest_cp).alias("n"))
    )


def raw_till_tx(card_tx: DataFrame, mccs: Sequence[int] = MODEL_MCCS) -> DataFrame:
    """Card-present rows that keep the name as booked beside the cleaned keys."""
    return domestic_purchases(card_tx, mccs).where(F.col("cp_flag") == 1).select(
        "mrch_nm_raw",
        text.strip_tills(text.name_norm(F.col("mrch_nm_raw"))).alias("nm1"),
        text.name_norm(F.col("mrch_city_nm_raw")).alias("city"),
        text.pc5(F.col("mrch_postal_code")).alias("pc5"),
        F.col("prch_mnth_id").alias("month"),
        F.col("mrch_catg_cd").alias("mcc"),
        F.col("pymt_crd_acct_num_raw").alias("card"),
        F.col("cs_tran_amt").alias("amt"),
    )


KEY = ("nm1", "city", "pc5", "month")


def raw_to_merchant(raw_tx: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with their merchant.  The keys' own counts tell which are hot."""
    hot = hot_keys(keys, KEY)
    return skew_join(raw_tx, keys.drop("n"), KEY, "inner", null_safe=("city", "pc5"), hot=hot)


def booked_keys(cleaned_months: DataFrame, keys: DataFrame) -> DataFrame:
    """Merchant, and whatever else ``keys`` tells, per name, city, postcode and month as booked."""
    cleaned = cleaned_months.groupBy(*RAW_KEY, "nm1", "city", "pc5").agg(F.sum("n").alias("n"))
    named = keys.drop("n").withColumnsRenamed({c: f"_{c}" for c in KEY})
    # Both sides have one row per key or spelling of it, so no key is hot.
    same = [cleaned[c].eqNullSafe(F.col(f"_{c}")) if c == "pc5" else cleaned[c] == F.col(f"_{c}") for c in KEY]
    return cleaned.join(named, reduce(lambda a, b: a & b, same)).drop(*[f"_{c}" for c in KEY])


def booked_to_merchant(rows: DataFrame, booked: DataFrame) -> DataFrame:
    """Payments with their merchant, joined on the texts as booked."""
    hot = hot_keys(booked, RAW_KEY)
    return skew_join(rows, booked.drop("n"), RAW_KEY, "inner", null_safe=("mrch_nm_raw",), hot=hot, table=True)


def till_revenue(raw_st: DataFrame, params: Params = Params()) -> DataFrame:
    """Per booked name and merchant: revenue windows, cards, months, main category.

    The first step is per card, so its map-side combine shrinks a hot till;
    months travel as bits, which leaves no distinct count to expand rows for.
    """
    year = in_window(params.train_year)
    # Largest payment, then smaller code, as one number: cents, then 9999 - code.
    cents = (F.col("amt").cast("decimal(18,2)") * 1_000_000).cast("decimal(26,0)")
    best = (cents + (F.lit(9999) - F.col("mcc"))).cast("decimal(27,0)")
    per_card = raw_st.groupBy("mrch_nm_raw", "merchant", "card").agg(
        sum_where(F.col("amt"), year).alias("year_amt"),
        sum_where(F.col("amt"), in_window(params.half_first)).alias("first_amt"),
        sum_where(F.col("amt"), in_window(params.half_second)).alias("second_amt"),
        *month_words(params.train_year),
        F.max(F.when(year, best)).alias("best"),
    )
    any_month = F.greatest(F.lit(0), *[F.col(c) for c in per_card.columns if c.startswith("months_")]) > 0
    return (
        per_card.groupBy("mrch_nm_raw", "merchant")
        .agg(
            F.sum("year_amt").alias("revenue_2025"),
            F.sum("first_amt").alias("revenue_h2_2025"),
            F.sum("second_amt").alias("revenue_h1_2026"),
            F.count(F.when(any_month, F.col("card"))).alias("cards_2025"),
            months_seen(params.train_year).alias("months_active_2025"),
            (F.lit(9999) - F.pmod(F.max("best"), F.lit(10_000))).cast("int").alias("mrch_catg_cd"),
        )
        .withColumn("full_year_2025", F.col("months_active_2025") == months_in(params.train_year))
    )


TILL_COLUMNS = (
    "mrch_nm_raw", "store", "brand", "pc5", "district", "mrch_catg_cd", "revenue_h2_2025", "revenue_h1_2026",
    "cards_2025", "months_active_2025", "full_year_2025",
)


def till_to_training_rows(tills: DataFrame, rows: DataFrame) -> DataFrame:
    known = rows.select("merchant", "brand", "pc5", F.col("powiat").alias("district"))
    joined = skew_join(tills.where(F.col("revenue_2025") > 0), known, ["merchant"], "inner", table=True)
    return joined.withColumnRenamed("merchant", "store").select(*TILL_COLUMNS)


def year_revenue(tills: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return tills.withColumn(
        "year_revenue", F.coalesce("revenue_h2_2025", zero) + F.coalesce("revenue_h1_2026", zero)
    )


def first_per_shop(tills: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """First known value of each column per store, tills ordered from the largest."""
    rank = F.struct(*(order or [-F.col("year_revenue"), F.col("mrch_nm_raw")]))
    rest = [c for c in tills.columns if c != "store"]
    return tills.groupBy("store").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
    )


def shop_table(tills: DataFrame) -> DataFrame:
    """One row per shop: its largest till's attributes, sums over all its tills."""
    t = year_revenue(tills)
    rank = F.struct(-F.col("year_revenue"), F.col("mrch_nm_raw"))
    rest = [c for c in t.columns if c != "store"]
    shops = t.groupBy("store").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest],
        F.sum("year_revenue").alias("revenue"),
        F.sum("cards_2025").alias("cards"),
        F.max("months_active_2025").alias("months_active"),
        F.max("full_year_2025").alias("full_year"),
    )
    kept = shops.where((F.col("revenue") > 0) & F.col("pc5").isNotNull())
    named = kept.withColumn("postcode", text.postcode_dash(F.col("pc5"))).withColumn(
        "brand", F.coalesce("brand", "store")
    )
    return brand_tier(named)


def brand_tier(shops: DataFrame) -> DataFrame:
    """small = one shop of the brand, medium = fewer than five, else big."""
    sizes = shops.groupBy("brand").agg(F.count_distinct("store").alias("_of_brand"))
    n = F.col("_of_brand")
    tier = F.when(n == 1, "small").when(n < 5, "medium").otherwise("big")
    return skew_join(shops, sizes, ["brand"], "left").withColumn("brand_tier", tier).drop("_of_brand")


def shop_split(shops: DataFrame, key: str = "store", train_share: float = TRAIN_SHARE) -> DataFrame:
    return hash_split(shops, key, train_share)


def split_shops(shops: DataFrame) -> DataFrame:
    """(store, shop_pc, split) as the demand stage needs it."""
    return shop_split(shops).select("store", text.pc5(F.col("postcode")).alias("shop_pc"), "split")


