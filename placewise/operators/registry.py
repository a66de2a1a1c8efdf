"""Merchant registry: hubs, places, tills, outlets, locations, training rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import flags, text
from placewise.functions.brands import assign_brands
from placewise.operators.common import hot_keys, skew_join
from placewise.params import (
    ACTIVE_MIN_CARDS,
    COUNTRY,
    HUB_MCCS,
    HUB_MIN_NAMES,
    MIN_SHOPS_PER_MCC,
    MODEL_MCCS,
    Window,
    months_in,
)


def domestic_purchases(card_tx: DataFrame, mccs: Sequence[int], country: int = COUNTRY) -> DataFrame:
    return card_tx.where(
        (F.col("mrch_ctry_cd") == country) & (F.col("transaction_type") != "ATM") & F.col("mrch_catg_cd").isin(*mccs)
    )


def clean_names(rows: DataFrame) -> DataFrame:
    """Adds the cleaned name, city and postcode of the booked texts."""
    return rows.withColumns(
        {
            "nm1": text.strip_tills(text.name_norm(F.col("mrch_nm_raw"))),
            "city": text.name_norm(F.col("mrch_city_nm_raw")),
            "pc5": text.pc5(F.col("mrch_postal_code")),
        }
    )


def purchase_rows(card_tx: DataFrame, country: int = COUNTRY, mccs: Sequence[int] = HUB_MCCS) -> DataFrame:
    """Domestic purchases with short names; texts as booked."""
    return domestic_purchases(card_tx, mccs, country).withColumnsRenamed(
        {
            "pymt_crd_acct_num_raw": "card",
            "prch_mnth_id": "month",
            "mrch_catg_cd": "mcc",
            "cp_flag": "cp",
            "cs_tran_amt": "amt",
        }
    )


def card_marks(rows: DataFrame) -> DataFrame:
    """Adds the marks of time and card that the area features are made of."""
    return rows.withColumns(
        {
            "weekend": flags.is_weekend(F.col("prch_dt")),
            "dinner": flags.is_dinner_number(F.col("tran_id_gmt_tm")),
            "home_pc5": text.pc5(F.col("pstl_cd_enr")),
            "is_foreign": flags.is_foreign(F.col("issr_ctry_cd")),
            "is_premium": flags.is_premium(F.col("crd_typ_nm")),
            "is_business": flags.is_business(F.col("prod_id_pltfrm_cd_vcis")),
        }
    )


MARKS = ("weekend", "dinner", "home_pc5", "is_foreign", "is_premium", "is_business")
TX_COLUMNS = ("card", "month", "mcc", "cp", "nm1", "city", "pc5", "amt")


def restaurant_tx(card_tx: DataFrame, country: int = COUNTRY, mccs: Sequence[int] = HUB_MCCS) -> DataFrame:
    return clean_names(purchase_rows(card_tx, country, mccs)).select(*TX_COLUMNS)


RAW_KEY = ("mrch_nm_raw", "mrch_city_nm_raw", "mrch_postal_code", "month")


def booked_rows(card_tx: DataFrame, mccs: Sequence[int] = HUB_MCCS) -> DataFrame:
    """Card-present purchases.  A missing city or postcode counts as an empty one,
    which cleans to the same, so these keys join as plain text."""
    rows = card_present(purchase_rows(card_tx, mccs=mccs))
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("mrch_city_nm_raw", "mrch_postal_code")})


def raw_months(card_tx: DataFrame, mccs: Sequence[int] = HUB_MCCS) -> DataFrame:
    """Payments and spend per name, city and postcode as booked, month and category.

    Booked texts repeat from payment to payment.  Summing by them first leaves
    the text cleaning to one row per text and month.
    """
    return booked_rows(card_tx, mccs).groupBy(*RAW_KEY, "mcc").agg(F.sum("amt").alias("amt"), F.count("*").alias("n"))


def name_months(tx: DataFrame) -> DataFrame:
    """Rows and spend per (name, city, postcode, month, category), card-present.

    Hub, place, till number, store and merchant of a row depend on these alone,
    so the whole registry runs on this table, which has a row per merchant name
    and month, not per payment.  ``n`` is the number of payments.
    """
    keys = ("nm1", "city", "pc5", "month", "mcc")
    rows = card_present(tx) if "cp" in tx.columns else tx
    sums = rows.groupBy(*keys).agg(F.sum("amt").alias("amt"), row_count(tx).alias("n"))
    return sums.withColumn("cp", F.lit(1))


def row_count(df: DataFrame) -> Column:
    """Payments a frame stands for: the sum of ``n`` where rows are summed already."""
    return F.sum("n") if "n" in df.columns else F.count("*")


def card_present(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("cp") == 1)


def month_window(tx: DataFrame, window: Window) -> DataFrame:
    return tx.where(F.col("month").between(*window))


def in_window(window: Window, month: str = "month") -> Column:
    return F.col(month).between(*window)


def sum_where(value: Column, test: Column) -> Column:
    """SUM(value) FILTER (WHERE test): NULL when no row passes."""
    return F.sum(F.when(test, value))


MONTHS_PER_WORD = 62


def month_bit(month: Column, window: Window, word: int = 0) -> Column:
    """One bit per month of a window, 0 outside it: OR-ing bits counts months
    with a map-side combine, which a distinct count over a second key cannot.
    A word holds 62 months; longer windows take as many as they need."""
    lo = window[0]
    index = (F.floor(month / 100) - lo // 100) * 12 + month % 100 - lo % 100 - word * MONTHS_PER_WORD
    bit = F.pow(F.lit(2.0), index).cast("bigint")
    return F.when(month.between(*window) & index.between(0, MONTHS_PER_WORD - 1), bit).otherwise(F.lit(0).cast("bigint"))


def month_words(window: Window) -> list[Column]:
    """Aggregates ``months_0``, ``months_1``, ...: the months of a group."""
    words = -(-months_in(window) // MONTHS_PER_WORD)
    return [F.bit_or(month_bit(F.col("month"), window, i)).alias(f"months_{i}") for i in range(words)]


def months_seen(window: Window) -> Column:
    """Aggregate over ``month_words`` of the parts of a group: how many months it has."""
    words = range(len(month_words(window)))
    return reduce(lambda a, b: a + b, [F.bit_count(F.bit_or(f"months_{i}")) for i in words])


def hub_postcodes(tx: DataFrame, min_names: int = HUB_MIN_NAMES) -> DataFrame:
    """(pc5, month) pairs under which very many merchant names are booked."""
    return (
        card_present(tx)
        .where(F.col("pc5").isNotNull())
        .groupBy("pc5", "month")
        .agg(F.count_distinct("nm1").alias("n_names"))
        .where(F.col("n_names") >= min_names)
    )


def scan_counts(tx: DataFrame, hubs: DataFrame, merchants: DataFrame) -> DataFrame:
    """What a run reports of its registry: rows, card-present rows, hubs, merchants, located ones."""
    located = F.col("located") & F.col("mcc").isin(*MODEL_MCCS)
    rows = tx.agg(F.count("*").alias("n"), F.count_if(F.col("cp") == 1).alias("cp_rows"))
    return rows.select(
        "*",
        hubs.agg(F.count_distinct("pc5")).scalar().alias("hubs"),
        merchants.agg(F.count("*")).scalar().alias("merchants"),
        merchants.agg(F.count_if(located)).scalar().alias("located"),
    )


def flag_hub_rows(tx: DataFrame, hubs: DataFrame) -> DataFrame:
    marked = hubs.select("pc5", "month", F.lit(True).alias("hub"))
    return skew_join(tx, marked, ["pc5", "month"], "left", table=True).withColumn("hub", F.coalesce("hub", F.lit(False)))


def first_known(col: str, order: str = "row_no") -> Column:
    """First non-NULL value in the given order."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def postcode_centroids(geonames: DataFrame) -> DataFrame:
    return (
        geonames.withColumn("pc5", F.replace("postal_code", F.lit("-"), F.lit("")))
        .where(F.col("pc5").isNotNull())
        .groupBy("pc5")
        .agg(
            F.avg("latitude").alias("lat"),
            F.avg("longitude").alias("lon"),
            first_known("place_name").alias("place"),
            first_known("admin_name2").alias("powiat"),
            first_known("admin_code2").alias("powiat_code"),
            first_known("admin_name1").alias("voiv"),
            F.count("*").alias("n_places"),
        )
        .withColumn("powiat_key", F.concat("voiv", F.lit("|"), "powiat"))
    )


def unambiguous_city_county(geonames: DataFrame) -> DataFrame:
    """City -> county for names found in exactly one county.

    Places repeat from code to code: each spelling is cleaned once per county.
    """
    county = F.concat("admin_name1", F.lit("|"), "admin_name2")
    spelled = geonames.groupBy("place_name", county.alias("county")).agg(F.min("row_no").alias("row_no"))
    return (
        spelled.select(text.place_norm(F.coalesce("place_name", F.lit("nan"))).alias("city_norm"), "county", "row_no")
        .groupBy("city_norm")
        .agg(
            F.min("county").alias("least"),
            F.max("county").alias("most"),
            F.min_by("county", "row_no").alias("powiat_key"),
        )
        .where((F.col("least") == F.col("most")) & F.col("powiat_key").isNotNull())
        .select("city_norm", "powiat_key")
    )


def resolve_place(tx: DataFrame, centroids: DataFrame, city_county: DataFrame) -> DataFrame:
    """County of the postcode, else of an unambiguous city, else ``C:city``."""
    by_code = centroids.select("pc5", F.col("powiat_key").alias("_code_place"), F.lit(True).alias("pc_known"))
    by_city = city_county.select(F.col("city_norm").alias("city"), F.col("powiat_key").alias("_city_place"))
    located = skew_join(skew_join(tx, by_code, ["pc5"], "left", table=True), by_city, ["city"], "left", table=True)
    return (
        located.withColumn("place", F.coalesce("_code_place", "_city_place", F.concat(F.lit("C:"), "city")))
        .withColumn("pc_known", F.coalesce("pc_known", F.lit(False)))
        .drop("_code_place", "_city_place")
    )


def distinct_names(tx: DataFrame) -> DataFrame:
    return tx.select("nm1").distinct()


def name_parts_join(tx: DataFrame) -> DataFrame:
    base, number = text.split_trailing_number(F.col("nm1"))
    return tx.withColumns({"base": base, "num": number})


def till_cooccurrence(rest_cp: DataFrame) -> DataFrame:
    """Till numbers of one name seen at one postcode in one month, where several."""
    nums = F.sort_array(F.collect_set("num"))  # at most '' and 110 one- or two-digit texts
    return (
        rest_cp.where(~F.col("hub") & F.col("pc5").isNotNull())
        .groupBy("base", "place", "pc5", "month")
        .agg(nums.alias("nums"))
        .where(F.size("nums") > 1)
    )


def till_components(cooccurrence: DataFrame) -> DataFrame:
    """Connected till numbers per (base, place) and the number that stands for them.

    The links of a group are distinct pairs of at most 111 texts, so a group is
    bounded however many rows it came from; they are folded into disjoint sets.
    """
    links = (
        cooccurrence.select(
            "base", "place", F.explode(F.slice("nums", F.lit(2), F.size("nums"))).alias("other"), F.get("nums", F.lit(0)).alias("least")
        )
        .groupBy("base", "place")
        .agg(F.sort_array(F.collect_set(F.array("least", "other"))).alias("links"))
    )

    def fold(sets: Column, link: Column) -> Column:
        touching = F.filter(sets, lambda s: F.arrays_overlap(s, link))
        apart = F.filter(sets, lambda s: ~F.arrays_overlap(s, link))
        return F.concat(apart, F.array(F.array_distinct(F.concat(link, F.flatten(touching)))))

    empty = F.array().cast("array<array<string>>")
    return (
        links.select("base", "place", F.explode(F.aggregate("links", empty, fold)).alias("nums"))
        .withColumn("rep", F.array_min("nums"))
        .select("base", "place", F.explode("nums").alias("num"), "rep")
    )


def till_rep_join(rest_cp: DataFrame, components: DataFrame) -> DataFrame:
    joined = skew_join(rest_cp, components, ["base", "place", "num"], "left", table=True)
    return joined.withColumn("store_nm", text.store_name(F.col("base"), F.coalesce("rep", "num"))).drop("rep")


def multi_outlets(rest_cp: DataFrame, min_pcs: int = 2, min_months: int = 3) -> DataFrame:
    monthly = (
        rest_cp.where(~F.col("hub") & F.col("pc5").isNotNull())
        .groupBy("store_nm", "place", "month")
        .agg(F.count_distinct("pc5").alias("pcs"))
    )
    return (
        monthly.groupBy("store_nm", "place")
        .agg(F.count_if(F.col("pcs") >= min_pcs).alias("n"))
        .where(F.col("n") >= min_months)
        .select("store_nm", "place")
    )


def multi_outlet_merchants(rest_cp: DataFrame, outlets: DataFrame) -> DataFrame:
    marked = outlets.select("store_nm", "place", F.lit(True).alias("_multi"))
    joined = skew_join(rest_cp, marked, ["store_nm", "place"], "left", table=True)
    key = text.merchant_id(
        F.col("store_nm"), F.col("place"), F.coalesce("_multi", F.lit(False)), F.col("hub"), F.col("pc5")
    )
    return joined.withColumn("merchant", key).drop("_multi")


def non_hub_rows(rest_cp: DataFrame) -> DataFrame:
    return rest_cp.where(~F.col("hub") & F.col("pc_known") & ~F.col("merchant").endswith("|HUB"))


def merchant_location(rest_cp: DataFrame) -> DataFrame:
    """First month's most frequent non-hub postcode, the smallest code on ties."""
    seen = non_hub_rows(rest_cp).groupBy("merchant", "month", "pc5").agg(row_count(rest_cp).alias("n"))
    order = F.struct(F.col("month"), -F.col("n"), F.col("pc5"))
    return seen.groupBy("merchant").agg(F.min_by("pc5", order).alias("loc_pc5"), F.min("month").alias("loc_month"))


def dominant_mcc(tx: DataFrame) -> DataFrame:
    spent = tx.groupBy("merchant", "mcc").agg(F.sum("amt").alias("spend"), row_count(tx).alias("n"))
    return spent.groupBy("merchant").agg(F.max_by("mcc", F.struct("spend", "n", -F.col("mcc"))).alias("mcc"))


def merchant_attributes(rest_cp: DataFrame) -> DataFrame:
    """One row per merchant.

    Sums by (merchant, city, pc5) come first, so a merchant with very many rows
    is small before it meets in one task.  A merchant's store and place belong
    to it; as group keys they keep these sums on numbers, which Spark hashes.
    """
    shop = ("merchant", "store_nm", "place")
    sums = [F.min("month").alias("month"), F.sum("amt").alias("amt")]
    fine = rest_cp.groupBy(*shop, "city", "pc5").agg(*sums, row_count(rest_cp).alias("n"))
    by_city = fine.groupBy(*shop, "city").agg(*sums, F.sum("n").alias("n"))
    whole = by_city.groupBy("merchant").agg(
        F.min("store_nm").alias("store_nm"),
        F.min("place").alias("place"),
        F.min_by("city", F.struct(-F.col("n"), F.col("city"))).alias("city"),
        F.min("month").alias("first_month_ever"),
        F.sum("amt").alias("spend_all"),
    )
    booked = fine.groupBy("merchant").agg(F.count_distinct("pc5").alias("booked_postcodes"))
    return whole.join(booked, "merchant")


def merchant_join(rest_cp: DataFrame, location: DataFrame, centroids: DataFrame) -> DataFrame:
    """Attributes, dominant MCC, location and its gazetteer entry per merchant."""
    place = centroids.select(
        F.col("pc5").alias("loc_pc5"), "lat", "lon", F.col("place").alias("loc_place"), F.col("powiat").alias("loc_powiat")
    )
    base = (
        merchant_attributes(rest_cp)
        .join(dominant_mcc(rest_cp), "merchant")
        .join(location.select("merchant", "loc_pc5"), "merchant", "left")
    )
    return skew_join(base, place, ["loc_pc5"], "left", table=True)


def registration_addresses(merchants: DataFrame, min_merchants: int = 5) -> DataFrame:
    """(brand, postcode) pairs that hold so many merchants that they are an office."""
    return (
        merchants.where(~F.col("vending") & ~F.col("generic_name") & F.col("loc_pc5").isNotNull())
        .groupBy("brand", "loc_pc5")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_merchants)
        .select("brand", "loc_pc5")
    )


def flag_located(branded: DataFrame, addresses: DataFrame) -> DataFrame:
    marked = addresses.select("brand", "loc_pc5", F.lit(True).alias("registration"))
    flagged = skew_join(branded, marked, ["brand", "loc_pc5"], "left").withColumn(
        "registration", F.coalesce("registration", F.lit(False))
    )
    return flagged.withColumn("located", F.col("loc_pc5").isNotNull() & ~F.col("registration") & ~F.col("vending"))


MERCHANT_COLUMNS = (
    "merchant", "store_nm", "place", "city", "first_month_ever", "spend_all", "booked_postcodes", "mcc", "loc_pc5",
    "lat", "lon", "loc_place", "loc_powiat", "brand", "vending", "generic_name", "chain", "registration", "located",
)


def merchant_dim(
    rest_cp: DataFrame, location: DataFrame, centroids: DataFrame, min_registrations: int = 5
) -> DataFrame:
    branded = assign_brands(merchant_join(rest_cp, location, centroids))
    return flag_located(branded, registration_addresses(branded, min_registrations)).select(*MERCHANT_COLUMNS)


def located_merchants(merchants: DataFrame) -> DataFrame:
    return merchants.where(F.col("located"))


def merchant_tx(rest_cp: DataFrame, merchants: DataFrame, mccs: Sequence[int] = MODEL_MCCS) -> DataFrame:
    shops = located_merchants(merchants).select("merchant", F.col("loc_pc5").alias("_loc"), "brand")
    rows = rest_cp.where(F.col("mcc").isin(*mccs))
    hot = hot_keys(rows.groupBy("merchant").agg(row_count(rows).alias("n")), ["merchant"])
    joined = skew_join(rows.select("merchant", "mcc", "card", "month", "amt"), shops, ["merchant"], hot=hot, table=True)
    return joined.select("merchant", F.col("_loc").alias("pc5"), "brand", "mcc", "card", "month", "amt")


def shops_in_mcc(rows: DataFrame, min_shops: int = MIN_SHOPS_PER_MCC) -> DataFrame:
    """Rows of categories with enough shops, and that number."""
    sizes = rows.where(F.col("mcc").isNotNull()).groupBy("mcc").agg(F.count("*").alias("shops_in_mcc"))
    # A category code has four digits, so this side has at most 10,000 rows.
    return rows.join(F.broadcast(sizes.where(F.col("shops_in_mcc") >= min_shops)), "mcc")


TRAINING_COLUMNS = (
    "merchant", "brand", "pc5", "revenue", "cards", "months_active", "mcc", "lat", "lon", "place", "powiat",
    "powiat_key", "shops_in_mcc",
)


def training_rows(
    m_tx: DataFrame,
    centroids: DataFrame,
    window: Window,
    min_cards: int = ACTIVE_MIN_CARDS,
    min_shops: int = MIN_SHOPS_PER_MCC,
) -> DataFrame:
    year = month_window(m_tx, window)
    # brand and pc5 belong to the merchant; as group keys they keep the
    # aggregates on numbers, which Spark hashes instead of sorting rows.
    shop = ("merchant", "brand", "pc5")
    per_card = year.groupBy(*shop, "card").agg(
        F.sum("amt").alias("amt"), *month_words(window)
    )
    per_shop = per_card.groupBy(*shop).agg(
        F.sum("amt").alias("revenue"),
        F.count("card").alias("cards"),
        months_seen(window).alias("months_active"),
    )
    place = centroids.select("pc5", "lat", "lon", "place", "powiat", "powiat_key")
    active = per_shop.where(F.col("cards") >= min_cards).join(dominant_mcc(year), "merchant")
    return shops_in_mcc(skew_join(active, place, ["pc5"], table=True), min_shops).select(*TRAINING_COLUMNS)
