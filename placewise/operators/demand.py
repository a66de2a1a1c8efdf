"""Area demand: who spends where, with every training shop left out of its own area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions import flags, text
from placewise.operators.common import skew_join
from placewise.operators.registry import (
    card_present,
    card_marks,
    clean_names,
    domestic_purchases,
    in_window,
    month_window,
    purchase_rows,
    sum_where,
)
from placewise.params import GROCERY_MCCS, LEISURE_MCCS, LODGING_MCCS, MODEL_MCCS, Params, Window
from placewise.sources.monthly import MonthlyTable

SUM_COLUMNS = (
    "spend", "txns", "cards", "local_spend", "foreign_spend", "premium_spend", "business_spend", "weekend_spend",
    "dinner_spend", "h1_2025", "h1_2026",
)
OTHER_GROUPS = {"grocery_spend": GROCERY_MCCS, "lodging_spend": LODGING_MCCS, "leisure_spend": LEISURE_MCCS}


def merchant_key(rest_cp: DataFrame, window: Window, mccs: Sequence[int] = MODEL_MCCS) -> DataFrame:
    return (
        month_window(rest_cp, window)
        .where((F.col("cp") == 1) & F.col("mcc").isin(*mccs))
        .groupBy("card", "month", "pc5", "nm1", "mcc")
        .agg(F.min("merchant").alias("merchant"))
    )


def _rollup_sums() -> list[Column]:
    return [
        F.sum("amt").alias("spend"),
        F.count("*").alias("txns"),
        sum_where(F.col("amt"), F.col("weekend")).alias("weekend_spend"),
        sum_where(F.col("amt"), F.col("dinner")).alias("dinner_spend"),
        # Five digits: their least text is their least number, which hashes.
        F.lpad(F.min(F.col("home_pc5").cast("int")).cast("string"), 5, "0").alias("home_pc5"),
        F.bool_or("is_foreign").alias("is_foreign"),
        F.bool_or("is_premium").alias("is_premium"),
        F.bool_or("is_business").alias("is_business"),
    ]


def card_month_rollup(card_tx: DataFrame, window: Window, mccs: Sequence[int] = MODEL_MCCS) -> DataFrame:
    """Spend of a card at a merchant name in a month, with card and time marks."""
    rows = clean_names(card_marks(month_window(card_present(purchase_rows(card_tx, mccs=mccs)), window)))
    return rows.groupBy("card", "month", "mcc", "pc5", "nm1").agg(*_rollup_sums())


def kept_card_months(spark: SparkSession, name: str, card_tx: DataFrame, mccs: Sequence[int] = MODEL_MCCS) -> MonthlyTable:
    """``card_month_rollup`` of all months as a table kept by month; call ``refresh`` before ``read``.

    A card-month depends on its month alone, so only changed months are summed anew.
    """
    def build(rows: DataFrame) -> DataFrame:
        cleaned = clean_names(card_marks(card_present(purchase_rows(rows, mccs=mccs))))
        return cleaned.groupBy("card", "month", "mcc", "pc5", "nm1").agg(*_rollup_sums())

    return MonthlyTable(spark, name, card_tx, build)


def shop_card_months(facts: DataFrame, shops: DataFrame, window: Window) -> DataFrame:
    """Card-months of known shops from rows that carry their merchant.

    Equals ``nullsafe_key_join`` of the rollup and the merchant keys: both are
    sums over the same groups of the same rows, so one aggregate gives them
    together and the join of two card-level tables falls away.
    """
    rows = month_window(facts, window)
    named = rows.groupBy("card", "month", "mcc", "pc5", "nm1").agg(*_rollup_sums(), F.min("merchant").alias("store"))
    return skew_join(named, shops.select("store", "shop_pc", "split"), ["store"], table=True).select(*SHOP_TX_COLUMNS)


SHOP_TX_COLUMNS = (
    "store", "shop_pc", "split", "month", "card", "home_pc5", "spend", "txns", "weekend_spend", "dinner_spend",
    "is_foreign", "is_premium", "is_business",
)


def nullsafe_key_join(rollup: DataFrame, keys: DataFrame, shops: DataFrame) -> DataFrame:
    """Card-months of known shops.  Both sides of the first join are unique on
    its key; postcodes match when both are NULL."""
    k = keys.select(
        F.col("card").alias("_card"), F.col("month").alias("_month"), F.col("mcc").alias("_mcc"),
        F.col("nm1").alias("_nm1"), F.col("pc5").alias("_pc5"), F.col("merchant").alias("store"),
    )
    same = (
        (F.col("card") == F.col("_card"))
        & (F.col("month") == F.col("_month"))
        & (F.col("mcc") == F.col("_mcc"))
        & (F.col("nm1") == F.col("_nm1"))
        & F.col("pc5").eqNullSafe(F.col("_pc5"))
    )
    named = rollup.join(k, same).drop("_card", "_month", "_mcc", "_nm1", "_pc5")
    return skew_join(named, shops.select("store", "shop_pc", "split"), ["store"], table=True).select(*SHOP_TX_COLUMNS)


def matched_counts(shop_tx: DataFrame, rollup: DataFrame) -> DataFrame:
    """Card-months of known shops, all card-months, and their ratio."""
    return shop_tx.agg(F.count("*").alias("matched")).select(
        "matched", rollup.agg(F.count("*")).scalar().alias("keyed")
    ).withColumn("share", F.try_divide(F.col("matched"), F.col("keyed")))


def shop_composition(shop_tx: DataFrame, window: Window, before: Window, after: Window) -> DataFrame:
    """Conditional sums and distinct cards per shop, first per card of the shop."""
    now = in_window(window)

    def part(value: str, test: Column | None = None) -> Column:
        return sum_where(F.col(value), now if test is None else now & test)

    sums = {
        "spend": part("spend"),
        "txns": part("txns"),
        "local_spend": part("spend", F.col("home_pc5").eqNullSafe(F.col("shop_pc"))),
        "foreign_spend": part("spend", F.col("is_foreign")),
        "premium_spend": part("spend", F.col("is_premium")),
        "business_spend": part("spend", F.col("is_business")),
        "weekend_spend": part("weekend_spend"),
        "dinner_spend": part("dinner_spend"),
        "h1_2025": sum_where(F.col("spend"), in_window(before)),
        "h1_2026": sum_where(F.col("spend"), in_window(after)),
    }
    # shop_pc and split belong to the store; as group keys they cost no sort.
    per_card = shop_tx.groupBy("store", "shop_pc", "split", "card").agg(
        F.bool_or(now).alias("_seen"), *[s.alias(n) for n, s in sums.items()]
    )
    return per_card.groupBy("store", "shop_pc", "split").agg(
        F.count(F.when(F.col("_seen"), F.col("card"))).alias("cards"),
        *[F.sum(n).alias(n) for n in sums],
    ).select("store", "shop_pc", "split", "spend", "txns", "cards", *SUM_COLUMNS[3:])


def train_residents(shop_tx: DataFrame, window: Window) -> DataFrame:
    return month_window(shop_tx, window).where((F.col("split") == "train") & F.col("home_pc5").isNotNull())


def home_wallet(shop_tx: DataFrame, window: Window) -> DataFrame:
    per_card = train_residents(shop_tx, window).groupBy("home_pc5", "card").agg(F.sum("spend").alias("spend"))
    return per_card.groupBy("home_pc5").agg(F.sum("spend").alias("spend"), F.count("card").alias("cards"))


def shop_home_spend(shop_tx: DataFrame, window: Window) -> DataFrame:
    return train_residents(shop_tx, window).groupBy("store", "home_pc5").agg(F.sum("spend").alias("spend"))


def catchment_by_postcode(nearby: DataFrame, wallet: DataFrame) -> DataFrame:
    return (
        skew_join(nearby, wallet, ["home_pc5"])
        .groupBy("shop_pc")
        .agg(F.sum("spend").alias("spend"), F.sum("cards").alias("cards"))
    )


def catchment_own(shops: DataFrame, nearby: DataFrame, shop_home: DataFrame) -> DataFrame:
    """A training shop's own part of its catchment's spending.

    Starts from (store, home) sums and tests them against the near pairs on
    both codes, so a shop is never multiplied by its neighbourhood.
    """
    own = shops.where(F.col("split") == "train").select("store", "shop_pc")
    placed = skew_join(shop_home, own, ["store"])
    return (
        skew_join(placed, nearby.select("shop_pc", "home_pc5"), ["shop_pc", "home_pc5"])
        .groupBy("store")
        .agg(F.sum("spend").alias("own_spend"))
    )


def catchment_join(
    nearby: DataFrame, wallet: DataFrame, shops: DataFrame, shop_home: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return catchment_by_postcode(nearby, wallet), catchment_own(shops, nearby, shop_home)


def area_other_spend(
    card_tx: DataFrame, window: Window, groups: dict[str, Sequence[int]] | None = None
) -> DataFrame:
    """Spend per postcode in other lines of trade, one column per line."""
    groups = groups or OTHER_GROUPS
    codes = sorted({m for mccs in groups.values() for m in mccs})
    rows = domestic_purchases(card_tx, codes).where(
        (F.col("cp_flag") == 1) & F.col("prch_mnth_id").between(*window)
    ).select(text.pc5(F.col("mrch_postal_code")).alias("pc5"), F.col("mrch_catg_cd").alias("mcc"), "cs_tran_amt")
    return rows.where(F.col("pc5").isNotNull()).groupBy("pc5").agg(
        *[sum_where(F.col("cs_tran_amt"), F.col("mcc").isin(*mccs)).alias(name) for name, mccs in groups.items()]
    )


def _area_totals(shop_comp: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    return (
        shop_comp.where((F.col("split") == "train") & F.col(group).isNotNull())
        .groupBy(group)
        .agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_all_{c}") for c in cols])
    )


def _own(col: str) -> Column:
    """A shop's own part of its area's total: nothing, unless it is a training shop."""
    return F.when(F.col("split") == "train", F.coalesce(col, F.lit(0))).otherwise(F.lit(0))


def leave_one_out(shop_comp: DataFrame, cols: Sequence[str] = SUM_COLUMNS, group: str = "shop_pc") -> DataFrame:
    """Area totals of the training shops, minus the shop itself where it is one."""
    joined = skew_join(shop_comp, _area_totals(shop_comp, cols, group), [group], "left")
    return joined.select("store", *[(F.coalesce(f"_all_{c}", F.lit(0)) - _own(c)).alias(c) for c in cols])


def leave_one_out_join(
    shop_comp: DataFrame, wallet: DataFrame, catchment: DataFrame, own: DataFrame, other: DataFrame
) -> DataFrame:
    """One row per shop: left-out area sums, resident wallet, catchment, other trade.

    Everything known per postcode is first joined per postcode, so shops meet
    it in one join.
    """
    zero = F.lit(0)
    sides = (
        wallet.select(F.col("home_pc5").alias("shop_pc"), F.col("spend").alias("_resident")),
        catchment.select("shop_pc", F.col("spend").alias("_near_spend"), F.col("cards").alias("catchment_cards")),
        other.select(F.col("pc5").alias("shop_pc"), "grocery_spend", "lodging_spend", "leisure_spend"),
    )
    areas = _area_totals(shop_comp, SUM_COLUMNS, "shop_pc")
    for side in sides:
        areas = areas.join(side, "shop_pc", "full")
    base = skew_join(shop_comp, areas, ["shop_pc"], "left").join(own, "store", "left")
    return base.select(
        "store", "shop_pc", "split",
        *[(F.coalesce(f"_all_{c}", zero) - _own(c)).alias(c) for c in SUM_COLUMNS],
        (F.coalesce("_resident", zero) - _own("local_spend")).alias("resident_spend"),
        "catchment_cards",
        (F.coalesce("_near_spend", zero) - _own("own_spend")).alias("catchment_spend"),
        "grocery_spend", "lodging_spend", "leisure_spend",
    )


DEMAND_COLUMNS = (
    "store", "leak_outside_share", "local_share", "foreign_share", "premium_share", "business_share", "weekend_share",
    "dinner_share", "avg_ticket", "txns_per_card", "spend_trend", "catchment_cards", "catchment_spend",
    "grocery_spend", "lodging_spend",
)


def demand(base: DataFrame) -> DataFrame:
    """Fourteen features per shop from the joined rows of ``leave_one_out_join``."""

    def num(name: str) -> Column:
        return F.col(name).cast("double")

    features = {
        "leak_outside_share": flags.outside_share(num("resident_spend"), num("local_spend")),
        **{f"{k}_share": flags.safe_share(num(f"{k}_spend"), num("spend"))
           for k in ("local", "foreign", "premium", "business", "weekend", "dinner")},
        "avg_ticket": flags.safe_share(num("spend"), num("txns")),
        "txns_per_card": flags.safe_share(num("txns"), num("cards")),
        "spend_trend": flags.safe_share(num("h1_2026"), num("h1_2025")),
        **{n: num(n) for n in ("catchment_cards", "catchment_spend", "grocery_spend", "lodging_spend")},
    }
    return base.select("store", *[c.alias(n) for n, c in features.items()]).select(*DEMAND_COLUMNS)


def build_demand(
    shop_tx: DataFrame, shops: DataFrame, nearby: DataFrame, card_tx: DataFrame, params: Params
) -> DataFrame:
    comp = shop_composition(shop_tx, params.target_year, params.trend_before, params.trend_after)
    wallet = home_wallet(shop_tx, params.target_year)
    areas, own = catchment_join(nearby, wallet, shops, shop_home_spend(shop_tx, params.target_year))
    other = area_other_spend(card_tx, params.target_year)
    return demand(leave_one_out_join(comp, wallet, areas, own, other))
