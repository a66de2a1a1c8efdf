"""Cells: one row per postcode and category, the unit the model learns on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions import flags
from placewise.operators.common import grouped_medians, grouped_quantile, hash_split
from placewise.params import MIN_FULL_YEAR, TRAIN_SHARE

CELL = ("pc5", "mrch_catg_cd")
DEMAND_FEATURES = (
    "avg_ticket", "foreign_share", "local_share", "leak_outside_share", "lodging_spend", "grocery_spend",
    "premium_share", "business_share", "spend_trend", "dinner_share", "weekend_share", "catchment_cards",
    "catchment_spend",
)
FEATURES = (
    "n_shops", "n_brands", "n_competitor_shops", "zip_cards", "share_big", *DEMAND_FEATURES, "full_year_share",
    "median_months_active", "cards_per_shop", "txns_per_card", "spend_per_shop_proxy",
)


def _cells_only(shops: DataFrame) -> DataFrame:
    return shops.where(F.col("pc5").isNotNull() & F.col("mrch_catg_cd").isNotNull())


def area_medians(
    shops: DataFrame, demand: DataFrame, cols: Sequence[str] = (*DEMAND_FEATURES, "txns_per_card")
) -> DataFrame:
    rows = shops.where(F.col("pc5").isNotNull()).select("store", "pc5").join(demand, "store", "left")
    return grouped_medians(rows, ["pc5"], cols)


def largest_brand(shops: DataFrame) -> DataFrame:
    by_brand = _cells_only(shops).where(F.col("brand").isNotNull()).groupBy(*CELL, "brand").agg(F.count("*").alias("n"))
    return by_brand.groupBy(*CELL).agg(F.max("n").alias("n"))


def full_year_median(shops: DataFrame) -> DataFrame:
    return grouped_quantile(_cells_only(shops).where("full_year"), CELL, "revenue", 0.5, "revenue_full_year")


def shop_counts(shops: DataFrame) -> DataFrame:
    """Counts and shares per cell.  Shops are first summed per brand, so the
    number of brands is a plain count and a crowded cell is small by then."""
    per_brand = _cells_only(shops).groupBy(*CELL, "brand").agg(
        F.count("*").alias("shops"),
        F.sum("cards").alias("cards"),
        F.count_if(F.col("brand_tier") == "big").alias("big"),
        F.count_if(F.col("full_year")).alias("full"),
        F.min(F.when(F.col("district").isNotNull(), F.struct("store", "district"))).alias("first"),
    )
    n = F.sum("shops")
    return per_brand.groupBy(*CELL).agg(
        n.alias("n_shops"),
        F.count("brand").alias("n_brands"),
        F.sum("cards").alias("zip_cards"),
        (F.sum("big") / n).alias("share_big"),
        F.min("first")["district"].alias("district"),
        (F.sum("full") / n).alias("full_year_share"),
        F.sum("full").alias("n_full_year"),
        (n - F.max("shops")).alias("n_competitor_shops"),
    )


def cell_assembly(counts: DataFrame, area: DataFrame, full_year: DataFrame) -> DataFrame:
    """All sides have one row per cell or postcode."""
    joined = counts.join(area, "pc5", "left").join(full_year, list(CELL), "left")
    per_shop = flags.per_shop_features(
        F.col("zip_cards"), F.col("n_shops"), F.col("txns_per_card"), F.col("avg_ticket")
    )
    return cell_split(joined.withColumns(per_shop))


CELL_COLUMNS = (
    "pc5", "mrch_catg_cd", "revenue", "n_shops", "n_brands", "zip_cards", "share_big", "district", "full_year_share",
    "median_months_active", "n_full_year", "n_competitor_shops", *DEMAND_FEATURES, "txns_per_card",
    "revenue_full_year", "cards_per_shop", "spend_per_shop_proxy", "split",
)


def cells(shops: DataFrame, demand: DataFrame) -> DataFrame:
    own = grouped_medians(_cells_only(shops), CELL, ["revenue", "months_active"]).withColumnRenamed(
        "months_active", "median_months_active"
    )
    counts = shop_counts(shops).join(own, list(CELL))
    return cell_assembly(counts, area_medians(shops, demand), full_year_median(shops)).select(*CELL_COLUMNS)


def cell_split(df: DataFrame, key: str = "pc5", train_share: float = TRAIN_SHARE) -> DataFrame:
    """Split by postcode, so both categories of a code are on one side."""
    return hash_split(df, key, train_share)


def labelled_cells(df: DataFrame, min_full_year: int = MIN_FULL_YEAR, target: str = "revenue_full_year") -> DataFrame:
    return df.where((F.col("n_full_year") >= min_full_year) & F.col(target).isNotNull())


def mcc_median(df: DataFrame, target: str) -> DataFrame:
    known = df.where(F.col("mrch_catg_cd").isNotNull())
    return grouped_quantile(known, ["mrch_catg_cd"], target, 0.5, "med")


def impute_median(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fills NULLs with the interpolated medians of the training rows."""
    one = train.select(F.lit(1).alias("_one"), *cols)
    fill = grouped_medians(one, ["_one"], cols).select("_one", *[F.col(c).alias(f"_m_{c}") for c in cols])
    # The medians of a single group are one row, whatever the size of the data.
    filled = df.withColumn("_one", F.lit(1)).join(F.broadcast(fill), "_one", "left").drop("_one")
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_m_{c}") for c in cols}).drop(
        *[f"_m_{c}" for c in cols]
    )
