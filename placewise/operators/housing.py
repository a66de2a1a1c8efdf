"""Property sales: register merge, cleaning, features and price statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions import flags, geo, text
from placewise.operators.common import (
    complete_cases,
    dedupe_keep_first,
    drop_technical_columns,
    grouped_quantile,
    rename_recode,
)
from placewise.operators.spatial import district_join

# Bounds, codes and columns of the sales that are kept.
PRICE_BAND = (5_000, 55_000)
AREA_BAND = (15, 200)
YEARS = (2023, 2025)
APARTMENT_BUILDING = 110
MARKETS = {1: "Pierwotny", 2: "Wtórny"}
KRAKOW = "kraków"
KRAKOW_COUNTIES = ("kraków", "powiat krakowski")
DEDUPE_KEYS = ("cenaTransakcjiBrutto", "powUzytkowaLokalu", "ulica", "geometry")
MODEL_COLUMNS = (
    "cena_m2", "powUzytkowaLokalu", "nrKondygnacji", "liczbaIzb", "rodzajRynku", "dzielnica", "rok",
    "dist_to_center", "has_parking", "has_balcony", "has_storage", "X_2180", "Y_2180",
)


def krakow_filter(geonames: DataFrame, city: str = KRAKOW, counties: Sequence[str] = KRAKOW_COUNTIES) -> DataFrame:
    return geonames.where((F.lower("place_name") == city) | F.lower("admin_name2").isin(*counties))


def krakow_postcodes(geonames: DataFrame) -> DataFrame:
    """One row per postcode: first names in file order, mean position, WKT point."""
    def first(name: str):
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("row_no"))).alias(name)

    names = [c for c in ("place_name", "admin_name1", "admin_name2", "admin_name3") if c in geonames.columns]
    return (
        geonames.where(F.col("postal_code").isNotNull())
        .groupBy("postal_code")
        .agg(
            *[first(c) for c in names],
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
            F.count("country_code").alias("punktow_w_kodzie"),
        )
        .withColumn("point_wkt", geo.point_wkt(F.col("longitude"), F.col("latitude")))
    )


def feature_bridge(
    tp: DataFrame, td: DataFrame, pl: DataFrame, la: DataFrame, pb: DataFrame
) -> DataFrame:
    """The five register ids, linked transaction by transaction.

    Premises and buildings meet on the same id and so without an exchange between.
    """
    return (
        tp.join(td, "id_transakcji", "left")
        .join(pl, "id_nieruchomosci", "inner")
        .join(pb, "id_nieruchomosci", "left")
        .join(la, "id_lokalu", "left")
        .select("id_transakcji", "id_nieruchomosci", "id_dokumentu", "id_lokalu", "id_adresu", "id_budynku")
    )


def _linked(rows: DataFrame, side: DataFrame, key: str, on: str, how: str) -> DataFrame:
    """Join of ``rows`` with a layer on its id; rows without a key meet nothing.

    NULL keys would all be dealt to one task.  An inner join leaves them out; in an
    outer one each goes by a text of its own that is no id, since XML holds no NUL:
    the rows are read once, where passing around the join would read them twice.
    """
    if how == "inner":
        return rows.where(F.col(key).isNotNull()).join(side, F.col(key) == F.col(on), how)
    apart = F.concat(F.lit("\0"), F.xxhash64(F.spark_partition_id(), *rows.columns).cast("string"))
    met = rows.withColumn(key, F.coalesce(key, apart)).join(side, F.col(key) == F.col(on), how)
    return met.withColumn(key, F.when(~F.col(key).startswith("\0"), F.col(key)))


def register_merge(
    bridge: DataFrame, trans: DataFrame, lokal: DataFrame, doc: DataFrame, build: DataFrame, adres: DataFrame
) -> DataFrame:
    """Attributes of every linked feature; a clashing premises column gets ``_lo``.

    Layers are tables in buckets of their id (``RegisterRun``): joins move none
    of their rows.  The bridge has another id for every layer and is
    dealt once per join, so the narrow layers come first and the two wide ones
    last, while its rows are short.
    """
    taken = set(trans.columns) | set(bridge.columns)
    premises = lokal.select([F.col(c).alias(f"{c}_lo" if c in taken else c) for c in lokal.columns])
    premises_id = "gml_id_lo" if "gml_id" in taken else "gml_id"
    wide = [*bridge.columns, *trans.columns, *premises.columns]
    out, narrow = bridge, []
    sides = (
        (doc, "id_dokumentu", ["dataSporzadzeniaDokumentu"], "_dok"),
        (build, "id_budynku", ["rodzajBudynku"], "_bu"),
        (adres, "id_adresu", ["ulica", "numerPorzadkowy"], "_ad"),
    )
    for side, key, columns, suffix in sides:
        if not all(c in side.columns for c in columns):
            continue
        named = {c: f"{c}{suffix}" if c in [*wide, *narrow] else c for c in columns}
        renamed = side.select(F.col("gml_id").alias(f"_id{suffix}"), *[F.col(c).alias(n) for c, n in named.items()])
        out = _linked(out, renamed, key, f"_id{suffix}", "left").drop(f"_id{suffix}")
        narrow += named.values()
    out = _linked(out, premises, "id_lokalu", premises_id, "inner")
    return _linked(out, trans, "id_transakcji", "gml_id", "inner").select(*wide, *narrow)


def price_band(sales: DataFrame, lo: float = PRICE_BAND[0], hi: float = PRICE_BAND[1]) -> DataFrame:
    """Numeric price and area, price per square metre, and only credible ones."""
    priced = sales.withColumns(
        {c: F.col(c).try_cast("double") for c in ("cenaTransakcjiBrutto", "powUzytkowaLokalu")}
    )
    full = priced.dropna(subset=["cenaTransakcjiBrutto", "powUzytkowaLokalu", "geometry_wkt"])
    per_m2 = flags.price_per_m2(F.col("cenaTransakcjiBrutto"), F.col("powUzytkowaLokalu"))
    return full.withColumn("cena_m2", per_m2).where(F.col("cena_m2").between(lo, hi))


def fractional_sale_filter(sales: DataFrame, words: Sequence[str] = flags.FRACTIONAL_WORDS) -> DataFrame:
    """Drops sales of a share; ``(?iu)`` so that accented capitals match too."""
    notes = F.coalesce("dodatkoweInformacje", F.lit(""))
    return sales.withColumn("dodatkoweInformacje", notes).where(~notes.rlike("(?iu)" + "|".join(words)))


def residential_sale_filter(
    sales: DataFrame,
    area: tuple[float, float] = AREA_BAND,
    years: tuple[int, int] = YEARS,
    building: int = APARTMENT_BUILDING,
) -> DataFrame:
    return sales.where(
        F.col("powUzytkowaLokalu").between(*area)
        & F.col("funkcjaLokalu").cast("string").startswith("1")
        & F.col("rodzajTransakcji").cast("string").startswith("1")
        & (F.col("rodzajBudynku").try_cast("double") == building)
        & F.col("rok").between(*years)
        & (F.col("nrKondygnacji").try_cast("double") >= 0)
    )


def duplicate_profile(
    sales: DataFrame, keys: Sequence[str] = ("cenaTransakcjiBrutto", "powUzytkowaLokalu", "geometry"), id_col: str = "id"
) -> DataFrame:
    """Rows, rows that share their key with another one, and distinct ids."""
    copies = sales.groupBy(*keys).agg(F.count("*").alias("n"))
    dup = copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"),
    )
    return dup.withColumn("n_ids", sales.agg(F.count_distinct(id_col)).scalar())


def clean_sales(sales: DataFrame, order: str | Sequence[str], keys: Sequence[str] = DEDUPE_KEYS) -> DataFrame:
    """One record per price, area, street and place."""
    return dedupe_keep_first(sales, keys, order)


def merged_sales(merged: DataFrame, lo: float = PRICE_BAND[0], hi: float = PRICE_BAND[1]) -> DataFrame:
    """Credible, distinct sales of a merged register, without its technical columns.

    Records with the same price, area, street and place count once: the one
    with the least register ids.
    """
    banded = price_band(merged, lo, hi).withColumn("geometry", F.col("geometry_wkt"))
    return drop_technical_columns(clean_sales(banded, ["id_transakcji", "id_nieruchomosci", "id_lokalu", "id_budynku"]))


def sale_features(
    sales: DataFrame,
    polygons: DataFrame,
    reproject: bool = True,
    area: tuple[float, float] = AREA_BAND,
    years: tuple[int, int] = YEARS,
    building: int = APARTMENT_BUILDING,
) -> DataFrame:
    """District, amenities, year, position and distance of every usable sale."""
    x, y = geo.parse_point(F.col("geometry"))
    points = sales.withColumns({"x": x, "y": y})
    placed = district_join(geo.reproject_2178_2180(points) if reproject else points, polygons)
    told = fractional_sale_filter(placed).withColumns(flags.amenity_flags(F.col("dodatkoweInformacje")))
    coded = rename_recode(told.withColumn("rodzajRynku", F.col("rodzajRynku").cast("double")), {}, {"rodzajRynku": MARKETS})
    dated = coded.withColumn("rok", flags.doc_year(F.col("dataSporzadzeniaDokumentu"))).where(F.col("rok").isNotNull())
    located = rename_recode(dated, {"x": "X_2180", "y": "Y_2180"}).withColumn(
        "dist_to_center", geo.distance_to_centre(F.col("X_2180"), F.col("Y_2180"))
    )
    homes = residential_sale_filter(located, area, years, building)
    return complete_cases(homes.select(*MODEL_COLUMNS), MODEL_COLUMNS)


def sale_counts(sales: DataFrame, value: str = "cena_m2") -> DataFrame:
    """Number of sales and their mean price per square metre."""
    return sales.agg(F.count("*").alias("n"), F.avg(value).alias("mean_price_m2"))


def price_stats(sales: DataFrame, key: str = "postal_code", value: str = "cena_m2") -> DataFrame:
    """Mean and exact median price per code, two decimals."""
    known = sales.where(F.col(key).isNotNull())
    means = known.groupBy(key).agg(F.round(F.avg(value), 2).alias("avg_price_m2"))
    medians = grouped_quantile(known, [key], value, 0.5, "median_price_m2")
    return means.join(medians.withColumn("median_price_m2", F.round("median_price_m2", 2)), key, "left")


def geo_price_join(codes: DataFrame, prices: DataFrame) -> DataFrame:
    return codes.join(prices, "postal_code")


def candidates_by_type(geo_prices: DataFrame, zip_revenue: DataFrame) -> DataFrame:
    """Every code and place type with position, price and predicted revenue."""
    revenue = zip_revenue.select(
        text.postcode_key(F.col("zip_code")).alias("_key"), "type", F.col("predicted_revenue").alias("revenue")
    )
    return geo_prices.withColumn("_key", text.postcode_key(F.col("postal_code"))).join(revenue, "_key").drop("_key")


def type_filter(zip_revenue: DataFrame, place_type: str) -> DataFrame:
    return zip_revenue.where(F.col("type") == place_type)


def candidate_join(geo_prices: DataFrame, zip_revenue: DataFrame, place_type: str, area_m2: float = 25) -> DataFrame:
    """Codes with position, price and revenue, and what the floor area costs there."""
    revenue = type_filter(zip_revenue, place_type).select(
        text.postcode_key(F.col("zip_code")).alias("_key"), F.col("predicted_revenue").alias("revenue")
    )
    keyed = geo_prices.withColumn("_key", text.postcode_key(F.col("postal_code")))
    cost = flags.location_cost(F.col("avg_price_m2"), F.lit(float(area_m2)))
    return keyed.join(revenue, "_key").drop("_key").withColumn("total_cost", cost)
